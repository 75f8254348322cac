"""Comment CSV, intermediate tables, dictionaries, small literal tables."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from modlens import lexicons as lx
from modlens.session import checkpointed
from modlens.sources.versions import load_version, save_version


def comment_schema(labels: Sequence[str] = tuple(lx.LABELS)) -> T.StructType:
    """Schema of a labelled comment table: key, text, one 0/1 column per label."""
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    return T.StructType(fields + [T.StructField(c, T.IntegerType()) for c in labels])


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A literal table of a few rows, held in the plan."""
    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    columns = list(zip(*rows)) if rows else [()] * len(struct)
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow))


# Names of the public comment table, and what they are called here.
COMMENT_NAMES = {"id": "doc_id", "comment_text": "text"}


def read_comments(
    spark: SparkSession, path: str, schema: T.StructType | None = None,
    names: dict[str, str] | None = None,
) -> DataFrame:
    """Read a comment CSV with a header; quoted text may hold line breaks and doubled quotes.

    Columns are found by their header; ``names`` renames them first. Without a schema the key
    stays text and all other columns but ``text`` are whole numbers. A row with too few or too many
    fields, or a value that is not of its column's type, stops the job. With ``multiLine`` a file is
    one task, so a large table should come as many files.
    """
    raw = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .csv(path)
        .withColumnsRenamed(COMMENT_NAMES if names is None else names)
    )
    schema = _comment_types(path, raw.columns, schema)
    return raw.select([F.col(f.name).cast(f.dataType) for f in schema])


def read_comments_apart(
    spark: SparkSession, path: str, schema: T.StructType | None = None,
    names: dict[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Read a comment CSV as ``read_comments`` does, but set malformed records apart.

    Gives the good rows, and a table of the others: ``file``, ``record`` (its number in the file, from
    0, blank lines and the header not counted), ``reason`` and ``raw``. The reason is ``fields`` for
    too few or too many fields (``raw`` is the text as it stands), else the first column whose value
    is not of its type (``raw`` is the record as CSV). The files are read once, into a table in the
    shared folder that both results read. All files must have the columns of the first in its order.
    """
    given = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    called = [(COMMENT_NAMES if names is None else names).get(c, c) for c in given]
    schema = _comment_types(path, called, schema)
    text = T.StructType([T.StructField(c, T.StringType()) for c in called] + [T.StructField(_RAW, T.StringType())])
    rows = (
        spark.read.schema(text)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _RAW)
        .csv(path)
        .select("*", F.col("_metadata.file_path").alias(_FILE))
        .withColumn(_ORDER, F.monotonically_increasing_id())
    )
    reason = F.when(F.col(_RAW).isNotNull(), F.lit("fields"))
    for f in schema:
        wrong = F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()
        reason = reason.when(wrong, F.lit(f.name))
    raw = F.coalesce(F.col(_RAW), F.to_csv(F.struct(*called), {"escape": '"'}))
    # Written before any column is left out: a parser that skips columns does not see all faults.
    read = checkpointed(rows.withColumns({_REASON: reason, _RAW: F.when(reason.isNotNull(), raw)}))
    good = read.filter(F.col(_REASON).isNull()).select([F.col(f.name).cast(f.dataType) for f in schema])
    # A file is one task, so the ids of its records follow each other without a gap.
    first = read.groupBy(_FILE).agg(F.min(_ORDER).alias("_first"))
    bad = read.filter(F.col(_REASON).isNotNull()).join(first, _FILE)
    bad = bad.select(
        F.col(_FILE).alias("file"), (F.col(_ORDER) - F.col("_first")).alias("record"),
        F.col(_REASON).alias("reason"), F.col(_RAW).alias("raw"),
    )
    return good, bad


_RAW, _FILE, _ORDER, _REASON = "_modlens_raw", "_modlens_file", "_modlens_order", "_modlens_reason"


def _comment_types(path: str, columns: Sequence[str], schema: T.StructType | None) -> T.StructType:
    # The schema asked for, or the key and text as text and all other columns as whole numbers.
    if schema is None:
        texts = [c for c in ("doc_id", "text") if c in columns]
        whole = [c for c in columns if c not in texts]
        schema = T.StructType(
            [T.StructField(c, T.StringType()) for c in texts] + [T.StructField(c, T.IntegerType()) for c in whole]
        )
    missing = [f.name for f in schema if f.name not in columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return schema


def write_csv(df: DataFrame, path: str) -> None:
    """Write a table as CSV with a header, quotes doubled, blanks at the ends kept."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("quoteAll", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


PROCESSED = ("identity_features", "identity_statistics")


def save_processed(
    features: DataFrame, statistics: DataFrame, folder: str, buckets: int | None = None, key: str = "doc_id"
) -> None:
    """Write both tables as Parquet and as CSV; a reader meets all of a save or nothing of it.

    With ``buckets``, the features are bucketed by ``key``, so that joins by it need no shuffle.
    """

    def as_csv(name: str):
        # The CSV is made from the written table, so the features are computed once.
        return lambda spark, data, path: write_csv(spark.read.parquet(f"{data}/{name}"), path)

    save_version(
        features.sparkSession, dict(zip(PROCESSED, (features, statistics))), folder, key, buckets,
        more={f"{n}.csv": as_csv(n) for n in PROCESSED},
    )


def load_processed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Read both tables of the newest save; ``FileNotFoundError`` if no save is finished."""
    tables = load_version(spark, folder)
    return tuple(tables[n] for n in PROCESSED)


def read_substitutions(spark: SparkSession, path: str) -> list[list[tuple[str, str]]]:
    """Read a dictionary CSV (pass, ord, key, replacement) into ordered passes."""
    schema = "pass int, ord int, key string, replacement string"
    # A replacement may begin or end with a blank, and that blank counts.
    df = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    rows = df.orderBy("pass", "ord").collect()  # becomes constants of the plan
    passes: dict[int, list[tuple[str, str]]] = {}
    for r in rows:
        passes.setdefault(r["pass"], []).append((r["key"], r["replacement"] or ""))
    return [passes[p] for p in sorted(passes)]


def new_columns(after: DataFrame, before: DataFrame) -> list[str]:
    """Names in ``after`` that ``before`` lacks, sorted."""
    return sorted(set(after.columns) - set(before.columns))


def shape(df: DataFrame) -> tuple[int, int]:
    """Number of rows and of columns."""
    return df.count(), len(df.columns)


def preview(df: DataFrame, n: int = 10, key: str = "doc_id") -> DataFrame:
    """The first rows by key."""
    return df.orderBy(F.col(key)).limit(n)
