"""Several tables saved as one unit, bucketed by a key where they are to be joined by it.

Every save writes its tables to a folder of its own and then puts one entry, by one rename, that
names all of them. Readers take the newest entry, so they meet all tables of a save or none, also
where a save dies between two tables or runs beside a reader. Two saves at the same time both get
an entry; readers take the later one by number, then by name.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from modlens.sources import manifest as mf


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """A table as Parquet in buckets of a key, one sorted file each.

    A key that holds a large part of the rows is one bucket, so the key should be spread (a document
    id). ``buckets`` should grow with the table: some 200 MB each.
    """
    name = f"modlens_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.format("parquet").mode("errorifexists")
    writer.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    # The catalog forgets the table, the files stay.
    df.sparkSession.sql(f"DROP TABLE {name}")


def read_bucketed(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """A table of ``write_bucketed``; joins and groups by its key need no shuffle."""
    name = f"modlens_{uuid.uuid4().hex}"
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    column = f"`{key.replace('`', '``')}`"
    spark.sql(
        f"CREATE TABLE {name} ({spark.read.parquet(path).schema.toDDL()}) USING parquet"
        f" CLUSTERED BY ({column}) SORTED BY ({column}) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    out = spark.table(name)
    out.schema  # resolved now, as the catalog forgets the name
    spark.sql(f"DROP TABLE {name}")
    return out


def save_version(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    folder: str,
    key: str | None = None,
    buckets: int | None = None,
    more: Mapping[str, object] | None = None,
) -> int:
    """Write all tables and then their entry; the number of the version.

    With ``buckets``, tables that hold ``key`` are bucketed by it. ``more`` maps a name to a function
    (spark, path of the written table's folder, path to write) for files made from the written tables.
    """
    data = f"{folder}/data/{uuid.uuid4().hex}"
    written = {}
    for name, df in tables.items():
        path = f"{data}/{name}"
        hashed = buckets is not None and key in df.columns
        if hashed:
            write_bucketed(df, path, key, buckets)
        else:
            df.write.parquet(path)
        written[name] = {"path": path, "key": key if hashed else None, "buckets": buckets if hashed else None}
    files = {}
    for name, make in (more or {}).items():
        files[name] = f"{data}/{name}"
        make(spark, data, files[name])
    last = versions(spark, folder)
    number = 1 + (last[-1] if last else 0)
    entry = {"version": number, "data": data, "tables": written, "files": files}
    mf.put_entry(spark, f"{folder}/versions/{number:012d}-{uuid.uuid4().hex}.json", entry)
    return number


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished versions, oldest first."""
    return [int(n.partition("-")[0]) for n in mf.names_in(spark, f"{folder}/versions")]


def newest(spark: SparkSession, folder: str, version: int | None = None) -> dict:
    """The entry of the newest version, or of a given one; ``FileNotFoundError`` if there is none."""
    names = mf.names_in(spark, f"{folder}/versions")
    if version is not None:
        names = [n for n in names if n.startswith(f"{version:012d}-")]
    if not names:
        raise FileNotFoundError(f"no finished version in {folder}")
    return mf.read_entry(spark, f"{folder}/versions/{names[-1]}")


def load_version(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """All tables of the newest version, or of a given one."""
    out = {}
    for name, t in newest(spark, folder, version)["tables"].items():
        if t["buckets"] is None:
            out[name] = spark.read.parquet(t["path"])
        else:
            out[name] = read_bucketed(spark, t["path"], t["key"], t["buckets"])
    return out


def drop_versions(spark: SparkSession, folder: str, keep: int = 2, idle_seconds: float = 86_400) -> None:
    """Remove all but the newest ``keep`` versions, and what saves that died left behind.

    An entry goes before its tables, so readers never meet half a version. Tables without an entry go
    when their folder is older than ``idle_seconds``, which must exceed the longest save.
    """
    if keep < 1:
        raise ValueError("keep at least one version")
    names = mf.names_in(spark, f"{folder}/versions")
    old = [mf.read_entry(spark, f"{folder}/versions/{n}")["data"] for n in names[:-keep]]
    kept = {mf.read_entry(spark, f"{folder}/versions/{n}")["data"].rpartition("/")[2] for n in names[-keep:]}
    for n in names[:-keep]:
        mf.delete(spark, f"{folder}/versions/{n}")
    for data in old:
        mf.delete(spark, data)
    for n in mf.names_in(spark, f"{folder}/data"):
        path = f"{folder}/data/{n}"
        if n not in kept and mf.age_of(spark, path) > idle_seconds:
            mf.delete(spark, path)
