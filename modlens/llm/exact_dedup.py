"""Exact dedup by content-defined chunk recipes.

Main path: DataFrame functions only. The white space of a text is deleted and the rest is cut into
chunks where its own content says so: at the first sentence end after a chunk's first 512
characters, and after 4,096 characters at the latest. Equal texts therefore have equal chunks. A
chunk's identifier is its 64-bit hash and length; a text's recipe is the ordered list of its
identifiers. Texts with different recipes differ, so only texts whose recipe occurs twice go on:
their chunks are gathered by identifier, each distinct chunk once per partition, and where one
identifier stands for two chunks, the texts that hold it are compared by the chunks themselves.
Texts move at most once, to meet the list of shared recipes; all else moves identifiers only.

Of equal texts the row with the most code points stays, then the smallest doc_id.

Defined cases: a null text counts as empty; empty texts equal each other. Rows that share a doc_id
count one by one; of two rows alike in text length and doc_id, both name the same doc_id. A null
doc_id sorts first and stays a null. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlens.functions.arrays import with_fields
from modlens.llm.common import SPACE, keep_documents, same_keys, table
from modlens.session import checkpointed

# A chunk: 512 characters and on to the next sentence end, or what is left of the text.
CHUNK = r"(?s).{512}[^.!?\u3002]{0,3583}+.?|.{1,511}"


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def chunks(norm: Column) -> Column:
    """Content-defined chunks of a normalised text, in order; they concatenate to it."""
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def chunk_id(chunk: Column, bits: int = 64) -> Column:
    """Identifier of a chunk: hash (of ``bits`` bits) and length."""
    h = F.shiftrightunsigned(F.xxhash64(chunk), 64 - bits) if bits < 64 else F.xxhash64(chunk)
    return F.struct(h.alias("h"), F.length(chunk).alias("n"))


def recipes(docs: DataFrame, bits: int = 64, spelling: bool = False) -> DataFrame:
    """doc_id, n_points (code points of the original), text_sha256, recipe (and the chunks) per row."""
    cut = with_fields(docs.select("doc_id", "text"), {"norm": normalised(F.col("text"))})
    out = cut.select(
        "doc_id",
        F.length(F.coalesce("text", F.lit(""))).alias("n_points"),
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.transform(chunks(F.col("norm")), lambda c: chunk_id(c, bits)).alias("recipe"),
        chunks(F.col("norm")).alias("spelling"),
    )
    return out if spelling else out.drop("spelling")


def ambiguous(docs: DataFrame, recipe_rows: DataFrame, bits: int = 64) -> DataFrame:
    """Identifiers (``id``) that stand for two or more different chunks of texts with a shared recipe.

    The check reads the chunks themselves: each identifier's smallest and greatest chunk must be
    the same text. Sums are made per partition first, so a chunk in very many copies moves once
    per partition.
    """
    shared = recipe_rows.groupBy("recipe").agg(F.count("*").alias("n")).filter("n > 1").select("recipe")
    twins = same_keys(recipe_rows.select("doc_id", "recipe"), shared, ["recipe"], "left_semi")
    texts = keep_documents(docs.select("doc_id", "text"), twins)
    each = texts.select(F.explode(chunks(normalised(F.col("text")))).alias("chunk"))
    ids = each.select(chunk_id(F.col("chunk"), bits).alias("id"), "chunk")
    return ids.groupBy("id").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).filter("a <> b").select("id")


def spelled_out(docs: DataFrame, rows: DataFrame, doubtful: DataFrame, bits: int) -> DataFrame:
    """The recipe rows with ``spelling``: the chunks themselves where a chunk is doubtful, else null."""
    none = F.lit(None).cast("array<string>")
    held = (
        rows.select("recipe", F.explode("recipe").alias("id"))
        .join(doubtful, "id", "left_semi")
        .select("recipe")
        .distinct()
    )
    plain = same_keys(rows, held, ["recipe"], "left_anti").withColumn("spelling", none)
    texts = keep_documents(docs, same_keys(rows, held, ["recipe"], "left_semi"))
    again = recipes(texts, bits, spelling=True)
    return plain.unionByName(same_keys(again, held, ["recipe"], "left_semi"))


def classes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = checkpointed(recipes(docs, bits))
    doubtful = checkpointed(ambiguous(docs, rows, bits))
    keys = ["recipe"]
    if not doubtful.isEmpty():
        rows = checkpointed(spelled_out(docs, rows, doubtful, bits))
        keys = ["recipe", "spelling"]
    best = F.min(F.struct((-F.col("n_points")).alias("n"), "doc_id"))["doc_id"]
    groups = rows.groupBy(*keys).agg(best.alias("keep_id"), F.count("*").alias("group_size"))
    out = same_keys(rows, groups, keys)
    return out.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One document of each class of equal texts, all columns; rows alike in key and text stay once."""
    return keep_documents(docs, classes(docs).filter("kept")).dropDuplicates(["doc_id", "text"])


def op7(spark, folder):
    """Every document with the document that stays for it."""
    return classes(table(spark, folder, "documents"))


SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points,
   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
 g AS (SELECT norm, count(*) AS group_size, min(struct_pack(p := -points, d := doc_id)).d AS keep_id
   FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM n JOIN g USING (norm)
"""
