"""Input tables of the queries, in Spark and as SQL.

The test documents are invented prose without links, shorthand or identity terms. The comment
table therefore is every document with one of the sentences below behind it; its size and its
text length follow the given table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modlens import lexicons as lx
from modlens.functions.arrays import string_array
from modlens.operators.normalise import clean_comments
from modlens.session import dealt
from modlens.sources.manifest import is_folder
from modlens.streaming.enrich import read_stream


@dataclass(frozen=True)
class Query:
    """A query on (session, folder of tables) and the SQL that gives the same rows."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


SENTENCES = [
    "See http://example.org/a?b=1 and glued_https://x.example/y\nwww.example.net now.",
    "Write to jane.doe+x@mail.example.com or BOB@EXAMPLE.COM today!",
    "idk tbh, omw 2mw w/ bae w/o u. encl. ft. 6 ft l8r <3 $ and $5 etc",
    "Café crème naïve €9 – luv it ☺",
    "Some despise the loud gay people next door, whose music is always on. They moved out.",
    "Dr. Lopez runs a lovely bakery. She's not hiding from the customers.",
    "Muslims, a muslim woman and many a Jewish man love the old community!",
    "Having a wheelchair is NOT a bad thing at all. Stop shouting at us!",
    "You people are stupid idiots, go back to your own land. They always lie.",
    "I can't stand those loud middle eastern people, the Middle Eastern group or the group.",
    "He didn't like the young boy but she never, ever said that bad thing.",
    "No teen or senior adult will not be a good, kind and helpful person?",
    "all black people and every white man: typical old people, these people are trash",
    "I am not the very happy one and nobody can be so sad, angry or afraid.",
    "You are pathetic garbage, you loser. Your idiot friend is disgusting and sick.",
    "non-black, non-white; the blind, deaf and disabled aren't weak. Don't reject them.",
    "She wasn't wrong! It isn't gay to be glad, excited and pleased... is it?",
    "you all are moron types and these folks are dumb. These ones are gross, you type!",
    "Nothing muslim jewish christian awful was said; I would not do that at all",
    "btw thx ppl, asap b4 a.m. tl;dr omg lol gr8 fyi amirite",
    "every generation of a religious atheist is never secular, always furious",
    "cannot gay man good thing here, won't be terrible, none",
    "the wonderful catholic nun is not a protestant. A hindu sikh buddhist boomer came",
]


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_labels(df: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Rows with the six labels of their document; what was made of the texts is joined, not they."""
    return df.join(labels(spark, folder), "doc_id")


def commented(df: DataFrame) -> DataFrame:
    """Key and text, with a sentence appended."""
    picks = string_array(SENTENCES)
    pick = F.get(picks, (F.col("doc_id") % len(SENTENCES)).cast("int"))
    return df.withColumn("text", F.concat_ws(" ", F.col("text"), pick))


def document_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """The documents (doc_id, text) as a stream, whether their table is one file or a folder of files."""
    path = f"{folder}/documents.parquet"
    schema = read(spark, folder, "documents").schema
    if is_folder(spark, path):
        stream = read_stream(spark, path, schema, files_per_batch=files_per_batch)
    else:
        stream = read_stream(spark, folder, schema, "documents.parquet", files_per_batch)
    return stream.select("doc_id", "text")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Given documents: doc_id, text."""
    return read(spark, folder, "documents").select("doc_id", "text")


def comments(spark: SparkSession, folder: str, spread: bool = False) -> DataFrame:
    """Comment table: doc_id, text; ``spread`` deals it over all cores, for work that costs more than moving it."""
    docs = documents(spark, folder)
    return commented(dealt(docs, "doc_id") if spread else docs)


def cleaned(spark: SparkSession, folder: str, spread: bool = False) -> DataFrame:
    """Comment table after the cleaning chain."""
    return clean_comments(comments(spark, folder, spread))


def six_labels() -> dict[str, Column]:
    """The six labels from the two given ones and the key."""
    t, q, d = F.col("toxic"), F.col("quality"), F.col("doc_id")
    on = {
        "severe_toxic": (t == 1) & (q == 0),
        "obscene": (t == 1) & (d % 3 == 0),
        "threat": (t == 1) & (d % 5 == 0),
        "insult": (t == 1) | (d % 7 == 0),
        "identity_hate": (t == 1) & (d % 4 == 0),
    }
    return {"toxic": t} | {n: c.cast("int") for n, c in on.items()}


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and six labels."""
    df = read(spark, folder, "labels")
    return df.select("doc_id", *[c.alias(n) for n, c in six_labels().items()])


def labelled(spark: SparkSession, folder: str, clean: bool = True) -> DataFrame:
    """Comments with their six labels; unlabelled comments are left out."""
    base = cleaned(spark, folder) if clean else comments(spark, folder)
    return base.join(labels(spark, folder), "doc_id")


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Prediction rows (doc_id, label_name, y, p, yhat): a score that leans towards y."""
    long = labels(spark, folder).unpivot(["doc_id"], lx.LABELS, "label_name", "y")
    ix = F.array_position(string_array(lx.LABELS), F.col("label_name"))
    h = (F.col("doc_id") * 7919 + ix * 104729) % 700
    p = (h + 300 * F.col("y")).cast("double") / F.lit(1000.0)
    return long.withColumn("p", p).withColumn("yhat", (F.col("p") > 0.5).cast("int"))


# -- the same tables as SQL -----------------------------------------------------------------


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    """A SQL list of strings."""
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def sql_in(values) -> str:
    """A SQL value list for IN."""
    return "(" + ", ".join(quoted(v) for v in values) + ")"


SQL_SPACE = r"\t\n\x0b\f\r\x1c-\x1f \x{85}\p{Z}"

COMMENTS = (
    f"raw AS (SELECT doc_id, text || ' ' || {sql_list(SENTENCES)}"
    f"[(doc_id % {len(SENTENCES)}) + 1] AS text FROM documents)"
)


def _marked_key(key: str) -> str:
    # The key as it looks in a text whose words and symbols carry marks on their free sides.
    out, n = "", len(key)
    for i, ch in enumerate(key):
        before = key[i - 1] if i else " "
        after = key[i + 1] if i + 1 < n else " "
        word = ch.isalnum() or ch == "_"
        left = before.isalnum() or before == "_"
        right = after.isalnum() or after == "_"
        if word:
            out += ("" if left else "\x01") + ch + ("" if right else "\x02")
        else:
            out += ("" if left else "\x04") + ch + ("" if right else "\x03")
    return out


def sql_marked(text: str) -> str:
    """Marks around words (1, 2) and around symbols that touch no word (4, 3)."""
    m = rf"regexp_replace({text}, '(\w+)', chr(1) || '\1' || chr(2), 'g')"
    m = rf"regexp_replace({m}, '([^\w\x01\x02])', chr(4) || '\1' || chr(3), 'g')"
    m = f"replace({m}, chr(2) || chr(4), chr(2))"
    return f"replace({m}, chr(3) || chr(1), chr(1))"


def sql_expanded(text: str, entries) -> str:
    """One dictionary pass as nested literal replacements over the marked text."""
    out = sql_marked(text)
    for key, value in entries:
        marked = quoted(_marked_key(key))
        for code in (1, 2, 3, 4):
            marked = marked.replace(chr(code), f"' || chr({code}) || '")
        out = f"replace({out}, {marked}, {quoted(value)})"
    return f"translate({out}, chr(1) || chr(2) || chr(3) || chr(4), '')"


NO_URLS = rf"regexp_replace(text, 'https?://[^{SQL_SPACE}]+|www\.[^{SQL_SPACE}]+', '', 'g')"
EMAIL = r"[a-z0-9.\-+_]+@[a-z0-9.\-+_]+\.[a-z]+"
NO_EMAILS = f"regexp_replace(text, '{EMAIL}', '', 'g')"
PRINTABLE = r"regexp_replace(text, '[^\x20-\x7e\t\n\r\x0b\x0c]', '', 'g')"

CLEANED = ", ".join(
    [
        COMMENTS,
        f"c1 AS (SELECT doc_id, {NO_URLS} AS text FROM raw)",
        f"c2 AS (SELECT doc_id, {NO_EMAILS} AS text FROM c1)",
        f"c3 AS (SELECT doc_id, {PRINTABLE} AS text FROM c2)",
        *[
            f"c{i + 4} AS (SELECT doc_id, {sql_expanded('text', p)} AS text FROM c{i + 3})"
            for i, p in enumerate(lx.SUBSTITUTION_PASSES)
        ],
        "cleaned AS (SELECT doc_id, text FROM c6)",
    ]
)

SIX_LABELS = (
    "six AS (SELECT doc_id, toxic,"
    " CAST(toxic = 1 AND quality = 0 AS INT) AS severe_toxic,"
    " CAST(toxic = 1 AND doc_id % 3 = 0 AS INT) AS obscene,"
    " CAST(toxic = 1 AND doc_id % 5 = 0 AS INT) AS threat,"
    " CAST(toxic = 1 OR doc_id % 7 = 0 AS INT) AS insult,"
    " CAST(toxic = 1 AND doc_id % 4 = 0 AS INT) AS identity_hate FROM labels)"
)

SCORES = (
    SIX_LABELS
    + ", long AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, '{n}' AS label_name, {i + 1} AS ix, {n} AS y FROM six"
        for i, n in enumerate(lx.LABELS)
    )
    + "), preds AS (SELECT doc_id, label_name, y,"
    " ((doc_id * 7919 + ix * 104729) % 700 + 300 * y)::DOUBLE / 1000::DOUBLE AS p FROM long)"
    ", scored AS (SELECT *, CAST(p > 0.5::DOUBLE AS INT) AS yhat FROM preds)"
)


def sql_tokens(text: str) -> str:
    """List of tokens of an ASCII text."""
    apart = rf"regexp_replace({text}, '\b([cC][aA][nN])([nN][oO][tT])\b', '\1 \2', 'g')"
    apart = rf"regexp_replace({apart}, '(\w)([nN]''[tT])\b', '\1 \2', 'g')"
    token = (
        rf"\b(?:Mr|Mrs|Ms|Dr|St|Prof)\.|[nN]''[tT]\b|''(?i:s|re|ve|ll|d|m)\b|\w+|[^\w\s\x0b]"
    )
    return f"regexp_extract_all({apart}, '{token}')"


def sql_words(text: str) -> str:
    """List of words between blanks."""
    return f"regexp_extract_all({text}, '[^{SQL_SPACE}]+')"


def sql_corpus_words(text: str) -> str:
    """List of lower-cased corpus words."""
    spaced = rf"regexp_replace(lower({text}), '[!-&(-/:-@\[-`{{-~\t\n]', ' ', 'g')"
    return f"list_filter(string_split({spaced}, ' '), lambda w: w <> '')"


def sql_sentences(text: str) -> str:
    """List of sentences."""
    guarded = rf"regexp_replace({text}, '\b(Mr|Mrs|Ms|Dr|St|Prof)\.', '\1' || chr(2), 'g')"
    marked = (
        rf"regexp_replace({guarded}, '([.!?]+[\"'')\]]*)[{SQL_SPACE}]+', '\1' || chr(1), 'g')"
    )
    tidy = (
        f"list_transform(string_split({marked}, chr(1)), lambda s:"
        f" regexp_replace(replace(s, chr(2), '.'), '^[{SQL_SPACE}]+|[{SQL_SPACE}]+$', '', 'g'))"
    )
    return f"list_filter({tidy}, lambda s: s <> '')"
