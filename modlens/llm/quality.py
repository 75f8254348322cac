"""Quality rules with thresholds learned from mergeable quantile sketches per language and source.

Main path: DataFrame functions only. One pass over the texts counts words, symbols, repeated lines
and repeated 3-word windows inside each row; the integers are written to the shared folder. A
sketch is a histogram over buckets that are exact below 64 and 1/32 wide above: it merges by adding
counts, so a hot source is summed per partition before it is shuffled, and the sketch of a language
is the sum of the sketches of its sources. Thresholds are read off the sketches and joined back on
(language, source).

Defined cases: a null text has no words, lines or symbols and fails the base rule, as an empty one
does. A null language or source is a group of its own. Repeated rows are judged row by row. An
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modlens.functions.arrays import let, with_fields
from modlens.llm.common import SPACE, keep_documents, same_keys, table
from modlens.session import checkpointed

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# Judged per document, in thousandths; word length in tenths of a character.
RATES = ["symbol_rate", "dup_line_rate", "repeat_rate", "word_length"]


@dataclass(frozen=True)
class QualitySettings:
    """How far beyond its group's quantiles a document may lie.

    A rate may reach ``high`` quantile + ``spread`` x (high quantile - median), and at least
    ``slack``; the word length must lie within the same distance on both sides. Groups of fewer
    than ``least_rows`` judged documents use the sketch of their language, small languages that of
    all documents.
    """

    least_words: int = 50
    most_repeated: int = 50  # percent of words
    high: int = 75  # percent
    low: int = 25
    spread: int = 3
    slack_symbols: int = 200
    slack_lines: int = 500
    slack_repeats: int = 300
    slack_length: int = 20
    least_rows: int = 200


def text_counts(text: Column) -> dict[str, Column]:
    """Word, symbol, line and repeat counts of a text (null counts as empty)."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(t, SPACE + "+", "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long"),
        "n_repeat_words": let(words, repeated_words).cast("long"),
    }


def repeated_words(words: Column) -> Column:
    """Number of words that lie in a 3-word window found twice or more.

    Windows are compared by their 64-bit hash; positions of equal windows come out of one sort, so
    a text of n words costs n log n steps whatever repeats in it.
    """
    n = F.size(words)
    hashes = F.transform(
        F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )
    return let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(
            let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), _covered)
        ),
    )


def _covered(ordered: Column) -> Column:
    def twin(e: Column, i: Column) -> Column:
        before, after = F.get(ordered, i - 1)["h"], F.get(ordered, i + 1)["h"]
        return F.coalesce(e["h"] == before, F.lit(False)) | F.coalesce(e["h"] == after, F.lit(False))

    starts = F.sort_array(F.transform(F.filter(ordered, twin), lambda e: e["i"]))
    # Windows are 3 long: each start adds what lies beyond the window before it.
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")),
        lambda a: a["n"],
    )


def bucket(value: Column) -> Column:
    """Lower edge of the sketch bucket of a non-negative integer: exact below 64, then 6 leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.expr("0L") + F.call_function(
        "shiftleft", F.call_function("shiftright", value, shift), shift
    )


def rates(s: QualitySettings) -> dict[str, Column]:
    """The judged rates from the counts; null for a document that fails the base rule."""
    ok = ~F.col("base_failed")
    per_word = lambda c, by: F.expr(f"({c} * {by}) div greatest(n_words, 1)")
    return {
        "symbol_rate": F.when(ok, per_word("n_symbols", 1000)),
        "dup_line_rate": F.when(ok, F.expr("(n_dup_lines * 1000) div greatest(n_lines, 1)")),
        "repeat_rate": F.when(ok, per_word("n_repeat_words", 1000)),
        "word_length": F.when(ok, per_word("word_chars", 10)),
    }


def sketches(judged: DataFrame) -> DataFrame:
    """Quantile sketches: (lang, source, rate, bucket, n), summed per partition first."""
    long = judged.filter(~F.col("base_failed")).unpivot(["lang", "source"], RATES, "rate", "value")
    return long.groupBy("lang", "source", "rate", bucket(F.col("value")).alias("bucket")).agg(
        F.count("*").alias("n")
    )


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of coarser groups: counts added up."""
    return sketch.groupBy(*by, "rate", "bucket").agg(F.sum("n").alias("n"))


def limits(sketch: DataFrame, by: list[str], s: QualitySettings) -> DataFrame:
    """Per group: number of documents and, for each rate, the lowest and highest value allowed.

    A running sum over the buckets of one group gives its quantiles; a group has at most some
    2,000 buckets whatever its number of documents.
    """
    w = Window.partitionBy(*by, "rate")
    seen = F.sum("n").over(w.orderBy("bucket"))
    total = F.sum("n").over(w)
    q = lambda p: F.min(F.when(F.col("seen") * 100 >= F.col("total") * p, F.col("bucket")))
    per_rate = (
        sketch.withColumns({"seen": seen, "total": total})
        .groupBy(*by, "rate")
        .agg(F.max("total").alias("total"), q(s.low).alias("lo"), q(50).alias("mid"), q(s.high).alias("hi"))
        .withColumn("top", F.col("hi") + s.spread * (F.col("hi") - F.col("mid")))
        .withColumn("bottom", F.col("lo") - s.spread * (F.col("mid") - F.col("lo")))
    )
    slack = {"symbol_rate": s.slack_symbols, "dup_line_rate": s.slack_lines, "repeat_rate": s.slack_repeats}
    at = lambda r, c: F.max(F.when(F.col("rate") == r, F.col(c)))
    tops = [F.greatest(at(r, "top"), F.lit(v)).alias(f"top_{r}") for r, v in slack.items()]
    length = [
        (at("word_length", "top") + s.slack_length).alias("top_word_length"),
        (at("word_length", "bottom") - s.slack_length).alias("bottom_word_length"),
    ]
    return per_rate.groupBy(*by).agg(F.max("total").alias("group_rows"), *tops, *length)


def counted(docs: DataFrame, s: QualitySettings) -> DataFrame:
    """doc_id, lang, source and the counts and rates of every row, written to the shared folder."""
    base = docs.select("doc_id", "lang", "source", "text")
    rows = with_fields(base, text_counts(F.col("text"))).drop("text")
    failed = (F.col("n_words") < s.least_words) | (
        100 * F.col("n_repeat_words") > s.most_repeated * F.col("n_words")
    )
    return checkpointed(rows.withColumn("base_failed", failed).withColumns(rates(s)))


def judge(docs: DataFrame, s: QualitySettings = QualitySettings()) -> DataFrame:
    """Counts, rates, the limits of the document's group, and ``kept`` for every row."""
    judged = counted(docs, s)
    # Small beside the rows it sums up, and read for three kinds of groups.
    fine = checkpointed(sketches(judged))
    by_lang = merged(fine, ["lang"])
    own = limits(fine, ["lang", "source"], s)
    lang = limits(by_lang, ["lang"], s)
    everything = limits(merged(by_lang, []).withColumn("one", F.lit(1)), ["one"], s).drop("one")
    names = everything.columns
    lang = lang.withColumnsRenamed({c: f"lang_{c}" for c in names})
    # One row: the limits over all documents, for languages with few of them.
    one = everything.first()
    whole = {c: F.lit(one[c] if one else 0) for c in names}
    groups = same_keys(own, lang, ["lang"], "left")
    for c in names[1:]:
        groups = groups.withColumn(
            c,
            F.when(F.col("group_rows") >= s.least_rows, F.col(c))
            .when(F.col("lang_group_rows") >= s.least_rows, F.col(f"lang_{c}"))
            .otherwise(whole[c]),
        )
    groups = groups.drop(*[f"lang_{c}" for c in names])
    out = same_keys(judged, groups, ["lang", "source"], "left")
    beyond = (
        (F.col("word_length") > F.col("top_word_length"))
        | (F.col("word_length") < F.col("bottom_word_length"))
        | (F.col("symbol_rate") > F.col("top_symbol_rate"))
        | (F.col("dup_line_rate") > F.col("top_dup_line_rate"))
        | (F.col("repeat_rate") > F.col("top_repeat_rate"))
    )
    return out.withColumn("kept", ~(F.col("base_failed") | F.coalesce(beyond, F.lit(False))))


def good_documents(docs: DataFrame, s: QualitySettings = QualitySettings()) -> DataFrame:
    """The documents that are kept, all columns; rows that share a doc_id stay if one of them does."""
    return keep_documents(docs, judge(docs, s).filter("kept"))


def op10(spark, folder):
    """Every document judged."""
    return judge(table(spark, folder, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")


_S = QualitySettings()
_LIMITS = """
 {name}_run AS (SELECT {by}, rate, bucket, sum(n) OVER (PARTITION BY {by}, rate ORDER BY bucket) AS seen,
   sum(n) OVER (PARTITION BY {by}, rate) AS total FROM {name}),
 {name}_q AS (SELECT {by}, rate, max(total) AS total, min(bucket) FILTER (seen * 100 >= total * 25) AS lo,
   min(bucket) FILTER (seen * 100 >= total * 50) AS mid, min(bucket) FILTER (seen * 100 >= total * 75) AS hi
   FROM {name}_run GROUP BY {by}, rate),
 {name}_lim AS (SELECT {by}, max(total) AS rows_,
   greatest(max(hi + 3 * (hi - mid)) FILTER (rate = 'symbol_rate'), 200) AS t1,
   greatest(max(hi + 3 * (hi - mid)) FILTER (rate = 'dup_line_rate'), 500) AS t2,
   greatest(max(hi + 3 * (hi - mid)) FILTER (rate = 'repeat_rate'), 300) AS t3,
   max(hi + 3 * (hi - mid)) FILTER (rate = 'word_length') + 20 AS t4,
   max(lo - 3 * (mid - lo)) FILTER (rate = 'word_length') - 20 AS t5
   FROM {name}_q GROUP BY {by})"""

SQL = rf"""
WITH base AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
 split_ AS (SELECT doc_id, lang, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
   list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l FROM base),
 wins AS (SELECT *, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g
   FROM split_),
 numbered AS (SELECT row_number() OVER () AS r, * FROM wins),
 gram AS (SELECT r, unnest(g) AS gram, unnest(range(1, len(g) + 1)) AS i FROM numbered),
 twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM gram),
 hit AS (SELECT DISTINCT r, i + j AS p FROM twice, (SELECT unnest([0, 1, 2]) AS j) WHERE c > 1),
 hits AS (SELECT r, count(*) AS n FROM hit GROUP BY r),
 counts AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
   CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
   CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
   CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
   CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM numbered LEFT JOIN hits USING (r)),
 failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
 rated AS (SELECT *, n_symbols * 1000 // greatest(n_words, 1) AS symbol_rate,
   n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_line_rate,
   n_repeat_words * 1000 // greatest(n_words, 1) AS repeat_rate,
   word_chars * 10 // greatest(n_words, 1) AS word_length FROM failed),
 long AS (SELECT lang, source, unnest(['symbol_rate', 'dup_line_rate', 'repeat_rate', 'word_length']) AS rate,
   unnest([symbol_rate, dup_line_rate, repeat_rate, word_length]) AS v FROM rated WHERE NOT base_failed),
 fine AS (SELECT lang, source, rate,
   (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bucket, count(*) AS n
   FROM long GROUP BY ALL),
 by_lang AS (SELECT lang, rate, bucket, sum(n) AS n FROM fine GROUP BY ALL),
 every AS (SELECT 1 AS one, rate, bucket, sum(n) AS n FROM fine GROUP BY ALL),
 {_LIMITS.format(name="fine", by="lang, source")},
 {_LIMITS.format(name="by_lang", by="lang")},
 {_LIMITS.format(name="every", by="one")},
 lim AS (SELECT f.lang, f.source, {", ".join(
     f"CASE WHEN f.rows_ >= 200 THEN f.t{i} WHEN b.rows_ >= 200 THEN b.t{i} ELSE e.t{i} END AS t{i}"
     for i in range(1, 6))}
   FROM fine_lim f LEFT JOIN by_lang_lim b ON f.lang IS NOT DISTINCT FROM b.lang, every_lim e)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR coalesce(word_length > t4 OR word_length < t5 OR symbol_rate > t1 OR dup_line_rate > t2
  OR repeat_rate > t3, false)) AS kept
FROM rated r LEFT JOIN lim ON r.lang IS NOT DISTINCT FROM lim.lang AND r.source IS NOT DISTINCT FROM lim.source
"""
