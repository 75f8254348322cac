"""Documents drawn by how much more likely their word runs are in a target than in the corpus.

Features are runs of one and two words, each hashed to a bucket by the crc32 of its bytes. A bucket's
gain is the logarithm of its smoothed share in the target over its share in the corpus; a
document's weight is the mean gain of its features. Gumbel noise from a hash of the key turns the
largest scores into a draw without replacement in proportion to the weights.

The checksums are made in matrices: the distinct features of some hundred texts are grouped by
their length in bytes, the features of a length stand in one two-dimensional uint8 array, and the
checksums of all its rows advance column by column; the buckets are scattered back to the
features' places. Single features of more than ``LONG`` bytes, whose matrix would be one wide row each,
are summed one by one.

The corpus counts are one row per task and bucket before they meet; the second pass reads the
texts again, which is cheaper than keeping a bucket for each word. Only rows whose score can be
drawn are ranked: the histogram of the scores (whole numbers in a fixed range) gives the cut and the
ranks before each score, so that ranks are numbered inside one score only.

Defined cases: a null or wordless text has no features and weight 0. A null key counts as the
empty text in the noise; it goes last among equal scores. Rows that share a key are drawn one by
one, equal rows in any order. Without target texts, or in an empty table, gains follow from the
counts of 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modlens.llm.common import UPPER, table
from modlens.llm.words import Numbered, raw_texts, slices, spans, split_words
from modlens.session import checkpointed

LONG = 512


@dataclass(frozen=True)
class DrawSettings:
    """Words per run, buckets, share drawn, fewest words of a drawn document, and seed of the noise."""

    runs: int = 2
    buckets: int = 10_000
    percent: int = 25
    least_words: int = 20
    seed: int = 7


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


CRC = _crc_table()


def checksums(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The crc32 of each feature; ``flat`` holds their bytes, ``size`` their lengths.

    Features of equal length form a matrix, whose columns advance all its checksums together.
    """
    start = np.cumsum(size) - size
    out = np.empty(len(size), np.uint32)
    order = np.argsort(size, kind="stable")
    lengths, first = np.unique(size[order], return_index=True)
    for length, group in zip(lengths.tolist(), np.split(order, first[1:])):
        if length > LONG:
            for i in group:
                out[i] = zlib.crc32(flat[start[i] : start[i] + length])
            continue
        matrix = flat[spans(start[group], size[group])].reshape(len(group), length).T.copy()
        crc = np.full(len(group), 0xFFFFFFFF, np.uint32)
        for column in matrix:
            crc = CRC[(crc ^ column) & 0xFF] ^ (crc >> np.uint32(8))
        out[group] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def features(texts: list[bytes], s: DrawSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of every feature of the texts, and the number of words of each text."""
    index = Numbered()
    split = [split_words(t) for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    word = np.fromiter((index[w] for own in split for w in own), np.int64, int(n.sum()))
    owner = np.repeat(np.arange(len(split)), n)
    # Words with a blank behind them, one after the other.
    buffer = np.frombuffer(b"".join(w + b" " for w in index), np.uint8)
    size = np.fromiter((len(w) + 1 for w in index), np.int64, len(index))
    start = np.cumsum(size) - size
    buckets, owners = [], []
    known, run = np.arange(len(index))[:, None], word
    for width in range(1, s.runs + 1):
        if width > 1:
            # A run is the number of a shorter run and of the word behind it, in the same text.
            inside = owner[width - 1 :] == owner[: len(owner) - width + 1]
            pair = run[: len(word) - width + 1] * max(1, len(index)) + word[width - 1 :]
            pair = np.where(inside, pair, -1)
            distinct, at = np.unique(pair, return_inverse=True)
            gone = len(distinct) > 0 and distinct[0] == -1
            distinct = distinct[1:] if gone else distinct
            run = at - 1 if gone else at
            known = np.column_stack([known[distinct // max(1, len(index))], distinct % max(1, len(index))])
        if not len(known):
            break
        long = size[known].sum(axis=1)
        flat = buffer[spans(start[known].ravel(), size[known].ravel())]
        # The blank behind the last word is left out.
        keep = np.ones(len(flat), bool)
        keep[np.cumsum(long) - 1] = False
        bucket = checksums(flat[keep], long - 1) % s.buckets
        real = run >= 0
        buckets.append(bucket[run[real]].astype(np.int64))
        owners.append(owner[: len(run)][real])
        if width > 1:
            # A run that leaves its text ends here; longer ones would leave it too.
            run = np.where(real, run, 0)
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n
    return np.concatenate(buckets), np.concatenate(owners), n


def bucket_counts(docs: DataFrame, s: DrawSettings) -> np.ndarray:
    """Features of all texts per bucket."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(s.buckets, np.int64)
        for batch in batches:
            for part in slices(batch):
                found, _, _ = features(raw_texts(part.column("text")), s)
                total += np.bincount(found, minlength=s.buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(s.buckets, np.int64)
    for r in rows.collect():  # one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the thousandfold logarithm of its share in the target over that in the corpus."""
    size = len(corpus)
    above = (target + 1.0) * (float(corpus.sum()) + size)
    below = (corpus + 1.0) * (float(target.sum()) + size)
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, s: DrawSettings) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row; whole texts, in place."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    schema = "doc_id long, n_words long, n_features long, weight long"

    def run(batches) -> Iterator[pa.RecordBatch]:
        value = shared.value
        for batch in batches:
            for part in slices(batch):
                found, owner, n = features(raw_texts(part.column("text")), s)
                many = np.bincount(owner, minlength=len(n))
                # Sums of whole numbers far below 2^53 are exact in doubles.
                total = np.bincount(owner, value[found], len(n)).astype(np.int64)
                columns = [part.column("doc_id"), *map(pa.array, (n, many, total // np.maximum(many, 1)))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def noise(key: Column, s: DrawSettings) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a digest of the key."""
    digest = F.sha2(F.concat(F.lit(f"{s.seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scores: DataFrame, s: DrawSettings) -> DataFrame:
    """The rows with ``rank``, 1 for the highest score; null where a row is not drawn.

    ``scores`` is read several times and should be a written table.
    """
    able = F.col("n_words") >= s.least_words
    hist = scores.filter(able).groupBy("score").agg(F.count("*").alias("n"))
    # A weight lies between the least and the greatest gain and the noise between -3,200 and 22,900,
    # so the histogram has some ten thousand rows whatever the number of documents.
    falling = Window.orderBy(F.col("score").desc())
    hist = hist.select("score", (F.sum("n").over(falling) - F.col("n")).alias("before"))
    quota = (s.percent * scores.filter(able).count()) // 100
    cut = hist.filter(F.col("before") < quota).agg(F.min("score")).first()[0]
    if cut is None:
        return scores.withColumn("rank", F.lit(None).cast("long"))
    near = able & (F.col("score") >= cut)
    inside = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "weight", "n_features")
    placed = scores.filter(near).join(hist, "score")
    placed = placed.withColumn("rank", (F.col("before") + F.row_number().over(inside)).cast("long")).drop("before")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank")))
    rest = scores.filter(~near).withColumn("rank", F.lit(None).cast("long"))
    return placed.select(*rest.columns).unionByName(rest)


def draw(docs: DataFrame, target: DataFrame, s: DrawSettings = DrawSettings()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document."""
    gain = gains(bucket_counts(docs, s), bucket_counts(target, s))
    scores = weighed(docs, gain, s).withColumn("score", F.col("weight") + noise(F.col("doc_id"), s))
    return ranked(checkpointed(scores), s)


def op13(spark, folder):
    """All documents weighed against the benchmark texts, a quarter of them drawn."""
    out = draw(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = rf"regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RUNS = "list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))"
_CRC_STEP = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"


def _crc_sql(feature: str) -> str:
    byte = f"('0x' || substr(hex(encode({feature})), 2 * i + 1, 2))::BIGINT"
    steps = f"list_transform(range(strlen({feature})), lambda i: {byte})"
    fold = f"list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]))"
    return f"xor({fold}, 4294967295)"


SQL = f"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)),
  lambda c, x: {_CRC_STEP})) AS tab),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT unnest({_RUNS}) AS f FROM (SELECT {_WORDS} AS words FROM benchmark)),
f AS (SELECT r, unnest({_RUNS}) AS f FROM d),
dist AS (SELECT DISTINCT f FROM (SELECT f FROM f UNION ALL SELECT f FROM b)),
h AS (SELECT f, {_crc_sql('f')} % 10000 AS bucket FROM dist, tab),
s AS (SELECT bucket, count(*) AS s FROM f JOIN h USING (f) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM b JOIN h USING (f) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE)
  / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM h) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT r, count(*)::BIGINT AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM f JOIN h USING (f) JOIN g USING (bucket) GROUP BY r),
e AS (SELECT r, doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
  + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (r)),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS rank
  FROM e WHERE n_words >= 20
  QUALIFY rank <= (SELECT (25 * count(*)) // 100 FROM e WHERE n_words >= 20))
SELECT doc_id, n_features, weight, score, rank FROM e LEFT JOIN k USING (r)
"""
