"""Quality scores by a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its distinct words, hashed to ``words`` places and weighted by damped counts of unit length,
and one place for the range in which each of its structure statistics and its ``n_chars`` lies. Every
place has a weight and a vector of ``rank`` numbers; a text's score is the logistic of the sum of its
weights and of the products of its vectors, pair by pair. Their sum needs no pairs: it is half the
square of the sum less the sum of the squares, so a score costs places x rank.

It is learned from a bounded sample of labelled documents in rounds: the sample lies in ``parts``
groups, each a task that follows the gradient from the same start through its rows; the results
are averaged, and the next round starts from there. A part holds a bounded share of the
sample whatever the table's size. Scoring is one pass over the texts.

Defined cases: a null or empty text has statistics of 0 and no words, and is scored like any
other; a null or missing n_chars counts as 0. Without labels of both kinds every score is the
share of good labels (0 without labels). A document labelled both ways is one example of each kind; repeated
label rows count once; of rows that share a labelled key one stands for all. Empty tables give
empty results.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.llm.common import held_out, table
from modlens.llm.words import raw_texts, slices, split_words
from modlens.operators.ranking import top_k_per
from modlens.session import checkpointed

STATISTICS = [
    "words", "bytes", "lines", "word_bytes", "words_a_line", "capitals", "digits", "signs", "symbols", "shouts",
    "blanks", "beyond_ascii", "distinct_words", "distinct_pairs", "top_word", "short_words", "repeated_lines", "n_chars",
]
MOST_WORDS = 500_000  # hashed words a worker keeps


@dataclass(frozen=True)
class QualityModelSettings:
    """Bounded sample (labelled documents per class), places, rank, and how the machine is trained."""

    per_class: int = 10_000
    words: int = 1 << 14
    ranges: int = 12  # per statistic
    rank: int = 8
    parts: int = 8
    rounds: int = 6
    steps: int = 100  # of a part in a round, at least
    batch: int = 32
    rate: float = 0.1
    shrink: float = 1e-4
    seed: int = 5
    cut: float = 0.7

    @property
    def places(self) -> int:
        return self.words + len(STATISTICS) * self.ranges


class Places(dict):
    """Places of words by hash."""

    def __init__(self, places: int):
        super().__init__()
        self.places = places

    def __missing__(self, word):
        if len(self) > MOST_WORDS:
            self.clear()
        n = self[word] = zlib.crc32(word) % self.places
        return n


def _share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


_SIGNS = np.array([0x21 <= b <= 0x7E and not chr(b).isalnum() for b in range(256)])
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_LINE_WORDS = re.compile(rb"[^\s]")


def statistics(raw: bytes, words: list[bytes], distinct: int, top: int, pairs: int, n_chars: int | None) -> list[float]:
    """The structure statistics of a text, in the order of ``STATISTICS``."""
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if _LINE_WORDS.search(x)]
    letters = int(n[0x41:0x5B].sum() + n[0x61:0x7B].sum())
    short = sum(len(w) <= 3 for w in words)
    return [
        np.log1p(len(words)), np.log1p(len(raw)), np.log1p(len(lines)),
        _share(sum(map(len, words)), len(words)), np.log1p(_share(len(words), len(lines))),
        _share(int(n[0x41:0x5B].sum()), letters), _share(int(n[0x30:0x3A].sum()), len(raw)),
        _share(int(n[_SIGNS].sum()), len(raw)), _share(int(n[_SYMBOLS].sum()), len(raw)),
        _share(int(n[0x21]), len(raw)), _share(int(n[0x20] + n[0x0A]), len(raw)),
        _share(int(n[0x80:].sum()), len(raw)), _share(distinct, len(words)),
        _share(pairs, len(words) - 1 if len(words) > 1 else 0), _share(top, len(words)), _share(short, len(words)),
        _share(len(lines) - len(set(lines)), len(lines)), np.log1p(max(0, n_chars or 0)),
    ]


def described(part: pa.RecordBatch, known: Places) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word places and weights of all texts in a row, the end of each text's, and the statistics of each."""
    raws = raw_texts(part.column("text"))
    places, weights, ends, stats, at = [], [], [], [], 0
    for raw, n_chars in zip(raws, part.column("n_chars").to_pylist()):
        words = split_words(raw)
        ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        own, count = np.unique(ids, return_counts=True)
        weight = 1 + np.log(count)
        size = np.sqrt((weight * weight).sum())
        pairs = len(np.unique(ids[:-1] * known.places + ids[1:])) if len(ids) > 1 else 0
        stats.append(statistics(raw, words, len(own), int(count.max(initial=0)), pairs, n_chars))
        places.append(own)
        weights.append(weight / size if size else weight)
        at += len(own)
        ends.append(at)
    return np.concatenate(places), np.concatenate(weights), np.array(ends), np.array(stats)


def place_rows(places, weights, ends, stats, edges: np.ndarray, s: QualityModelSettings):
    """All features of each row: those of its words and one for the range of each statistic."""
    n = len(ends)
    ranges = np.column_stack([np.searchsorted(e, x, "right") for e, x in zip(edges, stats.T)])
    extra = s.words + np.arange(len(STATISTICS)) * s.ranges + ranges
    owner = np.repeat(np.arange(n), np.diff(ends, prepend=0))
    row = np.concatenate([owner, np.repeat(np.arange(n), len(STATISTICS))])
    order = np.argsort(row, kind="stable")
    at = np.concatenate([places, extra.ravel()])[order]
    value = np.concatenate([weights, np.full(extra.size, 1 / np.sqrt(len(STATISTICS)))])[order]
    return at, value, row[order]


@dataclass
class Machine:
    """Share without features, and per place its weight (first) and its vector."""

    bias: float
    table: np.ndarray

    def raw(self, at: np.ndarray, value: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic, and the sums of vectors that the gradient needs.

        ``row`` rises, and every row has a feature.
        """
        own = self.table[at] * value[:, None]
        first = np.searchsorted(row, np.arange(n))
        sums = np.add.reduceat(own, first, axis=0) if len(row) else np.zeros((n, own.shape[1]))
        squares = np.add.reduceat((own[:, 1:] ** 2).sum(axis=1), first) if len(row) else np.zeros(n)
        return self.bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - squares), sums[:, 1:]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def follow(m: Machine, past: np.ndarray, rows: list, s: QualityModelSettings, seed) -> tuple[Machine, np.ndarray]:
    """Passes through the rows (places, weights, y, weight) in small batches, each step damped by past gradients."""
    rng = np.random.default_rng(seed)
    m, past = Machine(m.bias, m.table.copy()), past.copy()
    passes = -(-s.steps * s.batch // len(rows))
    order = np.concatenate([rng.permutation(len(rows)) for _ in range(passes)])
    for at in range(0, len(order), s.batch):
        own = [rows[i] for i in order[at : at + s.batch]]
        place = np.concatenate([r[0] for r in own])
        value = np.concatenate([r[1] for r in own])
        row = np.repeat(np.arange(len(own)), [len(r[0]) for r in own])
        y, w = np.array([r[2] for r in own]), np.array([r[3] for r in own])
        raw, sums = m.raw(place, value, row, len(own))
        g = w * (logistic(raw) - y)
        gv = (g[row] * value)[:, None]
        step = np.hstack([gv, gv * (sums[row] - m.table[place][:, 1:] * value[:, None])])
        by = np.argsort(place, kind="stable")
        first = np.flatnonzero(np.diff(place[by], prepend=-1))
        distinct = place[by][first]
        grad = np.add.reduceat(step[by], first, axis=0) / len(own) + s.shrink * m.table[distinct]
        past[distinct] += grad * grad
        m.table[distinct] -= s.rate * grad / (np.sqrt(past[distinct]) + 1e-6)
        m.bias -= 0.5 * s.rate * float(g.mean())
    return m, past


@dataclass
class QualityModel:
    """A machine with the ranges of the statistics; without one a constant."""

    machine: Machine | None
    edges: np.ndarray | None
    share: float
    settings: QualityModelSettings


def with_metadata(docs: DataFrame) -> DataFrame:
    """The inputs of a score: the text, and n_chars where the table has it."""
    n = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", n.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, s: QualityModelSettings = QualityModelSettings()) -> QualityModel:
    """Sample, ranges of the statistics, and the rounds."""
    spark = docs.sparkSession
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).distinct()
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    total = sum(sizes.values())
    flat = QualityModel(None, None, sizes.get(1, 0) / max(1, total), s)
    if len(sizes) < 2:
        return flat
    spot = F.xxhash64("doc_id", F.lit(s.seed))
    chosen = top_k_per(known, ["y"], [spot.asc(), F.col("doc_id").asc()], s.per_class).select("doc_id", "y")
    # At most twice per_class rows of two numbers.
    chosen = F.broadcast(checkpointed(chosen))

    def describe(batches) -> Iterator[pa.RecordBatch]:
        places = Places(s.words)
        for batch in batches:
            for part in slices(batch):
                place, weight, ends, stats = described(part, places)
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                columns = [
                    part.column("doc_id"), part.column("y"),
                    pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(weight)),
                    pa.array(list(stats), pa.list_(pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "y", "places", "weights", "stats"])

    schema = "doc_id long, y int, places array<int>, weights array<double>, stats array<double>"
    rows = with_metadata(docs).join(chosen, "doc_id").mapInArrow(describe, schema)
    # One row per key, chosen before the shuffle; the group of a row follows from its key.
    one = F.min(F.struct("stats", "places", "weights")).alias("f")
    rows = rows.groupBy("doc_id", "y").agg(one).select("doc_id", "y", "f.*")
    rows = checkpointed(rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(s.parts))))
    found = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(found) < 2:
        return flat
    flat_stats = rows.select(*[F.col("stats")[i].alias(n) for i, n in enumerate(STATISTICS)])
    shares = [i / s.ranges for i in range(1, s.ranges)]
    edges = np.array(flat_stats.approxQuantile(STATISTICS, shares, 1e-3))
    # An example stands for as many labels as the sample left out of its class.
    stands = {y: sizes[y] / found[y] * sum(found.values()) / total for y in (0, 1)}

    rng = np.random.default_rng(s.seed)
    start = np.zeros((s.places, 1 + s.rank))
    start[:, 1:] = rng.normal(0, 0.05, (s.places, s.rank))
    m = Machine(float(np.log(sizes[1] / sizes[0])), start)
    past = np.full_like(start, 1e-3)
    for turn in range(s.rounds):
        shared = spark.sparkContext.broadcast((m, past))

        def one_part(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["doc_id", "y"], ignore_index=True)
            ends = np.cumsum(pdf["places"].map(len).to_numpy())
            stats = np.stack(pdf["stats"].to_list())
            at, value, row = place_rows(
                np.concatenate(pdf["places"].to_list()), np.concatenate(pdf["weights"].to_list()), ends, stats, edges, s
            )
            cuts = np.searchsorted(row, np.arange(1, len(pdf)))
            y = pdf["y"].to_numpy()
            own = list(zip(np.split(at, cuts), np.split(value, cuts), y, [stands[int(v)] for v in y]))
            got, seen = follow(*shared.value, own, s, [s.seed, turn, int(pdf["part"][0])])
            return pd.DataFrame(
                {"n": [len(pdf)], "bias": [got.bias], "table": [got.table.astype("<f4").tobytes()], "past": [seen.astype("<f4").tobytes()]}
            )

        # Dealt by a fixed number, as the groups are small in bytes but long in work.
        dealt = rows.repartition(4 * s.parts, "part")
        got = dealt.groupBy("part").applyInPandas(one_part, "n long, bias double, table binary, past binary").collect()
        # One machine per part, averaged by its rows.
        n = np.array([r["n"] for r in got], float)
        n /= n.sum()
        mean = lambda name: sum(
            w * np.frombuffer(r[name], "<f4").astype(float).reshape(start.shape) for w, r in zip(n, got)
        )
        m = Machine(float(sum(w * r["bias"] for w, r in zip(n, got))), mean("table"))
        past = mean("past")
        shared.unpersist()
    return QualityModel(m, edges, flat.share, s)


def scored(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score of every row; whole texts, in place."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches) -> Iterator[pa.RecordBatch]:
        q = shared.value
        places = Places(q.settings.words)
        for batch in batches:
            for part in slices(batch):
                if q.machine is None:
                    score = np.full(part.num_rows, q.share)
                else:
                    at, value, row = place_rows(*described(part, places), q.edges, q.settings)
                    score = logistic(q.machine.raw(at, value, row, part.num_rows)[0])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return with_metadata(docs).mapInArrow(run, "doc_id long, score double")


def op11(spark, folder):
    """Every document's quality, learned from the labels that are not held out."""
    s = QualityModelSettings()
    docs = table(spark, folder, "documents")
    out = scored(docs, train(docs, table(spark, folder, "labels"), s))
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= s.cut).cast("int").alias("predicted"),
    )
