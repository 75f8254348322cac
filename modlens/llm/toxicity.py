"""Toxicity by votes of the nearest labelled examples under exact TF-IDF cosine.

Terms are runs of letters, lower-cased. The vector space holds every term whose presence goes with
the label in a bounded sample of labelled documents, so its size is bounded by the sample's vocabulary; document
frequencies are counted over all documents. The labelled examples form an inverted index in blocks: equal vectors
are held once, with the examples they stand for; vectors that point the same way lie in the same block (some
rounds of spherical k-means order them); a block holds the postings of its own terms, and per term their greatest weight.

Texts are scored in batches. One product of the batch with the greatest weights bounds the cosines of
every text with every block. Each text visits its blocks from the highest bound down, all texts that
are due at a block together, and is done when no other block can hold a nearer example than the ``near`` found.
The nearest examples are exact. Their votes, weighted by cosine, are mapped to a share of toxic documents by a
monotone fit on sampled documents outside the index, each counted as many times as it stands for.
The nearest examples are the evidence.

Defined cases: a null text counts as empty; a text without a term of the space has no neighbours
and gets the share measured for such texts. Without labels of both kinds every score is the share
of toxic labels (0 without labels). Of equally near examples the smaller doc_id goes first. Repeated label rows
count once; a document labelled both ways is two examples at the same place; of rows that share a labelled key one
stands for all. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.llm.common import held_out, table
from modlens.operators.ranking import top_k_per
from modlens.session import checkpointed

TERM = re.compile(r"[^\W\d_]+")
BLOCK = 32
TEXTS = 512  # texts scored together
VISITS = (2, 8, 32, 128)  # blocks visited before the bounds are looked at again


@dataclass(frozen=True)
class ToxicitySettings:
    """The bounded sample (labelled documents per class), terms, and neighbours that vote.

    A term enters when ``least_docs`` sampled documents hold it and the likelihood ratio of its presence
    exceeds ``evidence``. Every ``fit_share``-th sampled document fits the scores; the others are the index.
    """

    per_class: int = 10_000
    evidence: float = 20.0
    least_docs: int = 4
    near: int = 15
    fit_share: int = 3
    cut: float = 0.3


def terms_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return TERM.findall((text or "").lower())


class Index:
    """Block-max inverted index over unit vectors of the examples."""

    def __init__(self, idf: dict[str, float], keys, labels, vectors: list[dict[str, float]], rounds: int = 4):
        self.idf = idf
        self.place = {t: n for n, t in enumerate(sorted(idf))}
        self.visited = self.texts = self.pruned = 0  # blocks visited; texts, and those that left blocks out
        standing: dict[tuple, list[int]] = {}
        for n, vector in enumerate(vectors):
            if vector:
                standing.setdefault(tuple(sorted((self.place[t], w) for t, w in vector.items())), []).append(n)
        distinct = sorted(standing)
        order = self._order(distinct, rounds)
        # Examples of a vector by key; those behind the first ``near`` are never needed, but kept.
        self.examples = [
            sorted((int(keys[n]), float(labels[n])) for n in standing[distinct[i]]) for i in order
        ]
        self.blocks: list[tuple[np.ndarray, np.ndarray]] = []  # terms, weights (terms x vectors)
        self.peaks = np.zeros((len(idf), -(-len(order) // BLOCK)))
        for b in range(self.peaks.shape[1]):
            own = [distinct[i] for i in order[b * BLOCK : (b + 1) * BLOCK]]
            terms = np.array(sorted({t for v in own for t, _ in v}))
            weights = np.zeros((len(terms), BLOCK))
            for n, v in enumerate(own):
                at, w = zip(*v)
                weights[np.searchsorted(terms, at), n] = w
            self.blocks.append((terms, weights))
            self.peaks[terms, b] = weights.max(axis=1)

    def _order(self, distinct: list[tuple], rounds: int) -> np.ndarray:
        """The vectors' numbers, those that point the same way together."""
        many = -(-len(distinct) // BLOCK)
        if many < 2:
            return np.arange(len(distinct))
        rows = np.zeros((len(distinct), len(self.idf)), np.float32)
        for n, v in enumerate(distinct):
            at, w = zip(*v)
            rows[n, list(at)] = w
        centres = rows[np.random.default_rng(1).choice(len(rows), many, replace=False)]
        for _ in range(rounds):
            nearest = np.concatenate([np.argmax(rows[i : i + 1024] @ centres.T, axis=1) for i in range(0, len(rows), 1024)])
            by = np.argsort(nearest, kind="stable")
            first = np.flatnonzero(np.diff(nearest[by], prepend=-1))
            sums = np.add.reduceat(rows[by], first, axis=0)
            centres[nearest[by][first]] = sums / np.linalg.norm(sums, axis=1, keepdims=True)
        return np.argsort(nearest, kind="stable")

    def nearest(self, vectors: list[dict[str, float]], near: int) -> list[list[tuple[float, int, float]]]:
        """Per vector the ``near`` examples of highest positive cosine, as (cosine, key, label)."""
        out = []
        for at in range(0, len(vectors), TEXTS):
            out += self._nearest(vectors[at : at + TEXTS], near)
        return out

    def _nearest(self, vectors, near: int):
        n, blocks = len(vectors), self.peaks.shape[1]
        x = np.zeros((n, len(self.idf)))
        for i, v in enumerate(vectors):
            for t, w in v.items():
                if t in self.place:
                    x[i, self.place[t]] = w
        bound = x @ self.peaks
        order = np.argsort(-bound, axis=1, kind="stable")
        scores = np.zeros((n, blocks * BLOCK))
        best = np.zeros((n, near))  # the cosines of the nearest so far
        least = np.zeros(n)
        at = 0
        for to in (*VISITS, blocks):
            to = min(to, blocks)
            if to <= at:
                continue
            due = order[:, at:to]
            value = np.take_along_axis(bound, due, axis=1)
            # A little slack, as sums in another order may differ in the last digits.
            text, nth = np.nonzero((value > 0) & (value >= least[:, None] - 1e-9))
            block = due[text, nth]
            by = np.argsort(block, kind="stable")
            text, block = text[by], block[by]
            for own in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1) if len(block) else []:
                b, rows = int(block[own[0]]), text[own]
                terms, weights = self.blocks[b]
                got = x[np.ix_(rows, terms)] @ weights
                scores[rows, b * BLOCK : (b + 1) * BLOCK] = got
                # A vector counts once here, however many examples stand for it, so the floor is never too high.
                nearer = np.flatnonzero(got.max(axis=1) > least[rows])
                if len(nearer):
                    rows = rows[nearer]
                    best[rows] = np.partition(np.hstack([best[rows], got[nearer]]), BLOCK, axis=1)[:, BLOCK:]
                    least[rows] = best[rows].min(axis=1)
            self.visited += len(block)
            at = to
        return self._named(scores, least, near, bound)

    def _named(self, scores, least, near, bound):
        # Rounded, so that equal cosines tie whatever block they lie in.
        floor = least - 1e-9
        out = []
        for i, row in enumerate(scores):
            found = np.flatnonzero((row > 0) & (row >= floor[i]))
            pairs = [(-round(float(row[v]), 9), k, y) for v in found.tolist() for k, y in self.examples[v][:near]]
            out.append([(-s, k, y) for s, k, y in sorted(pairs)[:near] if s < 0])
            self.texts += 1
            self.pruned += bool(((bound[i] > 0) & (bound[i] < floor[i])).any())
        return out


def unit_vector(counts: dict[str, int], idf: dict[str, float]) -> dict[str, float]:
    """TF-IDF of length one: (1 + ln tf) x idf."""
    raw = {t: (1 + np.log(c)) * idf[t] for t, c in counts.items() if t in idf}
    size = np.sqrt(sum(w * w for w in raw.values()))
    return {t: float(w / size) for t, w in raw.items()}


@dataclass
class Model:
    """Index and monotone map from votes to scores."""

    index: Index
    edges: np.ndarray
    shares: np.ndarray
    without: float
    near: int

    def score(self, counts: list[dict[str, int]]) -> list[tuple[float, list[int]]]:
        """Per text its score and the keys of the nearest examples."""
        out = []
        for found in self.index.nearest([unit_vector(c, self.index.idf) for c in counts], self.near):
            if not found:
                out.append((self.without, []))
                continue
            at = np.searchsorted(self.edges, votes(found), side="right") - 1
            out.append((float(self.shares[max(at, 0)]), [k for _, k, _ in found]))
        return out


def votes(found: list[tuple[float, int, float]]) -> float:
    """Share of the label among the neighbours, by squared cosine."""
    return sum(s * s * y for s, _, y in found) / sum(s * s for s, _, _ in found)


def monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps fitted to weighted 0/1 outcomes: lower edges and levels."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # [edge, weighted ones, weight]
    for i in order:
        if pools and pools[-1][0] == x[i]:
            pools[-1][1] += weight[i] * y[i]
            pools[-1][2] += weight[i]
        else:
            pools.append([x[i], weight[i] * y[i], weight[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1][1] += last[1]
            pools[-1][2] += last[2]
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


def train(docs: DataFrame, labels: DataFrame, s: ToxicitySettings) -> Model:
    """Sample, terms, frequencies, index and scores."""
    spark = docs.sparkSession
    spot = F.xxhash64("doc_id")
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select("doc_id", F.col("toxic").cast("int").alias("toxic"), spot.alias("spot")).distinct()
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = top_k_per(known, ["toxic"], [F.col("spot").asc(), F.col("doc_id").asc()], s.per_class)
    # At most two times per_class rows of 24 bytes.
    chosen = F.broadcast(checkpointed(chosen.select("doc_id", "toxic", "spot")))

    def present(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words = [], []
            for n, text in enumerate(batch.column("text").to_pylist()):
                own = Counter(terms_of(text))
                keys += [n] * len(own)
                words += list(own.items())
            take = batch.select(["doc_id", "toxic", "spot"]).take(pa.array(keys, pa.int32()))
            two = [pa.array([w for w, _ in words], pa.string()), pa.array([c for _, c in words], pa.int64())]
            yield pa.RecordBatch.from_arrays([*take.columns, *two], ["doc_id", "toxic", "spot", "term", "n"])

    schema = "doc_id long, toxic int, spot long, term string, n long"
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").mapInArrow(present, schema)
    rows = checkpointed(rows)
    size = {0: min(sizes.get(0, 0), s.per_class), 1: min(sizes.get(1, 0), s.per_class)}
    base = sizes.get(1, 0) / max(1, sum(sizes.values()))
    flat = Model(Index({}, [], [], []), np.zeros(1), np.full(1, base), base, s.near)
    if not size[0] or not size[1]:
        return flat
    one = lambda y: F.count(F.when(F.col("toxic") == y, 1))
    counted = rows.groupBy("term").agg(one(1).alias("a"), one(0).alias("b"))
    counted = counted.filter(F.col("a") + F.col("b") >= s.least_docs)
    g = _g_square(F.col("a"), F.col("b"), size[1], size[0])
    best = counted.withColumn("g", g).filter(F.col("g") >= s.evidence).orderBy(F.col("g").desc(), "term")
    # Terms of the sample, each held by some of its documents.
    vocabulary = [r["term"] for r in best.collect()]
    if not vocabulary:
        return flat
    idf = frequencies(docs, vocabulary)
    wanted = spark.createDataFrame([(t,) for t in vocabulary], "term string")
    # Of rows that share a labelled key, one stands for all: the longest counts of each term.
    inside = rows.join(wanted, "term").groupBy("doc_id", "toxic", "spot", "term")
    pairs = inside.agg(F.max("n").alias("n")).groupBy("doc_id", "toxic", "spot")
    vectors = pairs.agg(F.map_from_entries(F.collect_list(F.struct("term", "n"))).alias("counts"))
    held = vectors.collect()  # at most two times per_class rows, each with some terms of the space
    held.sort(key=lambda r: (r["spot"], r["doc_id"], r["toxic"]))
    fits = [r for r in held if r["spot"] % s.fit_share == 0]
    kept = [r for r in held if r["spot"] % s.fit_share]
    index = Index(
        idf, [r["doc_id"] for r in kept], [r["toxic"] for r in kept], [unit_vector(r["counts"], idf) for r in kept]
    )
    stands_for = {y: sizes[y] / size[y] for y in (0, 1)}
    near = index.nearest([unit_vector(r["counts"], idf) for r in fits], s.near)
    voted = [(votes(f), r["toxic"], stands_for[r["toxic"]]) for f, r in zip(near, fits) if f]
    # Sampled documents without a term of the space, by class.
    lettered = Counter(r["toxic"] for r in held)
    none = {y: (size[y] - lettered[y]) * stands_for[y] for y in (0, 1)}
    without = none[1] / max(1.0, none[0] + none[1])
    if not voted:
        return flat
    edges, shares = monotone(*(np.array(c, float) for c in zip(*voted)))
    return Model(index, edges, shares, without, s.near)


def _g_square(a, b, n_a: int, n_b: int):
    total = F.lit(float(n_a + n_b))
    seen = a + b

    def part(got, size: int, all_):
        expected = F.lit(float(size)) * all_ / total
        return F.when(got > 0, 2 * got * F.log(got / expected)).otherwise(0.0)

    return (
        part(a, n_a, seen) + part(b, n_b, seen)
        + part(F.lit(n_a) - a, n_a, total - seen) + part(F.lit(n_b) - b, n_b, total - seen)
    )


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Inverse document frequency of the terms, counted over all documents; summed per task first."""
    wanted = frozenset(vocabulary)

    def run(batches) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        n = 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column("text").to_pylist():
                seen.update(wanted.intersection(terms_of(text)))
        words = [None, *seen]
        counts = [n, *seen.values()]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["term", "n"])

    found = docs.select("text").mapInArrow(run, "term string, n long")
    rows = {r["term"]: r["n"] for r in found.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    total = rows.get(None, 0)
    return {t: float(np.log((1 + total) / (1 + rows.get(t, 0))) + 1) for t in vocabulary}


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and evidence (keys of the nearest examples) of every row; whole texts, in place."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches) -> Iterator[pa.RecordBatch]:
        m = shared.value
        wanted = m.index.idf
        known: dict = {}  # texts with equal terms have equal neighbours
        for batch in batches:
            counts = [Counter(t for t in terms_of(text) if t in wanted) for text in batch.column("text").to_pylist()]
            signs = [frozenset(c.items()) for c in counts]
            fresh = {k: c for k, c in zip(signs, counts) if k not in known}
            if len(known) > 20_000:
                known = {k: known[k] for k in signs if k in known}
            known.update(zip(fresh, m.score(list(fresh.values()))))
            got = [known[k] for k in signs]
            columns = [batch.column("doc_id"), pa.array([s for s, _ in got], pa.float64())]
            columns.append(pa.array([e for _, e in got], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, evidence array<long>")


def op5(spark, folder):
    """Every document's toxicity, learned from the labels that are not held out."""
    s = ToxicitySettings()
    docs = table(spark, folder, "documents")
    model = train(docs, table(spark, folder, "labels"), s)
    out = scored(docs, model)
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= s.cut).cast("int").alias("predicted"),
        "evidence",
    )
