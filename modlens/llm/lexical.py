"""Ranked lexical search over an index whose documents are stratified by their length normaliser.

A score is the sum of w * ((10^9 tf) div (1000 tf + k1 m)) over the terms of an item, where ``m`` depends
on the length of the document alone. The documents of an index block are therefore grouped by
equal ``m``; inside such a stratum a term's postings are sorted by tf, so that its impact is
computed once for each tf and not for each posting. The impact of a stratum's greatest tf, summed
over the terms of an item, bounds the scores of the stratum. Strata are visited from the highest
bound down, some hundred documents at a time, until no bound reaches the score of the last of the ``k``
documents found so far.

One pass over the texts keeps per document its length and its postings of the terms asked for;
N, L and df are sums over that table. Every task then builds blocks of bounded size, searches them
for all items and hands on at most ``k`` documents per item; these meet in two steps. Items are
worked off in groups whose texts are bounded together, as each task holds the terms of a group.

Defined cases: a null or wordless text is no document in the sense of N and is never found. Items
without a term get no rows; rows that share an item_id are one item with the terms of all. Rows
that share a doc_id are documents of their own; a null doc_id goes last among equal scores. Empty
tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.llm.common import UPPER, table
from modlens.llm.words import raw_texts, slices, spans, split_words
from modlens.operators.ranking import top_k_per
from modlens.session import checkpointed

POSTINGS = "doc_id long, n long, terms array<int>, tfs array<int>"
FOUND = "item long, doc_id long, score long"


@dataclass(frozen=True)
class SearchSettings:
    """Rows per item, shape of the score, and bounds of what a task holds."""

    k: int = 50
    b: int = 50  # weight of the length, in percent
    k1: int = 20  # saturation of tf, in tenths of a percent of m
    item_bytes: int = 8 << 20  # text of the items that are searched together
    block_postings: int = 4_000_000
    visit: int = 4096  # documents whose strata are visited together


def weight(n_docs: int, df: int) -> int:
    """Weight of a term held by ``df`` of ``n_docs`` documents."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document with a word: its number of words, and its terms of the vocabulary with their tf."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches) -> Iterator[pa.RecordBatch]:
        number = shared.value
        width = max(1, len(number))
        for batch in batches:
            for part in slices(batch):
                split = [split_words(t) for t in raw_texts(part.column("text"))]
                n = np.fromiter(map(len, split), np.int64, len(split))
                ids = np.fromiter((number.get(w, -1) for own in split for w in own), np.int64, int(n.sum()))
                key = (np.repeat(np.arange(len(split)), n) * width + ids)[ids >= 0]
                key, tf = np.unique(key, return_counts=True)
                offsets = np.searchsorted(key, np.arange(len(split) + 1) * width).astype(np.int32)
                columns = [
                    part.column("doc_id"), pa.array(n),
                    pa.ListArray.from_arrays(offsets, pa.array((key % width).astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32))),
                ]
                rows = pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])
                yield rows.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, POSTINGS)


def statistics(index: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """N, L, and df of the ``size`` terms; one row per task and term meets in the sums."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        docs, words, df = 0, 0, np.zeros(size, np.int64)
        for batch in batches:
            docs += batch.num_rows
            words += int(np.asarray(batch.column("n")).sum())
            df += np.bincount(np.asarray(batch.column("terms").flatten()), minlength=size)
        terms = np.flatnonzero(df)
        columns = [pa.array([-2, -1, *terms.tolist()], pa.int64()), pa.array([docs, words, *df[terms].tolist()], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["term", "n"])

    found = index.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = np.zeros(size, np.int64)
    sums = {r["term"]: r["n"] for r in found.collect()}  # two rows and one per term asked for
    for t, n in sums.items():
        if t >= 0:
            df[t] = n
    return sums.get(-2, 0), sums.get(-1, 0), df


class Block:
    """Documents in strata of equal ``m``, with postings by term, stratum and tf."""

    def __init__(self, keys, n, counts, terms, tfs, weights, n_docs, n_words, s: SearchSettings):
        lengths, at = np.unique(n, return_inverse=True)
        # In Python's integers, as the product outgrows 64 bits before the quotient does.
        m_of = np.array([100 - s.b + (s.b * int(x) * n_docs) // n_words for x in lengths], np.int64)
        self.m, stratum = np.unique(m_of[at], return_inverse=True)
        order = np.argsort(stratum, kind="stable")
        self.keys = keys[order]
        self.start = np.searchsorted(stratum[order], np.arange(len(self.m) + 1))
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(n))
        doc = np.repeat(place, counts)
        of = np.repeat(stratum, counts)
        by = np.lexsort((tfs, of, terms))
        term, of, tf, doc = terms[by], of[by], tfs[by].astype(np.int64), doc[by]
        segment = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (of[1:] != of[:-1])]))[: len(term)]
        run = np.concatenate([[True], tf[1:] != tf[:-1]])[: len(term)]
        run[segment] = True
        run = np.flatnonzero(run)
        # One impact for all postings of a term with the same tf in a stratum.
        value = weights[term[run]] * ((1_000_000_000 * tf[run]) // (1000 * tf[run] + s.k1 * self.m[of[run]]))
        size = np.diff(np.append(run, len(term)))
        self.value = np.repeat(value, size)
        self.doc = doc - self.start[of] if len(of) else doc  # place in its stratum
        self.seg_at, self.seg_of = segment, of[segment]
        self.seg_size = np.diff(np.append(segment, len(term)))
        # Impacts rise with tf, so a segment's last posting holds its peak.
        self.seg_peak = self.value[segment + self.seg_size - 1]
        self.first = np.searchsorted(term[segment], np.arange(len(weights) + 1))

    def search(self, terms: np.ndarray, top: list[tuple[int, int]], s: SearchSettings) -> tuple[list[tuple[int, int]], int]:
        """The ``k`` best (-score, key) of ``top`` and this block, and the number of documents scored."""
        segs = spans(self.first[terms], self.first[terms + 1] - self.first[terms])
        bound = np.bincount(self.seg_of[segs], self.seg_peak[segs], len(self.m))
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        if not len(order):
            return top, 0
        rank = np.full(len(self.m), len(order))
        rank[order] = np.arange(len(order))
        segs = segs[bound[self.seg_of[segs]] > 0]
        segs = segs[np.argsort(rank[self.seg_of[segs]], kind="stable")]
        docs = np.diff(self.start)[order]
        before = np.concatenate([[0], np.cumsum(docs)])
        edge = np.searchsorted(rank[self.seg_of[segs]], np.arange(len(order) + 1))
        at, scored, step = 0, 0, s.visit // 8
        while at < len(order):
            least = -top[-1][0] if len(top) == s.k else 1
            if bound[order[at]] < least:
                break
            # Strata for some documents at once, but none that cannot hold a result.
            to = max(at + 1, int(np.searchsorted(before, before[at] + step, "right")) - 1)
            to = at + max(1, int(np.searchsorted(-bound[order[at:to]], -least, "right")))
            step = s.visit
            own = segs[edge[at] : edge[to]]
            base = before[rank[self.seg_of[own]]] - before[at]
            where = spans(self.seg_at[own], self.seg_size[own])
            place = self.doc[where] + np.repeat(base, self.seg_size[own])
            # Sums stay below 2^53, so they are exact in doubles.
            score = np.bincount(place, self.value[where], int(before[to] - before[at]))
            scored += len(score)
            found = np.flatnonzero(score >= least)
            if len(found):
                of = np.searchsorted(before, found + before[at], "right") - 1
                keys = self.keys[self.start[order[of]] + found + before[at] - before[of]]
                if len(found) > s.k:
                    cut = np.partition(score[found], len(found) - s.k)[len(found) - s.k]
                    keep = score[found] >= cut
                    found, keys = found[keep], keys[keep]
                best = np.lexsort((keys, -score[found]))[: s.k]
                top = sorted(top + [(-int(score[found[i]]), int(keys[i])) for i in best])[: s.k]
            at = to
        return top, scored


NO_KEY = np.iinfo(np.int64).max  # stands for a null key, which goes last


def best_of_blocks(index: DataFrame, wanted: list[np.ndarray], stats: tuple[int, int, np.ndarray], s: SearchSettings) -> DataFrame:
    """Per task at most ``k`` documents of each item, by number of the item."""
    n_docs, n_words, df = stats
    if not n_docs:
        return index.sparkSession.createDataFrame([], FOUND)
    weights = np.array([weight(n_docs, int(d)) for d in df], np.int64)
    shared = index.sparkSession.sparkContext.broadcast((wanted, weights))

    def run(batches) -> Iterator[pa.RecordBatch]:
        items, w = shared.value
        tops: list[list[tuple[int, int]]] = [[] for _ in items]

        def work(held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            own, tfs = rows.column("terms").combine_chunks(), rows.column("tfs").combine_chunks()
            keys = rows.column("doc_id").fill_null(NO_KEY).to_numpy()
            block = Block(
                keys, rows.column("n").to_numpy(), own.value_lengths().to_numpy(), own.flatten().to_numpy(),
                tfs.flatten().to_numpy(), w, n_docs, n_words, s,
            )
            for i, terms in enumerate(items):
                tops[i], _ = block.search(terms, tops[i], s)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column("terms").flatten()) + batch.num_rows
            if size >= s.block_postings:
                work(held)
                held, size = [], 0
        if held:
            work(held)
        rows = [(i, None if d == NO_KEY else d, -v) for i, top in enumerate(tops) for v, d in top]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["item", "doc_id", "score"])

    return index.mapInArrow(run, FOUND)


def item_groups(items: DataFrame, s: SearchSettings) -> Iterator[dict]:
    """Items as {item_id: terms}, in groups whose texts are bounded together."""
    rows = items.filter(F.col("text").isNotNull()).select("item_id", F.col("text").cast("binary").alias("raw"))
    size = rows.agg(F.sum(F.length("raw"))).first()[0] or 0
    groups = max(1, -(-size // s.item_bytes))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("item_id"), F.lit(groups)))
    for g in range(groups):
        found: dict = {}
        for r in rows.filter(F.col("grp") == g).toLocalIterator():
            found.setdefault(r["item_id"], set()).update(split_words(bytes(r["raw"])))
        yield {k: v for k, v in found.items() if v}


def search(docs: DataFrame, items: DataFrame, s: SearchSettings = SearchSettings()) -> DataFrame:
    """item_id, rank, doc_id and score of each item's best documents."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType
    every = None
    for group in item_groups(items, s):
        vocabulary = {t: n for n, t in enumerate(sorted(set().union(*group.values())))}
        keys = list(group)
        wanted = [np.array(sorted(vocabulary[t] for t in group[k]), np.int64) for k in keys]
        found, n_docs = spark.createDataFrame([], FOUND), 0
        if keys:
            index = checkpointed(postings(docs, vocabulary))
            stats = statistics(index, len(vocabulary))
            n_docs = stats[0]
            found = best_of_blocks(index, wanted, stats, s)
        # The numbers of one group's items, whose texts are bounded.
        names = spark.createDataFrame(list(enumerate(keys)), f"item long, item_id {kind.simpleString()}")
        found = meet(found, n_docs, s).join(names, "item")
        every = found if every is None else every.unionByName(found)
    return every.select("item_id", "rank", "doc_id", "score")


def meet(found: DataFrame, n_docs: int, s: SearchSettings) -> DataFrame:
    """The ``k`` best per item; where many documents give many tasks, shares of their rows meet first."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    shares = -(-n_docs // 5_000_000)
    if shares > 1:
        found = found.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(shares)))
        found = top_k_per(found, ["item", "share"], order, s.k).drop("share", "rank")
    return top_k_per(found, ["item"], order, s.k)


def op12(spark, folder):
    """The 50 best documents of all for each benchmark item."""
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_WORDS = rf"regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents WHERE text IS NOT NULL),
w AS (SELECT r, doc_id, unnest(words) AS term FROM d),
sizes AS (SELECT count(*)::BIGINT AS nn, sum(len(words))::BIGINT AS ll FROM d WHERE len(words) > 0),
q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT r, doc_id, term, count(*)::BIGINT AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY ALL),
t AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
  FROM p, sizes GROUP BY term),
m AS (SELECT r, 100 - 50 + ((50 * len(words) * nn) // ll) AS m FROM d, sizes WHERE len(words) > 0),
s AS (SELECT item_id, doc_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN t USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank,
  doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50
"""
