"""N-gram Jaccard join of documents on word shingles, with signature trees.

Exact for the similarity asked for, in four steps.

1. Sharing. A document can have a partner only if enough of its shingles occur in another
   document. Every task works on blocks of documents: a block sorts its shingles, counts those that
   two of its documents share, and sends each of its distinct shingles once (some bytes) to the
   shingle's bucket, which answers how many of the block's shingles other blocks hold. A passage in
   very many documents thus sends one row per block. Documents below the bound are done.
2. Candidates. The documents that are left tell their full hashes the same way and get back in how many
   documents each occurs. Of a document's shingles in order from rare to frequent, the prefix that
   every partner must meet is kept; documents that share one are tied to the first of them, and the ties'
   connected components hold all partners of their members.
3. Signature trees. A component is worked off in blocks ordered by set size. Leaves of a tree hold
   documents, nodes the OR of their token bitmaps and the range of their sizes. Two nodes go on
   only if their sizes and the tokens that their bitmaps may share allow the similarity for some
   pair. Pairs that are joined already are skipped. Where a component has many blocks, the
   groups found meet by their first documents, again in blocks, and then the blocks that still hold
   unjoined documents are compared, root against root first.
4. Components of the links, each named by its smallest doc_id.

Copies (equal sets) stand for each other and meet in step 2 only once.

Shingles are compared as 64-bit hashes; equal sets as 128-bit sums of them.

Defined cases: a null or wordless text has an empty set and no links. Fewer words than a shingle
has: the sequence as a whole is the one shingle. Rows that share a doc_id are counted as one
document whose sets all link. A null doc_id has its count but no links and a null component. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.llm.common import keep_documents, table
from modlens.llm.components import components
from modlens.llm.shingles import Block, as_blob, blocks, long_array
from modlens.session import checkpointed

MANY = 0xFFFF  # in place of a document's number: two or more documents of the block


@dataclass(frozen=True)
class JoinSettings:
    """Words of a shingle, least similarity in percent, and sizes of blocks."""

    words: int = 5
    percent: int = 80
    filter_bits: int = 24  # the filter of step 2 has 2 ** filter_bits bits, whatever the input
    block_weight: int = 400_000  # shingles of a tree block, each document counting 200 more
    bucket_bytes: int = 16 << 20  # of text whose fingerprints meet in one bucket
    bits: int = 2048  # of a token bitmap
    leaf: int = 16


# -- step 1 and 2: what documents share -----------------------------------------------------


def _buckets(docs: DataFrame, s: JoinSettings) -> int:
    """Buckets that fingerprints are dealt over: as many as the bytes of the texts ask for, so that none grows."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2 * parts, -(-size // s.bucket_bytes))


def _dealt(hashes: np.ndarray, n: int) -> np.ndarray:
    # Edges of n equal ranges of the hash in a sorted row of hashes.
    step = (1 << 64) // n
    return np.searchsorted(hashes, np.array([min(i * step, (1 << 64) - 1) for i in range(1, n)], np.uint64))


def _first_rows(s: JoinSettings, n: int):
    """Blocks to rows: fingerprints per bucket, and one row about the block's documents."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, s.words):
            order = np.argsort(b.hashes, kind="stable")
            hashes, owner = b.hashes[order], b.owner[order]
            new = np.ones(len(hashes), bool)
            new[1:] = hashes[1:] != hashes[:-1]
            group = np.cumsum(new) - 1
            many = np.bincount(group, minlength=1) > 1
            local = np.bincount(owner[many[group]], minlength=len(b.keys)) if len(hashes) else np.zeros(len(b.keys))
            first, who = hashes[new], owner[new].astype("<u2")
            who[many[: len(who)]] = MANY
            edges = np.concatenate([[0], _dealt(first, n), [len(first)]])
            low = (first >> np.uint64(20)).astype("<u4")
            rows = [(i, b.number, as_blob(low[x:y]), as_blob(who[x:y]), None, None) for i, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]
            sign_a, sign_b = b.signs()
            about = np.stack([b.sizes, local.astype(np.int64), sign_a, sign_b]).astype("<i8")
            rows.append((b.number % n, b.number, None, None, b.keys, as_blob(about)))
            yield _batch(rows, ["bucket", "block", "a", "b", "keys", "about"])

    return run


_FIRST = "bucket int, block long, a binary, b binary, keys array<long>, about binary"
_TYPES = {
    "bucket": pa.int32(), "block": pa.int64(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary(),
    "keys": pa.list_(pa.int64()), "about": pa.binary(), "doc_id": pa.int64(), "n": pa.int64(),
    "token": pa.int64(), "hashes": pa.binary(),
}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _TYPES[n]) for c, n in zip(columns, names)], names)


def _joined(t: pa.Table, column: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    # All blobs of a column in a row, and the row each value came from.
    parts = [np.frombuffer(v.as_buffer(), kind) for v in t.column(column)]
    sizes = [len(p) for p in parts]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.repeat(np.arange(len(parts)), sizes)


def _shared_here(t: pa.Table) -> pa.Table:
    """One bucket: per block, how many of each document's fingerprints another block holds as well."""
    own = t.filter(pa.compute.is_valid(t.column("a")))
    out = t.filter(pa.compute.is_valid(t.column("about"))).select(["block", "a", "b", "keys", "about"]).to_pylist()
    rows = [(r["block"], None, None, r["keys"], r["about"]) for r in out]
    low, row = _joined(own, "a", "<u4")
    who, _ = _joined(own, "b", "<u2")
    order = np.argsort(low, kind="stable")
    low, row, who = low[order], row[order], who[order]
    twin = np.zeros(len(low), bool)
    same = low[1:] == low[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    hit = np.flatnonzero(twin & (who != MANY))
    pairs, counts = np.unique(row[hit] * (MANY + 1) + who[hit], return_counts=True)
    numbers = own.column("block").to_numpy() if own.num_rows else np.zeros(0, np.int64)
    at, doc = pairs // (MANY + 1), (pairs % (MANY + 1)).astype("<u2")
    for r in np.unique(at):
        mine = at == r
        rows.append((int(numbers[r]), as_blob(doc[mine]), as_blob(counts[mine].astype("<u4")), None, None))
    return pa.Table.from_batches([_batch(rows, ["block", "a", "b", "keys", "about"])])


def _per_document(t: pa.Table) -> pa.Table:
    """One block: doc_id, set size, signs and number of shared shingles of its documents."""
    about, shared = None, None
    for r in t.select(["a", "b", "keys", "about"]).to_pylist():
        if r["about"] is not None:
            keys, about = r["keys"], np.frombuffer(r["about"], "<i8").reshape(4, -1)
    shared = about[1].copy()
    for r in t.select(["a", "b"]).to_pylist():
        if r["a"] is not None:
            shared[np.frombuffer(r["a"], "<u2")] += np.frombuffer(r["b"], "<u4")
    names = ["doc_id", "n_shingles", "sign_a", "sign_b", "shared"]
    return pa.table([long_array(keys), *map(pa.array, (about[0], about[2], about[3], shared))], names)


def document_sets(docs: DataFrame, s: JoinSettings, n: int) -> DataFrame:
    """Per row: doc_id, n_shingles, a sign of its set, and how many of its shingles others share.

    The number shared may be too large by a rare collision of fingerprints, never too small.
    """
    rows = docs.select("doc_id", "text").mapInArrow(_first_rows(s, n), _FIRST)
    answers = rows.groupBy("bucket").applyInArrow(
        _shared_here, "block long, a binary, b binary, keys array<long>, about binary"
    )
    return checkpointed(
        answers.groupBy("block").applyInArrow(
            _per_document, "doc_id long, n_shingles long, sign_a long, sign_b long, shared long"
        )
    )


def _filter_of(reps: DataFrame, bits: int) -> np.ndarray:
    """A filter of fixed size that holds the given doc_ids: one bit per bucket of their hash."""
    bucket = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - bits)
    words = reps.select(F.shiftright(bucket, 12).alias("w"), (bucket % 4096).cast("int").alias("at"))
    out = np.zeros(1 << bits, bool)
    # At most 2 ** (bits - 12) rows of at most 4,096 bits each.
    for r in words.groupBy("w").agg(F.collect_set("at").alias("at")).toLocalIterator():
        out[(r["w"] << 12) + np.array(r["at"])] = True
    return np.packbits(out, bitorder="little")


def _second_rows(s: JoinSettings, n: int):
    """Blocks of chosen documents to rows: full hashes per bucket, and one row of the block's sets."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, s.words):
            order = np.argsort(b.hashes, kind="stable")
            hashes, counts = np.unique(b.hashes[order], return_counts=True)
            edges = np.concatenate([[0], _dealt(hashes, n), [len(hashes)]])
            rows = [
                (i, b.number, as_blob(hashes[x:y]), as_blob(counts[x:y].astype("<u2")), None, None)
                for i, (x, y) in enumerate(zip(edges, edges[1:])) if y > x
            ]
            sets = as_blob(np.concatenate([b.sizes.astype("<u8"), b.hashes]))
            rows.append((b.number % n, b.number, None, None, b.keys, sets))
            yield _batch(rows, ["bucket", "block", "a", "b", "keys", "about"])

    return run


def _counted_here(t: pa.Table) -> pa.Table:
    """One bucket: per block, its hashes that occur twice or more, with their number of documents."""
    own = t.filter(pa.compute.is_valid(t.column("a")))
    passed = t.filter(pa.compute.is_valid(t.column("about"))).to_pylist()
    rows = [(r["block"], None, None, r["keys"], r["about"]) for r in passed]
    hashes, row = _joined(own, "a", "<u8")
    counts, _ = _joined(own, "b", "<u2")
    found, back = np.unique(hashes, return_inverse=True)
    total = np.bincount(back, counts, len(found)).astype(np.int64)[back] if len(found) else np.zeros(0, np.int64)
    numbers = own.column("block").to_numpy() if own.num_rows else np.zeros(0, np.int64)
    keep = total > 1
    for r in np.unique(row[keep]):
        mine = keep & (row == r)
        rows.append((int(numbers[r]), as_blob(hashes[mine]), as_blob(total[mine].astype("<u8")), None, None))
    return pa.Table.from_batches([_batch(rows, ["block", "a", "b", "keys", "about"])])


def _prefixes(percent: int):
    """One block: the sets and the rare-first prefixes of the documents that may have a partner."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.select(["a", "b", "keys", "about"]).to_pylist()
        for r in rows:
            if r["about"] is not None:
                keys, raw = r["keys"], np.frombuffer(r["about"], "<u8")
        sizes, hashes = raw[: len(keys)].astype(np.int64), raw[len(keys) :]
        known = [(np.frombuffer(r["a"], "<u8"), np.frombuffer(r["b"], "<u8")) for r in rows if r["a"] is not None]
        told = np.concatenate([k for k, _ in known]) if known else np.zeros(0, np.uint64)
        often = np.concatenate([c for _, c in known]) if known else np.zeros(0, np.uint64)
        order = np.argsort(told)
        told, often = told[order], often[order]
        out: list[tuple] = []
        ends = np.cumsum(sizes)
        for key, size, end in zip(keys, sizes.tolist(), ends.tolist()):
            own = hashes[end - size : end]
            at = np.minimum(np.searchsorted(told, own), max(len(told) - 1, 0))
            shared = told[at] == own if len(told) else np.zeros(size, bool)
            least = -(-size * percent // 100)
            if not size or shared.sum() < least:
                continue
            count = often[at[shared]]
            rare_first = own[shared][np.lexsort((own[shared], count))]
            # Shingles that no other document has come first in the order and need not be told.
            length = size - least + 1 - (size - int(shared.sum()))
            out.append((key, size, as_blob(own), as_blob(rare_first[:length])))
        return pa.Table.from_batches([_batch([(k, n, h, p) for k, n, h, p in out], ["doc_id", "n", "hashes", "a"])])

    return run


def candidate_sets(docs: DataFrame, reps: DataFrame, s: JoinSettings, n: int) -> DataFrame:
    """doc_id, n, hashes and prefix (``a``) of the documents that may have a partner."""
    bits = s.filter_bits
    chosen = docs.sparkSession.sparkContext.broadcast(_filter_of(reps, bits))
    bucket = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - bits).alias("bucket")
    rows_of = _second_rows(s, n)

    def run(batches) -> Iterator[pa.RecordBatch]:
        mask = chosen.value

        def passing():
            for batch in batches:
                at = batch.column("bucket").to_numpy()
                yield batch.filter(pa.array((mask[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))

        return rows_of(passing())

    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", bucket).mapInArrow(run, _FIRST)
    answers = rows.groupBy("bucket").applyInArrow(
        _counted_here, "block long, a binary, b binary, keys array<long>, about binary"
    )
    return checkpointed(
        answers.groupBy("block").applyInArrow(
            _prefixes(s.percent), "doc_id long, n long, hashes binary, a binary"
        )
    )


def candidate_groups(sets: DataFrame) -> DataFrame:
    """(node, component): connected components of documents that share a prefix shingle."""

    def stars(batches) -> Iterator[pa.RecordBatch]:
        # In a batch a token's documents hang on the first of them, and only that one is told with the token.
        for batch in batches:
            blobs = [np.frombuffer(v.as_buffer(), "<i8") for v in batch.column("a")]
            own = np.repeat(batch.column("doc_id").to_numpy(), [len(b) for b in blobs])
            flat = np.concatenate(blobs) if blobs else np.zeros(0, np.int64)
            order = np.lexsort((own, flat))
            token, doc = flat[order], own[order]
            new = np.ones(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            head = doc[new][np.cumsum(new) - 1] if len(token) else doc
            ties = np.unique(np.stack([doc, head])[:, doc != head], axis=1)
            none = pa.nulls(ties.shape[1], pa.int64())
            columns = [pa.array(token[new]), pa.array(doc[new]), pa.nulls(int(new.sum()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["token", "doc_id", "b"])
            yield pa.RecordBatch.from_arrays([none, pa.array(ties[0]), pa.array(ties[1])], ["token", "doc_id", "b"])

    rows = checkpointed(sets.select("doc_id", "a").mapInArrow(stars, "token long, doc_id long, b long"))
    heads = rows.filter("token IS NOT NULL").select("token", "doc_id")
    first = heads.groupBy("token").agg(F.min("doc_id").alias("b"), F.count("*").alias("c")).filter("c > 1")
    ties = heads.join(first, "token").select(F.col("doc_id").alias("a"), "b")
    ties = ties.unionByName(rows.filter("token IS NULL").select(F.col("doc_id").alias("a"), "b"))
    return components(ties)


# -- step 3: signature trees ----------------------------------------------------------------


class Tree:
    """Levels of nodes over documents in order of size: OR of bitmaps, size range, most spare tokens."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray, leaf: int):
        count = np.bitwise_count(maps).sum(1).astype(np.int64)
        # Tokens beyond a document's set bits: so many may hide behind bits it shares with another.
        level = (maps, sizes, sizes, sizes - count)
        self.levels = [level]
        while len(level[1]) > 1:
            starts = np.arange(0, len(level[1]), leaf)
            level = (
                np.bitwise_or.reduceat(level[0], starts),
                np.minimum.reduceat(level[1], starts),
                np.maximum.reduceat(level[2], starts),
                np.maximum.reduceat(level[3], starts),
            )
            self.levels.append(level)


def may_link(one, two, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether a pair under nodes i and j may reach the similarity, by sizes and possible overlap."""
    low_i, low_j = one[1][i], two[1][j]
    high_i, high_j = one[2][i], two[2][j]
    ok = (high_i * 100 >= low_j * percent) & (high_j * 100 >= low_i * percent)
    at = np.flatnonzero(ok)
    for part in np.array_split(at, max(1, len(at) // 50_000)):
        a, b = i[part], j[part]
        both = np.bitwise_count(one[0][a] & two[0][b]).sum(1).astype(np.int64)
        most = np.minimum(both + np.minimum(one[3][a], two[3][b]), np.minimum(high_i[part], high_j[part]))
        ok[part] = most * (100 + percent) >= percent * (low_i[part] + low_j[part])
    return ok


def tree_links(
    sets: list[np.ndarray], groups: np.ndarray, s: JoinSettings, side: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Links that join the ``groups`` of the documents, by dual traversal of a signature tree.

    Every pair of documents of different groups that reaches the similarity ends up in one group;
    ``side`` limits the pairs to documents of different sides.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    order = np.lexsort((np.arange(len(sets)), groups, sizes))
    sizes, label = sizes[order], groups[order].copy()
    flat = np.concatenate([sets[n] for n in order])
    found, token = np.unique(flat, return_inverse=True)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sets)), sizes)
    maps = np.zeros((len(sets), s.bits // 64), np.uint64)
    bit = (flat >> np.uint64(7)) % np.uint64(s.bits)
    np.bitwise_or.at(maps, (owner, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    tree = Tree(sizes, maps, s.leaf)
    top = len(tree.levels) - 1
    i = j = np.zeros(1, np.int64)
    for depth in range(top, 0, -1):
        # Children of the pairs that went on, each pair of nodes once.
        below = tree.levels[depth - 1]
        n = len(below[1])
        wide = np.arange(s.leaf)
        parts = []
        for chunk in np.array_split(np.arange(len(i)), max(1, len(i) // 4000)):
            a = np.repeat(i[chunk, None] * s.leaf + wide, s.leaf, 1).ravel()
            b = np.tile(j[chunk, None] * s.leaf + wide, (1, s.leaf)).ravel()
            keep = (a < n) & (b < n) & ((a < b) if depth == 1 else (a <= b))
            a, b = a[keep], b[keep]
            if depth == 1:
                keep = label[a] != label[b]
                if side is not None:
                    keep &= side[order[a]] != side[order[b]]
                a, b = a[keep], b[keep]
            ok = may_link(below, below, a, b, s.percent)
            parts.append((a[ok], b[ok]))
        i, j = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    if top == 0:
        return []
    # Exact overlaps, one document against all that are left for it.
    links = []
    mark = np.zeros(len(found), np.int64)
    by = np.argsort(i, kind="stable")
    i, j = i[by], j[by]
    for x, lo, hi in zip(*_runs(i)):
        own = token[ends[x] - sizes[x] : ends[x]]
        mark[own] = 1
        rest = j[lo:hi]
        while len(rest):
            rest = rest[label[rest] != label[x]]
            part, rest = rest[:64], rest[64:]
            for y in part.tolist():
                if label[y] == label[x]:
                    continue
                both = int(mark[token[ends[y] - sizes[y] : ends[y]]].sum())
                if 100 * both >= s.percent * (int(sizes[x] + sizes[y]) - both):
                    links.append((int(order[x]), int(order[y])))
                    label[label == label[y]] = label[x]
        mark[own] = 0
    return links


def _runs(sorted_values: np.ndarray) -> tuple[list, list, list]:
    edges = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.zeros(0, int)
    return sorted_values[edges].tolist(), edges.tolist(), np.r_[edges[1:], len(sorted_values)].tolist() if len(edges) else []


def _block_links(s: JoinSettings):
    """Links inside each (component, block) of a group of rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in pdf.groupby(["component", "block"], sort=True):
            if len(own) > 1:
                keys = own["node"].to_numpy()
                sets = [np.frombuffer(h, "<u8") for h in own["hashes"]]
                links = tree_links(sets, np.arange(len(sets)), s)
                out += [(int(keys[x]), int(keys[y])) for x, y in links]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _pair_links(s: JoinSettings):
    """Links between the two blocks of each pair."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(h, "<u8") for h in pdf["hashes"]]
        groups = np.unique(pdf["label"].to_numpy(), return_inverse=True)[1]
        keys = pdf["node"].to_numpy()
        links = tree_links(sets, groups, s, pdf["block"].to_numpy())
        return pd.DataFrame([(int(keys[x]), int(keys[y])) for x, y in links], columns=["a", "b"], dtype="int64")

    return run


def in_blocks(rows: DataFrame, s: JoinSettings) -> DataFrame:
    """Rows (node, component, n, hashes) with ``block`` and ``blocks``: ranges of set size per component.

    The ranges are approximate quantiles, which merge; ties in size are parted by a hash.
    """
    place = F.col("n") + F.pmod(F.xxhash64("node"), F.lit(1000)) / 1000.0
    placed = rows.withColumn("place", place)
    wanted = F.ceil(F.sum(F.col("n") + 200) / s.block_weight).cast("int")
    weigh = placed.groupBy("component").agg(
        wanted.alias("blocks"), F.percentile_approx("place", [i / 256 for i in range(1, 256)], 10_000).alias("q")
    )
    # More than 256 blocks part the quantile ranges by a hash.
    cut = F.when(
        F.col("blocks") > 1,
        F.size(F.filter("q", lambda c: c < F.col("place"))) * F.least("blocks", F.lit(256)) / 256,
    ).otherwise(F.lit(0.0))
    salt = F.pmod(F.xxhash64("node", F.lit(7)), F.ceil(F.col("blocks") / 256))
    both = placed.join(weigh, "component")
    number = F.floor(cut).cast("long") * 1_000_000 + salt
    return both.withColumn("block", number).drop("place", "q")


def links(sets: DataFrame, groups: DataFrame, s: JoinSettings, n: int) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs that reach the similarity."""
    rows = sets.select(F.col("doc_id").alias("node"), "n", "hashes").join(groups, "node")
    first = checkpointed(in_blocks(rows, s))
    schema = "a long, b long"
    # Many small components share a task; a block is never parted.
    task = F.pmod(F.xxhash64("component", "block"), F.lit(8 * n)).alias("task")
    found = checkpointed(first.withColumn("task", task).groupBy("task").applyInPandas(_block_links(s), schema))
    large = first.filter("blocks > 1")
    if large.isEmpty():
        return found
    labels = _labels(large, found)
    now = checkpointed(large.join(labels, "node"))
    before = None
    while True:
        # The first documents of the groups of a component meet, in blocks of their own.
        heads = now.filter("node = label").select("node", "component", "n", "hashes")
        left = heads.count()
        if before is not None and left > 0.9 * before:
            break
        before = left
        again = in_blocks(heads, s).withColumn("task", task)
        found = checkpointed(found.unionByName(again.groupBy("task").applyInPandas(_block_links(s), schema)))
        now = checkpointed(large.join(_labels(large, found), "node"))
    open_ones = now.groupBy("component").agg(F.countDistinct("label").alias("labels")).filter("labels > 1")
    rest = now.join(open_ones.select("component"), "component", "left_semi")
    return checkpointed(found.unionByName(across(rest, s)))


def _labels(rows: DataFrame, found: DataFrame) -> DataFrame:
    named = components(found)
    return rows.select("node").join(named, "node", "left").select(
        "node", F.coalesce("component", "node").alias("label")
    )


def across(rows: DataFrame, s: JoinSettings) -> DataFrame:
    """Links between documents in different blocks of a component whose groups differ.

    The roots of the blocks' trees are compared first: a pair of blocks goes on if its sizes and the
    OR of its token bitmaps allow the similarity and it holds two groups. A document is sent to the
    pairs that go on only.
    """

    def roots(pdf: pd.DataFrame) -> pd.DataFrame:
        maps = np.zeros(s.bits // 64, np.uint64)
        spare = 0
        for h in pdf["hashes"]:
            own = np.zeros(s.bits // 64, np.uint64)
            bit = (np.frombuffer(h, "<u8") >> np.uint64(7)) % np.uint64(s.bits)
            np.bitwise_or.at(own, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
            spare = max(spare, len(h) // 8 - int(np.bitwise_count(own).sum()))
            maps |= own
        labels = pdf["label"]
        one = int(labels.iloc[0]) if labels.nunique() == 1 else None
        return pd.DataFrame(
            [(pdf["component"].iloc[0], pdf["block"].iloc[0], pdf["n"].min(), pdf["n"].max(), spare, one, maps.view(np.int64).tolist())],
            columns=["component", "block", "low", "high", "spare", "one", "map"],
        )

    schema = "component long, block long, low long, high long, spare long, one long, map array<long>"
    tops = checkpointed(rows.groupBy("component", "block").applyInPandas(roots, schema))
    a, b = tops.alias("a"), tops.alias("b")
    overlap = F.aggregate(
        F.zip_with("a.map", "b.map", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda t, x: t + x
    )
    most = F.least(overlap + F.least("a.spare", "b.spare"), F.col("a.high"), F.col("b.high"))
    pairs = a.join(b, F.col("a.component") == F.col("b.component")).filter(F.col("a.block") < F.col("b.block"))
    pairs = pairs.filter(
        (F.col("a.high") * 100 >= F.col("b.low") * s.percent)
        & (F.col("b.high") * 100 >= F.col("a.low") * s.percent)
        & (most * (100 + s.percent) >= s.percent * (F.col("a.low") + F.col("b.low")))
        & ~F.coalesce(F.col("a.one") == F.col("b.one"), F.lit(False))
    ).select("a.component", F.col("a.block").alias("p"), F.col("b.block").alias("q"))
    sides = pairs.select("component", "p", "q", F.explode(F.array("p", "q")).alias("block"))
    sent = rows.join(checkpointed(sides), ["component", "block"])
    return sent.groupBy("component", "p", "q").applyInPandas(_pair_links(s), "a long, b long")


def near_duplicates(docs: DataFrame, s: JoinSettings = JoinSettings()) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id."""
    n = _buckets(docs, s)
    every = document_sets(docs, s, n)
    filled = every.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    sign = ["sign_a", "sign_b", "n_shingles"]
    classes = filled.groupBy(*sign).agg(
        F.min("doc_id").alias("rep"), F.max("shared").alias("shared"), F.count("*").alias("rows")
    )
    classes = checkpointed(classes)
    reps = classes.filter(F.col("shared") * 100 >= F.col("n_shingles") * s.percent)
    sets = candidate_sets(docs, reps.select(F.col("rep").alias("doc_id")), s, n)
    sets = sets.dropDuplicates(["doc_id", "hashes"])
    edges = links(sets, candidate_groups(sets), s, n)
    # Copies hang on their first document; so do rows that share a doc_id.
    copies = filled.join(classes.filter("rows > 1"), sign).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    named = components(edges.unionByName(copies))
    out = every.join(named, every["doc_id"] == named["node"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def first_of_groups(docs: DataFrame, s: JoinSettings = JoinSettings()) -> DataFrame:
    """The documents without those linked to a document with a smaller doc_id; all columns."""
    groups = near_duplicates(docs, s)
    return keep_documents(docs, groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def op1(spark, folder):
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, folder, "documents"))
