"""Removal of repeated passages: every byte covered by a 100-byte string that also starts earlier.

Documents are dealt over blocks by a hash. In each block every 100-byte window is filed under its anchor, the
48-byte string inside it with the smallest hash (leftmost among equals), so equal windows lie under
equal anchors wherever they stand, and neighbouring windows mostly share one. Blocks send each of
their distinct anchors once and hear which ones a different text holds as well. The stretches of text
under those anchors go, each distinct stretch once per block, to the anchor's bucket. There, equal
stretches are one string; the strings of anchors with several are split over shards, whose
Burrows-Wheeler transforms are merged (``bwt.merge``), and every repeated interval of 100 symbols is
a class of equal windows, of which the earliest stays. An anchor with very many different stretches, as at the
rim of a passage that many documents hold, would fill one bucket: its stretches are cut into their windows, each
filed under two hashes of itself, so that they spread over all buckets. The blocks take back which windows to
remove. Texts are shuffled once, to their blocks; a text in very many copies or a passage in very
many documents sends one row per block.

Windows are judged on the input, overlaps count, and matches never cross documents. Of equal texts
all but the first lose everything (if they have 100 bytes).

Defined cases: a null text counts as empty; texts under 100 bytes stay as they are. A null doc_id
comes before all others. Rows that share a doc_id but not the text are ordered by a hash of the
text; rows alike in both are one document and share its result. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modlens.llm.bwt import merge
from modlens.llm.common import table
from modlens.llm.shingles import as_blob, mix

LEAST = -(2**63)  # stands for a null key


@dataclass(frozen=True)
class RepeatSettings:
    """Bytes of a window and of an anchor, bytes of a block, shards of a bucket, and the different stretches
    from which on an anchor's windows go their own ways."""

    window: int = 100
    anchor: int = 48
    block_bytes: int = 4_000_000
    shards: int = 4
    hot: int = 20_000


@dataclass
class Texts:
    """The documents of a block in order of key and text hash, as one row of bytes."""

    keys: np.ndarray
    signs: np.ndarray
    data: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, t: pa.Table) -> Texts:
        """Distinct (key, sign) rows of a block."""
        keys = t.column("key").to_numpy()
        signs = t.column("sign_a").to_numpy()
        order = np.lexsort((signs, keys))
        keys, signs = keys[order], signs[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (signs[1:] != signs[:-1])
        texts = t.column("text").take(pa.array(order[new])).to_pylist()
        raw = [x.encode() for x in texts]
        return cls(
            keys[new], signs[new], np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw])
        )


@dataclass
class Stretches:
    """Runs of window starts under one anchor: first start, number of starts, anchor's hash, document."""

    start: np.ndarray
    count: np.ndarray
    hash: np.ndarray
    doc: np.ndarray


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of every string of ``size`` bytes; powers of two are put together."""
    odd, length = 0x9E3779B97F4A7C15, 1
    now = data.astype(np.uint64) + np.uint64(1)
    while length * 2 <= size:
        now = now[:-length] * np.uint64(pow(odd, length, 2**64)) + now[length:]
        length *= 2
    if length < size:
        rest = size - length
        now = now[:-rest] * np.uint64(0xC2B2AE3D27D4EB4F) + now[rest:]
    return mix(now)


def least_place(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of every ``width`` hashes in a row, leftmost among equals."""
    low = np.uint64((1 << 24) - 1)
    now = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    length = 1
    while length * 2 <= width:
        now = np.minimum(now[:-length], now[length:])
        length *= 2
    if length < width:
        now = np.minimum(now[: -(width - length)], now[width - length :])
    return (now & low).astype(np.int64)


def stretches(texts: Texts, s: RepeatSettings) -> Stretches:
    """Every window start of the block's documents, under its anchor."""
    begins = np.concatenate([[0], texts.ends[:-1]])
    parts = []
    piece = 500_000  # bytes looked at together; bounds the memory whatever the size of a text
    for at in range(0, len(texts.data), piece):
        data = texts.data[at : at + piece + s.window - 1]
        if len(data) < s.window:
            continue
        hashes = gram_hashes(data, s.anchor)
        place = least_place(hashes, s.window - s.anchor + 1)
        # The document of every window start; windows that leave it do not count.
        starts = np.arange(at, at + len(place))
        doc = np.searchsorted(texts.ends, starts, side="right")
        inside = starts + s.window <= texts.ends[np.minimum(doc, len(texts.ends) - 1)]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.r_[first, len(place)])
        ok = inside[first]
        first, count = first[ok], count[ok]
        # Anchors are small hashes; mixed again, they spread over all buckets.
        parts.append((first + at, count, mix(hashes[place[first]]), doc[first]))
    if not parts:
        none = np.zeros(0, np.int64)
        return Stretches(none, none, np.zeros(0, np.uint64), none)
    start, count, found, doc = (np.concatenate(c) for c in zip(*parts))
    return Stretches(start, count, found, doc)


def _edges(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    step = (1 << 64) // n
    cuts = np.searchsorted(sorted_hashes, np.array([i * step for i in range(1, n)], np.uint64))
    return np.concatenate([[0], cuts, [len(sorted_hashes)]])


def _print(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype("<u4")


_ANCHORS = "bucket int, block int, a binary, b binary, c binary"


def _different(texts: Texts, runs: Stretches, order: np.ndarray, group: np.ndarray, s: RepeatSettings) -> np.ndarray:
    """About how many different stretches each group of runs holds, by their lengths and ends (at most 65,535)."""
    if not len(order):
        return np.zeros(0, "<u2")
    start, count = runs.start[order], runs.count[order]
    end = start + count + s.window - 1
    sides = np.zeros(len(order), np.uint64)
    for at in (start, end - 8):
        for i in range(8):
            sides = sides * np.uint64(0x100000001B3) + texts.data[at + i]
    sides = sides * np.uint64(0x9E3779B97F4A7C15) + count.astype(np.uint64)
    by = np.lexsort((sides, group))
    new = np.ones(len(by), bool)
    new[1:] = (sides[by][1:] != sides[by][:-1]) | (group[by][1:] != group[by][:-1])
    return np.minimum(np.bincount(group[by], new), 0xFFFF).astype("<u2")


def _tell_anchors(s: RepeatSettings, n: int):
    """A block's distinct anchors by bucket, with the sign of the text that holds them (0: several places)."""

    def run(t: pa.Table) -> pa.Table:
        texts = Texts.of(t)
        runs = stretches(texts, s)
        order = np.argsort(runs.hash, kind="stable")
        hashes, sign, doc = runs.hash[order], texts.signs[runs.doc[order]], runs.doc[order]
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        group = np.cumsum(new) - 1
        # Another place in the same document, or in another text, is a share; in a copy it is none.
        other = np.zeros(len(hashes), bool)
        other[1:] = ~new[1:] & ((sign[1:] != sign[:-1]) | (doc[1:] == doc[:-1]))
        several = np.bincount(group, other, minlength=1) > 0
        first, who = hashes[new], sign[new].copy()
        who[several[: len(who)]] = 0
        edges = _edges(first, n)
        many = _different(texts, runs, order, group, s)
        block = t.column("block")[0].as_py()
        rows = [
            (i, block, as_blob(_print(first[x:y])), as_blob(who[x:y]), as_blob(many[x:y]))
            for i, (x, y) in enumerate(zip(edges, edges[1:])) if y > x
        ]
        kinds = [("bucket", pa.int32()), ("block", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]
        return _table(rows, kinds)

    return run


def _table(rows: list[tuple], schema: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.table([pa.array(list(c), t) for c, (_, t) in zip(columns, schema)], [n for n, _ in schema])


def _blobs(column, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), kind) for v in column]


def _answer_anchors(s: RepeatSettings):
    """One bucket: per block, the prints of its anchors that another text or place holds, and which are hot."""

    def run(t: pa.Table) -> pa.Table:
        prints, signs, counts = _blobs(t.column("a"), "<u4"), _blobs(t.column("b"), "<i8"), _blobs(t.column("c"), "<u2")
        row = np.repeat(np.arange(len(prints)), [len(p) for p in prints])
        low, who, many = np.concatenate(prints), np.concatenate(signs), np.concatenate(counts)
        order = np.argsort(low, kind="stable")
        low, who, many, row = low[order], who[order], many[order], row[order]
        starts = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        size = np.diff(np.r_[starts, len(low)])
        shared = (np.minimum.reduceat(who, starts) != np.maximum.reduceat(who, starts)) | (
            np.bitwise_or.reduceat((who == 0).astype(np.int8), starts) > 0
        )
        hot = np.repeat(np.add.reduceat(many.astype(np.int64), starts) > s.hot, size)
        hit = np.repeat(shared, size)
        blocks = t.column("block").to_pylist()
        low, hot, row = low[hit], hot[hit], row[hit]
        order = np.argsort(row, kind="stable")
        low, hot, row = low[order], hot[order].astype(np.uint8), row[order]
        edges = np.searchsorted(row, np.arange(len(prints) + 1))
        rows = [
            (blocks[r], as_blob(low[x:y]), as_blob(hot[x:y])) for r, (x, y) in enumerate(zip(edges, edges[1:])) if y > x
        ]
        return _table(rows, [("block", pa.int32()), ("a", pa.binary()), ("c", pa.binary())])

    return run


def _single_windows(texts: Texts, runs: Stretches, hot: np.ndarray, s: RepeatSettings):
    """The windows of the runs ``hot``: two hashes, document and place of each, the block's first ones and the others."""
    start, count = runs.start[hot], runs.count[hot]
    ends = np.cumsum(count)
    at = np.arange(int(ends[-1])) + np.repeat(start - (ends - count), count)
    doc = np.repeat(runs.doc[hot], count)
    one, two = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for i in range(s.window):
        byte = texts.data[at + i].astype(np.uint64) + np.uint64(1)
        one = one * np.uint64(0x9E3779B97F4A7C15) + byte
        two = (two ^ byte) * np.uint64(0xC2B2AE3D27D4EB4F)
        two ^= two >> np.uint64(29)
    one, two = mix(one), mix(two)
    place = at - np.concatenate([[0], texts.ends[:-1]])[doc]
    by = np.lexsort((at, two, one))  # documents stand in order, so places do
    new = np.ones(len(by), bool)
    new[1:] = (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1])
    return one[by], two[by], doc[by], place[by], new


# A block's word to a bucket: strings and, per string, anchor, length, key, sign, number and start.
_STRINGS = [
    ("bucket", pa.int32()), ("block", pa.int32()), ("text", pa.binary()), ("about", pa.binary()), ("cut", pa.binary()),
    ("single", pa.binary()),  # of windows on their own: two hashes, key, sign, number and place
]
_STRINGS_DDL = "bucket int, block int, text binary, about binary, cut binary, single binary"


def _tell_strings(s: RepeatSettings, n: int):
    """A block's distinct stretches under shared anchors by bucket; repeats inside the block are cut at once."""

    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows or not answers.num_rows:
            return _table([], _STRINGS)
        texts = Texts.of(t)
        runs = stretches(texts, s)
        prints, flags = _blobs(answers.column("a"), "<u4"), _blobs(answers.column("c"), "u1")
        told, at = np.unique(np.concatenate(prints), return_index=True)
        hot = np.concatenate(flags)[at] > 0
        mine = _print(runs.hash)
        at = np.minimum(np.searchsorted(told, mine), len(told) - 1)
        ours = told[at] == mine
        order, alone = np.flatnonzero(ours & ~hot[at]), np.flatnonzero(ours & hot[at])
        raw = texts.data.tobytes()
        begins = np.concatenate([[0], texts.ends[:-1]])
        # Stretches come in document order, so the first of equal ones is the earliest.
        first: dict[bytes, int] = {}
        keep, cut = [], []
        start, count = runs.start[order], runs.count[order]
        for i, a, b in zip(range(len(order)), start.tolist(), (start + count + s.window - 1).tolist()):
            if first.setdefault(raw[a:b], i) == i:
                keep.append(i)
            else:
                cut.append(i)
        place = start - begins[runs.doc[order]]
        removed = np.stack([runs.doc[order][cut], place[cut], count[cut]]).astype("<i8") if cut else np.zeros((3, 0), "<i8")
        keep_at = np.array(keep, np.int64)
        strings = list(first)
        hashes, doc = runs.hash[order][keep_at], runs.doc[order][keep_at]
        by = np.argsort(hashes, kind="stable")
        edges = _edges(hashes[by], n)
        block = t.column("block")[0].as_py()
        rows = []
        for i, (x, y) in enumerate(zip(edges, edges[1:])):
            if y > x:
                w = by[x:y]
                size = count[keep_at[w]] + s.window - 1
                about = np.stack(
                    [hashes[w].view(np.int64), size, texts.keys[doc[w]], texts.signs[doc[w]], doc[w], place[keep_at[w]]]
                )
                text = b"".join([strings[k] for k in w.tolist()])
                rows.append((i, block, text, as_blob(about.astype("<i8")), None, None))
        rows.append((block % n, block, None, None, as_blob(removed), None))
        if len(alone):
            one, two, doc, place, new = _single_windows(texts, runs, alone, s)
            again = np.stack([doc[~new], place[~new], np.ones(int((~new).sum()), np.int64)])
            rows.append((block % n, block, None, None, as_blob(again.astype("<i8")), None))
            one, two, doc, place = one[new], two[new], doc[new], place[new]
            edges = _edges(one, n)
            about = np.stack([one.view(np.int64), two.view(np.int64), texts.keys[doc], texts.signs[doc], doc, place])
            rows += [
                (i, block, None, None, None, as_blob(about[:, x:y].astype("<i8")))
                for i, (x, y) in enumerate(zip(edges, edges[1:])) if y > x
            ]
        return _table(rows, _STRINGS)

    return run


def _compare_strings(s: RepeatSettings):
    """One bucket: per block, the windows (document, first start, number of starts) to remove."""

    def run(t: pa.Table) -> pa.Table:
        out_schema = [("block", pa.int32()), ("cut", pa.binary())]
        passed = [(b, c) for b, c in zip(t.column("block").to_pylist(), t.column("cut").to_pylist()) if c]
        passed += _later_singles(t.filter(pa.compute.is_valid(t.column("single"))))
        own = t.filter(pa.compute.is_valid(t.column("about")))
        if not own.num_rows:
            return _table(passed, out_schema)
        blocks = own.column("block").to_numpy()
        abouts = [a.reshape(6, -1) for a in _blobs(own.column("about"), "<i8")]
        counts = [a.shape[1] for a in abouts]
        anchor, size, key, sign, doc, place = np.concatenate(abouts, axis=1)
        block = np.repeat(blocks, counts)
        raw = b"".join(own.column("text").to_pylist())
        ends = np.cumsum(size)
        order = np.lexsort((place, sign, key))
        first: dict[bytes, int] = {}
        copies = []
        for i in order.tolist():
            # Equal strings are one; the earliest stands for it.
            if first.setdefault(raw[ends[i] - size[i] : ends[i]], i) != i:
                copies.append(i)
        gone = [(block[copies], doc[copies], place[copies], size[copies] - s.window + 1)]
        kept = np.fromiter(first.values(), np.int64, len(first))
        _, back, many = np.unique(anchor[kept], return_inverse=True, return_counts=True)
        kept = kept[many[back] > 1]
        if len(kept):
            gone.append(_repeated_windows(kept, raw, ends, size, order, block, doc, place, s))
        b, d, p, c = (np.concatenate(x) for x in zip(*gone))
        rows = _by_block(b, np.stack([d, p, c]))
        return _table(passed + rows, out_schema)

    return run


def _by_block(block: np.ndarray, cut: np.ndarray) -> list[tuple]:
    by = np.argsort(block, kind="stable")
    block, cut = block[by], cut[:, by].astype("<i8")
    edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, int)
    return [(int(block[x]), as_blob(cut[:, x:y])) for x, y in zip(edges, np.r_[edges[1:], len(block)])]


def _later_singles(t: pa.Table) -> list[tuple]:
    """Windows on their own that an earlier document of another block holds, by block."""
    if not t.num_rows:
        return []
    parts = [a.reshape(6, -1) for a in _blobs(t.column("single"), "<i8")]
    block = np.repeat(t.column("block").to_numpy(), [p.shape[1] for p in parts])
    one, two, key, sign, doc, place = np.concatenate(parts, axis=1)
    by = np.lexsort((place, sign, key, two, one))
    later = np.zeros(len(by), bool)
    later[1:] = (one[by][1:] == one[by][:-1]) & (two[by][1:] == two[by][:-1])
    gone = by[later]
    return _by_block(block[gone], np.stack([doc[gone], place[gone], np.ones(len(gone), np.int64)]))


def _repeated_windows(kept, raw, ends, size, order, block, doc, place, s: RepeatSettings):
    """Windows of the strings ``kept`` that an earlier string holds, by merged transforms."""
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))  # earlier documents first
    shards = [kept[n :: s.shards] for n in range(s.shards) if len(kept[n :: s.shards])]
    rows = []
    for own in shards:
        row = np.zeros(int((size[own] + 1).sum()), np.uint16)
        row[_spread(size[own] + 1, size[own])] = (
            np.frombuffer(b"".join([raw[ends[i] - size[i] : ends[i]] for i in own.tolist()]), np.uint8).astype(np.uint16) + 1
        )
        rows.append(row)
    classes, owner, offset = [], [], []
    for own, found in zip(shards, merge(rows, s.window)):
        windows = size[own] - s.window + 1
        classes.append(found[_spread(size[own] + 1, windows)])
        owner.append(np.repeat(own, windows))
        offset.append(np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows))
    cls, who, off = np.concatenate(classes), np.concatenate(owner), np.concatenate(offset)
    at = place[who] + off
    by = np.lexsort((at, rank[who], cls))
    later = np.zeros(len(cls), bool)
    later[1:] = cls[by][1:] == cls[by][:-1]
    gone = np.zeros(len(cls) + 2, bool)
    gone[by[later] + 1] = True
    # Neighbouring windows of one string go as one run.
    same = np.r_[False, who[1:] == who[:-1], False]
    begins = np.flatnonzero(gone[1:-1] & ~(gone[:-2] & same[:-1]))
    lasts = np.flatnonzero(gone[1:-1] & ~(gone[2:] & same[1:]))
    return block[who[begins]], doc[who[begins]], at[begins], lasts - begins + 1


def _spread(room: np.ndarray, used: np.ndarray) -> np.ndarray:
    # Places of the first ``used`` cells of rooms that stand in a row.
    begin = np.cumsum(room) - room
    first = np.cumsum(used) - used
    return np.arange(int(used.sum())) + np.repeat(begin - first, used)


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(s: RepeatSettings, with_text: bool):
    """A block's documents without the windows to remove, row by row as they came."""

    def run(t: pa.Table, cuts: pa.Table) -> pa.Table:
        texts = Texts.of(t) if t.num_rows else Texts(*[np.zeros(0, np.int64)] * 4)
        begins = np.concatenate([[0], texts.ends[:-1]])
        covered = np.zeros(len(texts.data) + 1, np.int32)
        whole = set()
        for cut, gone in zip(cuts.column("cut").to_pylist(), cuts.column("gone").to_pylist()):
            whole.update((g["key"], g["sign_a"]) for g in gone or [])
            if cut and t.num_rows:
                doc, place, count = np.frombuffer(cut, "<i8").reshape(3, -1)
                np.add.at(covered, begins[doc] + place, 1)
                np.add.at(covered, begins[doc] + place + count + s.window - 1, -1)
        removed = np.cumsum(covered[:-1], dtype=np.int32) > 0
        made = {}
        for n, name in enumerate(zip(texts.keys.tolist(), texts.signs.tolist())):
            x, y = int(begins[n]), int(texts.ends[n])
            if name in whole:
                removed[x:y] = True
            flags = removed[x:y]
            kept = texts.data[x:y][~flags].tobytes()
            spans = int((np.diff(flags.astype(np.int8), prepend=0) == 1).sum())
            left = kept.decode("utf-8", "ignore") if with_text else None
            made[name] = (y - x, int(flags.sum()), spans, hashlib.sha256(kept).hexdigest(), left)
        rows = [made[name] for name in zip(t.column("key").to_pylist(), t.column("sign_a").to_pylist())]
        kinds = [pa.int64()] * 3 + [pa.string()] * (2 if with_text else 1)
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            return pa.table([t.column("doc_id"), *columns, t.column("rest")], [*names, "kept", "rest"])
        return pa.table([t.column("doc_id"), *columns], names)

    return run


def signs(text: Column) -> dict[str, Column]:
    """Two hashes of a text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return {"sign_a": F.xxhash64(t), "sign_b": F.xxhash64(F.lit(7), t)}


def cut_documents(docs: DataFrame, s: RepeatSettings = RepeatSettings()) -> DataFrame:
    """The documents with repeated passages cut out of ``text``; ``n_chars`` follows; other columns stay.

    Characters of which a byte is gone go as a whole. The other columns travel with the text.
    """
    out = without_repeats(docs, s, with_text=True)
    text = F.when(F.col("rest._has_text"), F.col("kept"))
    columns = {c: F.col("rest").getField(c) for c in docs.columns} | {"doc_id": F.col("doc_id"), "text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length(F.coalesce(text, F.lit(""))).cast(docs.schema["n_chars"].dataType)
    return out.select([columns[c].alias(c) for c in docs.columns])


def without_repeats(docs: DataFrame, s: RepeatSettings = RepeatSettings(), with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    With ``with_text`` also ``kept``, the text that is left, and ``rest``, the other columns of the row.
    """
    spark = docs.sparkSession
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")] if with_text else []
    rest = F.struct(F.col("text").isNotNull().alias("_has_text"), *others).alias("rest")
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *[rest] * with_text)
    rows = base.withColumns({"key": F.coalesce("doc_id", F.lit(LEAST)), **signs(F.col("text"))})
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, size // s.block_bytes)
    # Buckets of strings are about as large as blocks, so that a bucket's transforms fit a task.
    n = max(int(2 * n_blocks), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("key", "sign_a"), F.lit(n_blocks)).cast("int"))
    by_block = dealt.groupBy("block")
    anchors = by_block.applyInArrow(_tell_anchors(s, n), _ANCHORS)
    shared = anchors.groupBy("bucket").applyInArrow(_answer_anchors(s), "block int, a binary, c binary")
    strings = by_block.cogroup(shared.groupBy("block")).applyInArrow(_tell_strings(s, n), _STRINGS_DDL)
    cuts = strings.groupBy("bucket").applyInArrow(_compare_strings(s), "block int, cut binary")
    # Of equal texts, all windows of the later ones start earlier in the first.
    sign = ["sign_a", "sign_b"]
    firsts = rows.groupBy(*sign).agg(F.min("key").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    long = dealt.filter(F.octet_length("text") >= s.window).select("key", *sign, "block")
    later = long.join(firsts, sign).filter("key > first").groupBy("block").agg(
        F.collect_list(F.struct("key", "sign_a")).alias("gone")
    )
    kind = later.schema["gone"].dataType
    told = cuts.withColumn("gone", F.lit(None).cast(kind)).unionByName(
        later.select("block", F.lit(None).cast("binary").alias("cut"), "gone")
    )
    schema = T.StructType.fromDDL(_RESULT)
    if with_text:
        schema = schema.add("kept", "string").add("rest", base.schema["rest"].dataType)
    return by_block.cogroup(told.groupBy("block")).applyInArrow(_cut(s, with_text), schema)


def op6(spark, folder):
    """All documents without their repeated passages."""
    return without_repeats(table(spark, folder, "documents"))
