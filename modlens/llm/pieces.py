"""SentencePiece-style encoding with seeded merge-dropout, and lossless decoding.

A text is cut into units (blanks and the characters behind them); no piece of the vocabulary reaches
across the start of a unit. In a unit, the agenda holds every pair of neighbours whose
concatenation is a piece; the pair of best score, leftmost among equals, is merged first. With
dropout, a pair is passed over when a hash keyed by the seed, the document's key, the number of the unit
in the document, the place in the unit and the two pieces falls below the rate, so a run repeats itself
exactly wherever its tasks run. Every place of a word in a document draws its own segmentation.

Each worker keeps the merges that a unit goes through without dropout. Where none of these is passed
over, the best pair is the same at every step and so are the pieces; all other places are worked off by
their agenda. Many units are worked off together as arrays, one merge of each per step; units with
very many symbols have an agenda of their own.

Defined cases: a null or empty text has no pieces. A character outside the vocabulary, and the
character that stands for a blank inside pieces, become byte pieces, so every text decodes to
itself. Documents that share a key draw alike. A null key is a key. An empty table gives an
empty result. With rate 0 the pieces are those of the plain model.
"""

from __future__ import annotations

import functools
import heapq
import re
import sys
import zlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from modlens.llm.common import table
from modlens.llm.token_files import vocabulary

BLANK = "▁"
WIDTHS = (8, 16, 32, 64)  # units of up to so many symbols are worked off together
NEVER = np.iinfo(np.int32).max
BATCH = 400
UNITS = 30_000  # units worked off together; bounds the memory
KNOWN = 300_000  # units whose plain merges a worker keeps
_UNIT = re.compile(" *[^ ]+| +$")
_M1, _M2, _STEP = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
_ALL = 2**64 - 1


@dataclass(frozen=True)
class DropoutSettings:
    """Share of merges passed over, and seed."""

    rate: float = 0.1
    seed: int = 1


def mixed(x):
    """A 64-bit mix of whole numbers or arrays of them."""
    if isinstance(x, np.ndarray):
        with np.errstate(over="ignore"):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(_M1)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(_M2)
            return x ^ (x >> np.uint64(31))
    x = ((x ^ (x >> 30)) * _M1) & _ALL
    x = ((x ^ (x >> 27)) * _M2) & _ALL
    return x ^ (x >> 31)


class Pieces:
    """A vocabulary as tables: symbols of characters, merges of pairs, bytes of pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        name = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        is_byte = [model.is_byte(i) for i in range(n)]
        known = {p: i for i, p in enumerate(name) if not special[i] and not is_byte[i]}
        byte_of = {int(p[3:5], 16): i for i, p in enumerate(name) if is_byte[i]}
        self.byte_ids = np.array([byte_of[b] for b in range(256)], np.int32)
        self.symbol = np.full(sys.maxunicode + 1, -1, np.int32)
        for p, i in known.items():
            if len(p) == 1 and p != BLANK:
                self.symbol[ord(p)] = i
        self.symbol[ord(" ")] = known[BLANK]
        _, place = np.unique([-model.get_score(i) for i in range(n)], return_inverse=True)
        self.size = n
        merges = {}
        for p, i in known.items():
            for k in range(1, len(p)):
                left, right = known.get(p[:k]), known.get(p[k:])
                if left is not None and right is not None:
                    merges[left * n + right] = (i, int(place[i]))
        self.merges = merges
        self.keys = np.array(sorted(merges), np.int64)
        both = np.array([merges[k] for k in self.keys.tolist()], np.int32).reshape(-1, 2)
        self.merged, self.rank = both[:, 0], both[:, 1]
        spelled = [
            bytes([int(p[3:5], 16)]) if is_byte[i] else b"" if special[i] else p.replace(BLANK, " ").encode()
            for i, p in enumerate(name)
        ]
        sizes = np.array([len(b) for b in spelled])
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.ends = np.cumsum(sizes)
        self.sizes = sizes

    def symbols(self, units: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """First symbols of all units in a row (characters, or their bytes), and how many each has."""
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        found = self.symbol[points]
        strange = found < 0
        if not strange.any():
            return found, sizes
        width = np.where(strange, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), 1)
        raw = points[strange].astype("<u4").tobytes().decode("utf-32-le").encode()
        spread = np.repeat(strange, width)
        out = np.empty(len(spread), np.int32)
        out[~spread] = found[~strange]
        out[spread] = self.byte_ids[np.frombuffer(raw, np.uint8)]
        done = np.concatenate([[0], np.cumsum(width)])
        ends = np.cumsum(sizes)
        return out, done[ends] - done[ends - sizes]

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the pieces spell, in a row."""
        size = self.sizes[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        first = self.ends[ids] - size
        return self.spelled[np.arange(total) + np.repeat(first - (ends - size), size)]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of the pieces; the blank in front of a text is taken off."""
        return self.decode_bytes(np.asarray(ids, np.int64)).tobytes().decode()[1:]


class Segmenter:
    """Units to pieces with keyed merge-dropout."""

    def __init__(self, pieces: Pieces, s: DropoutSettings):
        self.p, self.s = pieces, s
        self.floor = int(s.rate * 2**64)

    def terms(self, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What the merges of two pieces at a place add to the key of a unit."""
        pair = left.astype(np.uint64) * np.uint64(self.p.size) + right.astype(np.uint64)
        with np.errstate(over="ignore"):
            return at.astype(np.uint64) * np.uint64(_STEP) + pair * np.uint64(_M1)

    def below(self, key: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Whether merges are skipped, by the keys of their units and their terms."""
        if self.floor == 0:
            return np.zeros(len(key), bool)
        with np.errstate(over="ignore"):
            return mixed(key + terms) < np.uint64(min(self.floor, _ALL))

    def passed_over(self, key: int, at: int, left: int, right: int) -> bool:
        """Whether one merge of two pieces at a place is skipped."""
        x = mixed((key + at * _STEP + (left * self.p.size + right) * _M1) & _ALL)
        return x < min(self.floor, _ALL)

    def alone(self, symbols: Sequence[int], key: int) -> list[int]:
        """One unit by an agenda: the best pair first, leftmost among equals."""
        sym = [int(s) for s in symbols]
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int]] = []

        def propose(i: int) -> None:
            if i < 0 or after[i] >= n:
                return
            left, right = sym[i], sym[after[i]]
            found = self.p.merges.get(left * self.p.size + right)
            if found and not self.passed_over(key, i, left, right):
                heapq.heappush(agenda, (found[1], i, left, right))

        for i in range(n):
            propose(i)
        while agenda:
            _, i, left, right = heapq.heappop(agenda)
            # A pair whose pieces have changed since is out of date.
            if sym[i] != left or after[i] >= n or sym[after[i]] != right:
                continue
            j = after[i]
            sym[i] = self.p.merges[left * self.p.size + right][0]
            sym[j] = -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            propose(i)
            propose(before[i])
        return [s for s in sym if s >= 0]

    def _pairs(self, key, at, left, right) -> tuple[np.ndarray, np.ndarray]:
        # Rank and merged piece of many pairs; NEVER where there is no merge or it is passed over.
        pair = left.astype(np.int64) * self.p.size + right
        spot = np.minimum(np.searchsorted(self.p.keys, pair), len(self.p.keys) - 1)
        good = np.flatnonzero((self.p.keys[spot] == pair) & (left >= 0) & (right >= 0))
        if self.floor:
            good = good[~self.below(key[good], self.terms(at[good], left[good], right[good]))]
        rank, piece = np.full(len(pair), NEVER, np.int32), np.full(len(pair), -1, np.int32)
        rank[good], piece[good] = self.p.rank[spot[good]], self.p.merged[spot[good]]
        return rank, piece

    def together(
        self, flat: np.ndarray, sizes: np.ndarray, keys: np.ndarray, width: int, log: list | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Units of up to ``width`` symbols, one merge of each per step: pieces, and how many each has.

        A ``log`` takes the units that merged in each step, and the terms of their merges.
        """
        n = len(sizes)
        sym = np.full((n, width + 1), -1, np.int32)
        sym[np.arange(width + 1) < sizes[:, None]] = flat
        place = np.broadcast_to(np.arange(width), (n, width))
        after = np.broadcast_to(np.arange(1, width + 1, dtype=np.int16), (n, width)).copy()
        before = np.broadcast_to(np.arange(-1, width, dtype=np.int16), (n, width + 1)).copy()
        rank, piece = np.full((n, width), NEVER, np.int32), np.full((n, width), -1, np.int32)
        pair = place < sizes[:, None] - 1
        rank[pair], piece[pair] = self._pairs(
            np.repeat(keys, sizes - 1), place[pair], sym[:, :-1][pair], sym[:, 1:][pair]
        )
        live = np.arange(n)
        while len(live):
            i = rank[live].argmin(1)
            go = rank[live, i] < NEVER
            live, i = live[go], i[go]
            if not len(live):
                break
            j = after[live, i].astype(np.int64)
            k = after[live, np.minimum(j, width - 1)].astype(np.int64)
            if log is not None:
                log.append((live, self.terms(i, sym[live, i], sym[live, j])))
            sym[live, i] = piece[live, i]
            sym[live, j] = -1
            rank[live, j] = NEVER
            after[live, i] = k
            before[live, k] = i
            h = before[live, i].astype(np.int64)
            has = h >= 0
            # The new piece with what stands behind it, and with what stands before it.
            w = np.concatenate([live, live[has]])
            at = np.concatenate([i, h[has]])
            right = np.concatenate([sym[live, k], sym[live[has], i[has]]])
            rank[w, at], piece[w, at] = self._pairs(keys[w], at, sym[w, at], right)
        kept = sym >= 0
        return sym[kept], kept.sum(1)

    def segment(
        self, units: Sequence[str], keys: np.ndarray, log: list | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all units in a row, and how many each has; ``keys`` are what their hashes start from.

        A ``log`` takes the merges of the units that are worked off together, step by step.
        """
        flat, sizes = self.p.symbols(units)
        which = np.searchsorted(np.array(WIDTHS) - 1, sizes)
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in range(len(WIDTHS) + 1):
            at = np.flatnonzero(which == n)
            if not len(at):
                continue
            own = flat[np.repeat(which == n, sizes)]
            if n < len(WIDTHS):
                steps: list | None = None if log is None else []
                got.append((at, *self.together(own, sizes[at], keys[at], WIDTHS[n], steps)))
                if log is not None:
                    log.extend((at[rows], terms) for rows, terms in steps)
            else:
                rows = np.split(own, np.cumsum(sizes[at])[:-1])
                long = [self.alone(r, int(k)) for r, k in zip(rows, keys[at])]
                got.append((at, np.array([x for r in long for x in r], np.int32), np.array([len(r) for r in long])))
        out_sizes = np.zeros(len(units), np.int64)
        for at, _, count in got:
            out_sizes[at] = count
        out = np.empty(int(out_sizes.sum()), np.int32)
        starts = np.cumsum(out_sizes) - out_sizes
        for at, ids, count in got:
            begin = np.cumsum(count) - count
            out[np.arange(len(ids)) + np.repeat(starts[at] - begin, count)] = ids
        return out, out_sizes


class Encoder:
    """Texts to pieces; units seen before are worked off anew only where dropout changes them."""

    def __init__(self, path: str, s: DropoutSettings, known: int = KNOWN):
        self.p, self.s, self.known = Pieces(path), s, known
        self.segmenter = Segmenter(self.p, s)
        self.plain = Segmenter(self.p, DropoutSettings(0.0, s.seed))
        self._empty()

    def _empty(self) -> None:
        # Unit 0 stands for all that are too long to be kept.
        self.number: dict[str, int] = {}
        self.start, self.ids = array("q", [0, 0]), array("i")
        self.first, self.terms = array("q", [0, 0]), array("Q")

    def _learn(self, units: list[str]) -> None:
        # Plain pieces of units and the terms of the merges that lead to them.
        log: list[tuple[np.ndarray, np.ndarray]] = []
        ids, counts = self.plain.segment(units, np.zeros(len(units), np.uint64), log)
        rows = np.concatenate([np.zeros(0, np.int64), *[r for r, _ in log]])
        terms = np.concatenate([np.zeros(0, np.uint64), *[t for _, t in log]])[np.argsort(rows, kind="stable")]
        merges = np.bincount(rows, minlength=len(units))
        self.number.update(zip(units, range(len(self.start) - 1, len(self.start) - 1 + len(units))))
        self.start.frombytes((self.start[-1] + np.cumsum(counts)).astype(np.int64).tobytes())
        self.first.frombytes((self.first[-1] + np.cumsum(merges)).astype(np.int64).tobytes())
        self.ids.frombytes(ids.astype(np.int32).tobytes())
        self.terms.frombytes(terms.tobytes())

    def _changed(self, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        # Whether dropout passes over a plain merge of a unit; always for those that are not kept.
        first, terms = np.frombuffer(self.first, np.int64), np.frombuffer(self.terms, np.uint64)
        out = at == 0
        for x in range(0, len(at) if self.segmenter.floor else 0, 4 * UNITS):
            own = at[x : x + 4 * UNITS]
            size = first[own + 1] - first[own]
            ends = np.cumsum(size)
            spot = np.arange(int(ends[-1])) + np.repeat(first[own] - (ends - size), size)
            hit = self.segmenter.below(np.repeat(keys[x : x + 4 * UNITS], size), terms[spot])
            total = np.concatenate([[0], np.cumsum(hit)])
            out[x : x + 4 * UNITS] |= total[ends] > total[ends - size]
        return out

    def units(self, text: str) -> list[str]:
        """Units of a text: a blank is put in front of it, line ends begin units too."""
        if not text:
            return []
        parts = text.replace("\n", " \n").split(" ")
        if "" in parts:
            return [u for line in re.split("(?=\n)", " " + text) for u in _UNIT.findall(line)]
        return [p if p[0] == "\n" and n else " " + p for n, p in enumerate(parts)]

    def variant(self, key) -> int:
        """The document's hash."""
        return xxhash.xxh3_64_intdigest(f"{self.s.seed}:{key}".encode())

    def keys(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What the hashes of all units start from: their documents and their numbers there."""
        ends = np.cumsum(counts)
        number = np.arange(1, int(counts.sum()) + 1) - np.repeat(ends - counts, counts)
        with np.errstate(over="ignore"):
            return mixed(np.repeat(hashes, counts) + number.astype(np.uint64) * np.uint64(_M2))

    def encode(self, keys: Sequence, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all texts in a row, and the end of each text's pieces."""
        if len(self.number) > self.known:
            self._empty()
        hashes = np.array([self.variant(k) for k in keys], np.uint64)
        split = [self.units(t) for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        units = list(chain.from_iterable(split))
        # Characters may become four bytes each; the widest arrays then still hold a unit that is kept.
        new = [u for u in dict.fromkeys(units) if u not in self.number and len(u) < WIDTHS[-1] // 4]
        for x in range(0, len(new), UNITS):
            self._learn(new[x : x + UNITS])
        at = np.fromiter((self.number.get(u, 0) for u in units), np.int64, len(units))
        each = self.keys(hashes, counts)
        other = np.flatnonzero(self._changed(at, each))
        made = [
            self.segmenter.segment([units[i] for i in part.tolist()], each[part])
            for part in (other[x : x + UNITS] for x in range(0, len(other), UNITS))
        ]
        start = np.frombuffer(self.start, np.int64)
        kept = np.frombuffer(self.ids, np.int32)
        first, size = start[at], start[at + 1] - start[at]
        if made:
            own = np.concatenate([sizes for _, sizes in made])
            size[other], first[other] = own, len(kept) + np.cumsum(own) - own
        flat = np.concatenate([kept, *[ids for ids, _ in made]])
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.arange(total) + np.repeat(first - (ends - size), size)]
        return ids, np.concatenate([[0], ends])[np.cumsum(counts)]


@functools.cache
def encoder(path: str, s: DropoutSettings) -> Encoder:
    """The worker's encoder."""
    return Encoder(path, s)


def encode(docs: DataFrame, path: str, s: DropoutSettings, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """Key, n_tokens, ids_crc32, lossless (and the ids) of every row; whole texts, in place."""
    key_type = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, n_tokens long, ids_crc32 long, lossless boolean"
    names = [key, "n_tokens", "ids_crc32", "lossless"] + ["ids"] * ids

    def run(batches) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, s)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = [t or "" for t in part.column("text").to_pylist()]
                flat, ends = enc.encode(part.column(key).to_pylist(), texts)
                each = np.split(flat.astype("<u4"), ends[:-1])
                columns = [
                    part.column(key),
                    pa.array([len(e) for e in each], pa.int64()),
                    pa.array([zlib.crc32(np.ascontiguousarray(e)) for e in each], pa.int64()),
                    pa.array(came_back(enc.p, flat, each, texts), pa.bool_()),
                ]
                if ids:
                    columns.append(pa.array([e.astype(np.int32) for e in each], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(key, "text").mapInArrow(run, schema + ", ids array<int>" * ids)


def came_back(p: Pieces, flat: np.ndarray, each: list[np.ndarray], texts: list[str]) -> list[bool]:
    """Whether each row's pieces decode to its text."""
    if p.decode_bytes(flat).tobytes() == "".join(" " + t for t in texts if t).encode():
        return [True] * len(texts)
    return [p.decode(e) == t for e, t in zip(each, texts)]


def op4(spark, folder):
    """Every document encoded with merge-dropout, and whether it decodes to itself."""
    docs = table(spark, folder, "documents")
    return encode(docs, vocabulary("piece_bpe_32k.model"), DropoutSettings(), ids=False)
