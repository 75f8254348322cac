"""Unigrams and bigrams of Arrow batches of texts: words as numbers, pairs of words as pairs of numbers.

Texts come lower-cased. Words are runs of two or more word characters. Within a batch every different
word has a number; a term is a word's number or that of a pair, so counting is numpy's work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that are counted at a time.
STEP = 16 << 20
# Other characters beyond ASCII; those left there are word characters.
_NO_WORD = r"[^\x00-\x7f\p{L}\p{M}\p{N}]+"
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*b"0123456789_ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True


def steps(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of a batch of some bytes each, one text at least; NULL as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // STEP
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        yield pa.concat_arrays([texts.slice(a, b - a)])


class Terms:
    """The terms of some texts: ``words`` by number, and ``doc``, ``word`` of every place."""

    def __init__(self, texts: pa.Array):
        if not pc.all(pc.string_is_ascii(texts)).as_py():
            texts = pc.replace_substring_regex(texts, _NO_WORD, " ")
        texts = pa.concat_arrays([texts])
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        inside = _WORD_BYTE[raw]
        first = np.zeros(len(raw) + 1, bool)
        first[at] = True
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        begins = np.flatnonzero(inside & (~before | first[:-1]))
        ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        # A character's later bytes are 10xxxxxx.
        signs = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        long = signs[ends] - signs[begins] > 1
        lone = begins[~long], ends[~long]
        begins, ends = begins[long], ends[long]
        edge = np.zeros(len(raw) + 1, np.int8)
        np.add.at(edge, lone[0], 1)
        np.add.at(edge, lone[1], -1)
        kept = raw[inside & (np.cumsum(edge[:-1]) == 0)]
        offsets = np.concatenate([[0], np.cumsum(ends - begins)])
        coded = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(kept)).dictionary_encode()
        self.words = coded.dictionary
        self.word = coded.indices.to_numpy().astype(np.int64)
        self.doc = np.searchsorted(at, begins, "right") - 1
        self.docs = len(texts)
        # Places whose next word stands in the same text.
        self.pairs = np.flatnonzero(self.doc[1:] == self.doc[:-1])

    def hashes(self) -> np.ndarray:
        """A hash of every word's place and of every pair's."""
        names = np.array(self.words.to_pylist(), object)
        h = pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, np.uint64)
        one = h[self.word]
        two = one[self.pairs] * np.uint64(0x9E3779B97F4A7C15) + one[self.pairs + 1]
        every = np.concatenate([one, two])
        every ^= every >> np.uint64(31)
        every *= np.uint64(0xD6E8FEB86659FD93)
        return every ^ (every >> np.uint64(32))

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of the term and of the text, for every word's place and every pair's."""
        n = max(len(self.words), 1)
        two = n + self.word[self.pairs] * n + self.word[self.pairs + 1]
        return np.concatenate([self.word, two]), np.concatenate([self.doc, self.doc[self.pairs]])

    def names(self, keys: np.ndarray) -> pa.Array:
        """The terms of some numbers."""
        n = max(len(self.words), 1)
        single = keys < n
        rest = keys - n
        first = self.words.take(pa.array(np.where(single, keys, rest // n)))
        second = self.words.take(pa.array(np.where(single, 0, rest % n)))
        return pc.if_else(pa.array(single), first, pc.binary_join_element_wise(first, second, pa.scalar(" ", first.type)))


def _slots(hashes: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64(slots - 1)
    return (hashes & low).astype(np.int64), ((hashes >> np.uint64(32)) & low).astype(np.int64) + slots


def slot_counter(slots: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of the terms' places in two rows of hash slots (``slots``: a power of two): slot, total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * slots, np.int64)
        for batch in batches:
            for texts in steps(batch.column(0)):
                for row in _slots(Terms(texts).hashes(), slots):
                    sums += np.bincount(row, minlength=2 * slots)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["slot", "total"])

    return run


def term_counter(
    slots: int, heavy: bytes | None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Exact counts per step of the terms whose slots are both marked in the bits ``heavy``, or of all
    terms: term, total, df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = None if heavy is None else np.unpackbits(np.frombuffer(heavy, np.uint8)).view(bool)
        for batch in batches:
            for texts in steps(batch.column(0)):
                terms = Terms(texts)
                key, doc = terms.keys()
                if marks is not None:
                    one, other = _slots(terms.hashes(), slots)
                    fit = marks[one] & marks[other]
                    key, doc = key[fit], doc[fit]
                found, at, total = np.unique(key, return_inverse=True, return_counts=True)
                df = np.bincount(np.unique(at * terms.docs + doc) // terms.docs, minlength=len(found))
                yield pa.RecordBatch.from_arrays(
                    [terms.names(found).cast(pa.string()), pa.array(total), pa.array(df)], ["term", "total", "df"]
                )

    return run


class Vocabulary:
    """Known terms: finds them in texts and gives their weights."""

    def __init__(self, terms: Sequence[str], idf: Sequence[float]):
        parts = [t.split(" ") for t in terms]
        listed = sorted({w for p in parts for w in p})
        number = {w: n for n, w in enumerate(listed)}
        self.words = pa.array(listed, pa.large_string())
        self.idf = np.array(idf, float)
        self.single = np.full(len(listed) + 1, -1)
        double = []
        for n, p in enumerate(parts):
            if len(p) == 1:
                self.single[number[p[0]]] = n
            elif len(p) == 2:
                double.append((number[p[0]] * len(listed) + number[p[1]], n))
        double.sort()
        self.pair = np.array([k for k, _ in double], np.int64)
        self.pair_term = np.array([n for _, n in double], np.int64)

    def weights(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and weight (1 + ln tf) x idf of every term in a text, rows of length 1."""
        terms = Terms(texts)
        known = pc.fill_null(pc.index_in(terms.words, self.words), len(self.words)).to_numpy(zero_copy_only=False)
        word = known.astype(np.int64)[terms.word]
        found, doc = [self.single[word]], [terms.doc]
        one, two = word[terms.pairs], word[terms.pairs + 1]
        both = (one < len(self.words)) & (two < len(self.words))
        if len(self.pair):
            key = one[both] * len(self.words) + two[both]
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            found.append(np.where(self.pair[at] == key, self.pair_term[at], -1))
            doc.append(terms.doc[terms.pairs][both])
        found, doc = np.concatenate(found), np.concatenate(doc)
        n = max(len(self.idf), 1)
        cell, tf = np.unique((doc * n + found)[found >= 0], return_counts=True)
        doc, term = cell // n, cell % n
        w = (1 + np.log(tf)) * self.idf[term]
        norm = np.sqrt(np.bincount(doc, w * w, minlength=terms.docs))
        return doc, term, w / norm[doc]
