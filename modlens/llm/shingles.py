"""Word shingles of whole texts as sorted 64-bit hashes, worked off in blocks of documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    np.uint64,
)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Block:
    """Shingle sets of some documents: hashes in document order, sorted inside a document."""

    number: int
    keys: list
    sizes: np.ndarray
    hashes: np.ndarray
    owner: np.ndarray

    def signs(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits per document that depend on its set only; 0 for an empty set."""
        ends = np.cumsum(self.sizes)
        out = []
        for salt in _ODD[:2]:
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.hashes ^ salt), dtype=np.uint64)])
            out.append((total[ends] - total[ends - self.sizes]).view(np.int64))
        return out[0], out[1]


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, owners and set sizes: distinct shingles of ``words`` words; the whole text if shorter."""
    split = [(t or "").encode().translate(_LOWER).split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter(
        map(xxhash.xxh3_64_intdigest, (w for own in split for w in own)), np.uint64, int(counts.sum())
    )
    doc = np.repeat(np.arange(len(split)), counts)
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(len(flat))  # words from here to the text's end
    total = np.zeros(len(flat), np.uint64)
    for k in range(min(words, len(flat))):
        total[: len(flat) - k] += flat[k:] * _ODD[k % 5] + np.uint64(k // 5)
    begins = left >= words
    hashes, owner = mix(total[begins]), doc[begins]
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for n, d in enumerate(short.tolist()):
            own = flat[ends[d] - counts[d] : ends[d]]
            extra[n] = mix((own * _ODD[np.arange(len(own)) % 5]).sum(keepdims=True) + np.uint64(len(own)))[0]
        hashes, owner = np.concatenate([hashes, extra]), np.concatenate([owner, short])
    order = np.argsort(hashes)
    order = order[np.argsort(owner[order].astype(np.uint16), kind="stable")]
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, owner, np.bincount(owner, minlength=len(texts))


def blocks(batches, words: int, key: str = "doc_id", most_docs: int = 8000, most_bytes: int = 8_000_000) -> Iterator[Block]:
    """Blocks of the rows of one task, numbered by task and place, alike in every run of the task."""
    part = TaskContext.get().partitionId()
    n = 0
    keys: list = []
    texts: list = []
    size = 0

    def block() -> Block:
        hashes, owner, sizes = shingle_sets(texts, words)
        return Block((part << 32) + n, list(keys), sizes, hashes, owner)

    for batch in batches:
        for k, t in zip(batch.column(key).to_pylist(), batch.column("text").to_pylist()):
            keys.append(k)
            texts.append(t)
            size += len(t or "")
            if len(keys) >= most_docs or size >= most_bytes:
                yield block()
                n, size = n + 1, 0
                keys.clear()
                texts.clear()
    if keys:
        yield block()


def as_blob(x: np.ndarray) -> bytes:
    """The bytes of an array."""
    return np.ascontiguousarray(x).tobytes()


def long_array(values: list) -> pa.Array:
    """Integers with nulls."""
    return pa.array(values, pa.int64())
