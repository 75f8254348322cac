"""Words of UTF-8 texts: runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _folded(b: int) -> int:
    if 0x41 <= b <= 0x5A:
        return b + 32
    return b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20


# Every byte beyond ASCII belongs to a word, so the bytes of a text can be cut without decoding it.
FOLD = bytes(map(_folded, range(256)))
# The same words as a pattern over lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split_words(raw: bytes) -> list[bytes]:
    """The words of a text's bytes, in order."""
    return raw.translate(FOLD).split()


def raw_texts(column: pa.Array) -> list[bytes]:
    """The bytes of a text column; null is empty."""
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, texts: int = 500, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``texts`` rows and, but for single long texts, ``size`` bytes of text."""
    long = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(long)])
    at = 0
    while at < batch.num_rows:
        to = min(at + texts, max(at + 1, int(np.searchsorted(before, before[at] + size, "right")) - 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


class Numbered(dict):
    """Words numbered in the order in which they are first asked for."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, … of all spans, one span after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - size), size)
