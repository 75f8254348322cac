"""Burrows-Wheeler transforms of shards of strings, merged by refining their interleave.

A shard's strings stand in one row of symbols, each closed by the end symbol 0. Its suffixes are
sorted by their first ``depth`` symbols once. Shards are then merged without sorting suffixes
again: the interleave of the shards' suffix orders, right for the first h symbols, is split by the
symbols in front of the suffixes (the transform), which makes it right for h + step symbols. Where two
neighbours part, their common prefix is known; a group that no step has parted at ``depth`` is a
repeated interval. Groups of one shard need no refining, as the shard knows its own order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Shard:
    """Sorted suffixes of a row of symbols: places in order, and their classes at the depth."""

    order: np.ndarray  # place of the n-th suffix
    rank: np.ndarray  # n of the suffix at a place
    same: np.ndarray  # class of the n-th suffix: number of the first one with equal first symbols

    @classmethod
    def sort(cls, row: np.ndarray, depth: int, bits: int) -> Shard:
        """Sort by the first symbols of ``bits`` bits each, doubling how many are known.

        Suffixes that differ from all others are in place; only ties are sorted on.
        """
        n = len(row)
        known = min(depth, 64 // bits)
        key = np.zeros(n, np.uint64)
        wide = row.astype(np.uint64)
        for k in range(known):
            key[: n - k] |= wide[k:] << np.uint64(bits * (known - 1 - k))
        order = np.argsort(key, kind="stable").astype(np.int32)
        sorted_key = key[order]
        new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
        same = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
        names = np.empty(n + 1, np.int32)
        names[n] = -1
        names[order] = same
        while known < depth:
            step = min(known, depth - known)
            first = np.flatnonzero(same[1:] == same[:-1])
            tied = np.zeros(n, bool)
            tied[first] = tied[first + 1] = True
            at = np.flatnonzero(tied)
            if not len(at):
                break
            place = order[at]
            left, right = same[at], names[np.minimum(place + step, n)]
            by = np.lexsort((right, left))
            left, right = left[by], right[by]
            order[at] = place[by]
            new = np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])]
            same[at] = np.maximum.accumulate(np.where(new, at, 0)).astype(np.int32)
            names[order[at]] = same[at]
            known += step
        rank = np.empty(n, np.int32)
        rank[order] = np.arange(n, dtype=np.int32)
        return cls(order, rank, same)


def merge(rows: list[np.ndarray], depth: int) -> list[np.ndarray]:
    """Per shard and place: the class of its first ``depth`` symbols among all shards."""
    used = np.zeros(65536, bool)
    used[0] = True
    for r in rows:
        used[r] = True
    width = int(used.sum())
    coded = [(np.cumsum(used) - 1).astype(np.uint16)[r] for r in rows]
    bits = max(1, (width - 1).bit_length())
    shards = [Shard.sort(r, depth, bits) for r in coded]
    base = np.cumsum([0] + [len(r) for r in rows])
    total = int(base[-1])
    # Two symbols a step where their pairs fit 16 bits, as those are split in linear time.
    step = 2 if width * width <= 65536 and depth % 2 == 0 else 1
    front = np.empty(total, np.uint16)  # transform: the symbols in front of the n-th suffix
    back = np.empty(total, np.int32)  # the suffix that starts with them
    own = np.empty(total, np.int64)  # class inside its shard
    which = np.empty(total, np.int8)
    for s, (shard, row) in enumerate(zip(shards, coded)):
        at = slice(base[s], base[s + 1])
        place = (shard.order - step) % len(row)
        value = row[place].astype(np.int64)
        if step == 2:
            value = value * width + row[(place + 1) % len(row)]
        front[at] = value
        back[at] = base[s] + shard.rank[place]
        own[at] = shard.same + base[s]
        which[at] = s
    mix = np.arange(total, dtype=np.int32)
    group = np.zeros(total, np.int32)
    for _ in range(depth // step):
        symbol = front[mix]
        split = np.argsort(symbol, kind="stable")
        symbol, old = symbol[split], group[split]
        mix = back[mix[split]]
        new = np.empty(len(mix), bool)
        new[:1] = True
        new[1:] = (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1])
        group = np.cumsum(new, dtype=np.int32) - 1
        # Groups of one shard are right already: a mixed one has two neighbours of different shards.
        kinds = which[mix]
        seam = (kinds[1:] != kinds[:-1]) & ~new[1:]
        mixed = np.zeros(int(group[-1]) + 1 if len(group) else 0, bool)
        mixed[group[1:][seam]] = True
        keep = mixed[group]
        mix, group = mix[keep], group[keep]
        if not len(mix):
            break
    # A repeated interval over several shards takes one number for all its shards' classes.
    out = own.copy()
    out[mix] = total + group.astype(np.int64)
    return [out[base[s] + shard.rank] for s, shard in enumerate(shards)]
