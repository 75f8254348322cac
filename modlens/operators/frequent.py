"""The most frequent terms of a corpus without a shuffle of all its terms.

A first pass adds the counts of the terms into two rows of hash slots, which sum up per partition and
over partitions; a term's count is at most the sum of each of its slots. A second pass counts
exactly the terms whose slots both reach a floor. If as many of them as were asked for reach the floor
themselves, no other term can be among the first. Otherwise all terms are counted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlens.operators.ranking import most_frequent_of
from modlens.session import checkpointed

# Slots of each row for every term asked for.
SLOTS_PER_TERM = 32


def slot_rows(k: int) -> int:
    """Slots of a row for ``k`` terms: a power of two."""
    return 1 << max(k * SLOTS_PER_TERM - 1, 1).bit_length()


def _slots(term: Column, slots: int) -> tuple[Column, Column]:
    # The two rows use bits of the hash that do not overlap up to 2^32 slots.
    h = F.xxhash64(term)
    return F.pmod(h, F.lit(slots)), F.pmod(F.shiftright(h, 32), F.lit(slots)) + slots


def slot_sums(pairs: DataFrame, slots: int) -> DataFrame:
    """Sums of ``tf`` per slot; at most ``2 * slots`` rows leave a partition."""
    both = F.explode(F.array(*_slots(F.col("term"), slots)))
    return pairs.select(both.alias("slot"), "tf").groupBy("slot").agg(F.sum("tf").alias("total"))


def reaching(pairs: DataFrame, sums: DataFrame, slots: int, floor: int) -> DataFrame:
    """The pairs whose slots both reach the floor: all terms that do, and few others."""
    one, other = _slots(F.col("term"), slots)
    out = pairs.withColumns({"_one": one, "_other": other})
    heavy = sums.filter(F.col("total") >= floor)
    for name in ("_one", "_other"):
        # At most 2 x slots numbers, which the number of terms asked for bounds.
        out = out.join(F.broadcast(heavy.select(F.col("slot").alias(name))), name, "left_semi")
    return out.drop("_one", "_other")


def term_counts(pairs: DataFrame) -> DataFrame:
    """Total and number of documents of every term."""
    return pairs.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))


def frequent_terms(pairs: DataFrame, k: int, slots: int | None = None) -> DataFrame:
    """The ``k`` terms of greatest total: term, total, df; ties by term.

    ``pairs`` holds a row (term, tf) for each document and term, and is read twice, or three times
    where the floor proves too high; hand in one whose texts are written. With fewer than ``k``
    terms all are returned; without rows the result is empty.
    """
    slots = slots or slot_rows(k)
    return first_terms(
        k, slots, slot_sums(pairs, slots), lambda sums, floor: term_counts(reaching(pairs, sums, slots, floor) if floor else pairs)
    )


def first_terms(
    k: int, slots: int, sums: DataFrame, counts_from: Callable[[DataFrame, int], DataFrame]
) -> DataFrame:
    """The ``k`` terms of greatest total by slot sums and a function that counts the terms whose slots
    both reach a floor, or all of them for the floor 0."""
    sums = checkpointed(sums)
    kth = sums.filter(F.col("slot") < slots).orderBy(F.col("total").desc()).offset(k - 1).limit(1).first()
    # A slot holds rare terms besides a frequent one, so the floor stays below the slot's sum.
    floor = kth["total"] // 2 if kth else 0
    if floor > 1:
        counts = checkpointed(counts_from(sums, floor))
        if counts.filter(F.col("total") >= floor).limit(k).count() == k:
            return most_frequent_of(counts, "total", [F.col("term")], k)
    return most_frequent_of(checkpointed(counts_from(sums, 0)), "total", [F.col("term")], k)
