"""Small helpers over array columns."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Spark re-evaluates an expression at each place it is used inside a lambda; binding it as
    the variable of a one-element ``transform`` avoids that.
    """
    return F.transform(F.array(value), body)[0]


def with_fields(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """The frame with costly columns that are computed once per row.

    A filter on a plain derived column is pushed below it, and the derivation is then done once
    more for the filter. Filters do not pass a generator, so the columns come out of a
    one-element ``inline``. Columns of the same name are replaced.
    """
    rest = [c for c in df.columns if c not in fields]
    row = F.struct(*[c.alias(n) for n, c in fields.items()])
    return df.select(*rest, F.inline(F.array(row)))


def literal(value: object, dtype: str) -> Column:
    """A constant array or map as one literal: planning stays short however long it is."""
    return F.from_json(F.lit(json.dumps(value)), dtype)


def string_array(values: Iterable[str]) -> Column:
    """A constant array of strings."""
    return literal(list(values), "array<string>")


def string_map(values: dict[str, str]) -> Column:
    """A constant map of strings."""
    return literal(values, "map<string,string>")


def array_total(values: Column, dtype: str = "bigint") -> Column:
    """Sum of an array, 0 when empty."""
    return F.aggregate(values, F.lit(0).cast(dtype), lambda a, x: a + x.cast(dtype))


def running_totals(values: Column) -> Column:
    """Inclusive running sums of an array of integers.

    Works in blocks of 64, so a text with very many matches costs about 64 steps per element
    and not one step per pair of elements.
    """

    def from_blocks(vals: Column, offsets: Column) -> Column:
        return F.transform(
            vals,
            lambda _, i: offsets[F.floor(i / _BLOCK).cast("int")]
            + array_total(
                F.slice(vals, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK + 1)
            ),
        )

    def starts(sums: Column) -> Column:
        # Sum of all blocks before each block, in one fold.
        return F.aggregate(
            sums,
            F.array(F.lit(0).cast("bigint")),
            lambda out, x: F.concat(out, F.array(F.element_at(out, -1) + x)),
        )

    def body(vals: Column) -> Column:
        n_blocks = F.ceil(F.size(vals) / _BLOCK).cast("int")
        block_sums = F.transform(
            F.sequence(F.lit(0), F.greatest(n_blocks - 1, F.lit(0))),
            lambda b: array_total(F.slice(vals, b * _BLOCK + 1, F.lit(_BLOCK))),
        )
        return let(
            block_sums,
            lambda sums: let(
                starts(sums),
                lambda offsets: from_blocks(vals, offsets),
            ),
        )

    return let(values, body)
