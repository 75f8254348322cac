"""Column expressions over predictions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from modlens import lexicons as lx

EPSILON = 1e-7


def binned(p: Column, bins: Sequence[tuple[float, float, str]] = lx.CONFIDENCE_BINS) -> Column:
    """Name of the right-closed bin of a score; NULL outside (0, 1]."""
    out = F.lit(None).cast("string")
    for low, high, name in reversed(bins):
        out = F.when((p > low) & (p <= high), F.lit(name)).otherwise(out)
    return out


def bin_rank(name: Column, bins: Sequence[tuple[float, float, str]] = lx.CONFIDENCE_BINS) -> Column:
    """Position of a bin name, 1 for the lowest."""
    pos = F.array_position(F.array(*[F.lit(b[2]) for b in bins]), name)
    return F.nullif(pos, F.lit(0)).cast("int")


def class_name(y: Column) -> Column:
    """Readable class."""
    return F.when(y == 1, F.lit("Toxic")).otherwise(F.lit("Non-toxic"))


def borderline(p: Column, low: float = 0.4, high: float = 0.6) -> Column:
    """True strictly between the two limits."""
    return (p > low) & (p < high)


def confidently_right(p: Column, y: Column, high: float = 0.9, low: float = 0.1) -> Column:
    """Scores far from the middle on the side of the true class."""
    return ((p > high) & (y == 1)) | ((p < low) & (y == 0))


def focal_loss(gamma: float = 2.0) -> Callable[[Column, Column, Column], Column]:
    """Row-wise focal loss as a function of (y, p, alpha) columns; its mean is the loss.

    A positive row adds -alpha (1-p)^gamma ln p, a negative one -(1-alpha) p^gamma ln(1-p). The
    other term is taken at the clip limit, as the clipped score of a row of the other class.
    """

    def clip(v: Column) -> Column:
        return F.greatest(F.lit(EPSILON), F.least(v, F.lit(1.0 - EPSILON)))

    def loss(y: Column, p: Column, alpha: Column) -> Column:
        p1 = clip(F.when(y == 1, p).otherwise(F.lit(1.0)))
        p0 = clip(F.when(y == 0, p).otherwise(F.lit(0.0)))
        positive = alpha * F.pow(1 - p1, F.lit(gamma)) * F.log(p1)
        negative = (1 - alpha) * F.pow(p0, F.lit(gamma)) * F.log(1 - p0)
        return -positive - negative

    return loss
