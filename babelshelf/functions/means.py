"""Means as aggregate expressions: arithmetic, geometric, harmonic and truncated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Each end of the sorted values loses one in five.
TRIM = 5


def arithmetic(value: Column) -> Column:
    return F.avg(value)


def geometric(value: Column) -> Column:
    """By logarithms, so that long products neither overflow nor vanish; a zero gives zero, negatives null."""
    logs = F.exp(F.avg(F.when(value > 0, F.ln(value))))
    return F.when(F.min(value) > 0, logs).when(F.min(value) == 0, F.lit(0.0))


def harmonic(value: Column, at_zero: float | None = None) -> Column:
    """Null if there is no value; ``at_zero`` if any is zero: null, or 0.0, the limit as a value falls to zero."""
    whole = F.try_divide(F.count(value).cast("double"), F.sum(F.try_divide(F.lit(1.0), value)))
    return F.when(~F.bool_or(value == 0), whole).when(F.bool_or(value == 0), F.lit(at_zero).cast("double"))


def truncated(value: Column) -> Column:
    return truncated_of(F.sort_array(F.collect_list(value)))


def truncated_of(ordered: Column) -> Column:
    """Truncated mean of a sorted array; null if it is empty."""
    n = F.size(ordered)
    cut = F.floor(n / TRIM).cast("int")
    kept = F.slice(ordered, cut + 1, F.greatest(n - 2 * cut, F.lit(0)))
    return F.when(n > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / (n - 2 * cut))


MEANS = {"arithmetic": arithmetic, "geometric": geometric, "harmonic": harmonic, "truncated": truncated}


def normalised(kind: str, value: Column) -> Column:
    """The mean of percentages from 0 to 100, scaled back to 0 to 1."""
    return MEANS[kind](value * 100) / 100
