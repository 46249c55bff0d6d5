"""Truncated means of groups of any size, by exact selection with histograms instead of sorted arrays.

The mean leaves out the lowest and the highest fifth. Where these end is found by counting: the range of a group's values is
parted into equal steps, values are counted by step, and the step that holds the wanted rank becomes the next range, from the
least to the greatest value found in it. A range that holds one value only is the answer. One more pass adds up what lies
between the two ends, and takes of the values equal to an end as many as are left. Rows are counted before they are
shuffled, so a group may hold any share of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from babelshelf.functions.means import TRIM
from babelshelf.storage import cut, drop_cut

#: Steps of a range, and ranges (of some ten bytes and the keys) that are broadcast; more are joined by a shuffle.
STEPS = 256
BROADCAST_ROWS = 200_000


def _scale(value: Column) -> Column:
    """The order of magnitude with its sign, which never falls where the value rises."""
    return F.when(value == 0, F.lit(0.0)).otherwise(F.signum(value) * (F.ln(F.abs(value)) + 750))


def _step(value: Column, low: Column, high: Column, by_scale: bool) -> Column:
    """The step of a value between ``low`` and ``high``: 0 for the least, the last for the greatest, never falling between.

    Steps are of equal width, or of equal width in magnitude. Halves keep the width of the widest range finite.
    """
    of = _scale if by_scale else lambda x: x / 2
    share = F.try_divide(of(value) - of(low), of(high) - of(low))
    inner = F.least(F.floor(share * STEPS), F.lit(STEPS - 1)).cast("int")
    return F.coalesce(inner, F.when(value > low, F.lit(STEPS - 1)).otherwise(F.lit(0)))


def _with(rows: DataFrame, ends: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows with their group's ``ends``; keys that are null are equal."""
    other = ends.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(c for c in ends.columns if c not in keys))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)), F.lit(True))
    joined = rows.join(F.broadcast(other) if n <= BROADCAST_ROWS else other, same)
    return joined.drop(*(f"__k{i}" for i in range(len(keys))))


def truncated_means(rows: DataFrame, keys: list[str], value: str, name: str = "mean") -> DataFrame:
    """(*keys, ``name``): the truncated mean of each group, as ``means.truncated`` gives it but for the order of its sum.

    Null values and such that aren't finite don't count; a group without others has no row, nor has an empty table. Values
    that tie with an end are interchangeable. Every second round parts the range by magnitude, so that
    values over many powers of ten take few rounds as well: one for each factor of ``STEPS`` by which they are apart.
    """
    x = F.col("__x")
    finite = F.col(value).cast("double").between(-1.7976931348623157e308, 1.7976931348623157e308)
    given, keys = keys, [f"__g{i}" for i in range(len(keys))]  # names that none of the columns here has
    kept = rows.where(finite).select(*(F.col(k).alias(g) for k, g in zip(given, keys, strict=True)), F.col(value).cast("double").alias("__x"))
    trim = F.floor(F.col("n") / TRIM)
    whole = kept.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__x").alias("low"), F.max("__x").alias("high")).withColumn("trim", trim)
    groups = cut(whole, "groups")
    n = groups.count()
    ends = F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("trim").alias("rank")), F.struct(F.lit(1).alias("end"), (F.col("n") - F.col("trim") - 1).alias("rank"))))
    open_ = groups.withColumn("__e", ends).select(*keys, "low", "high", F.col("__e.end").alias("end"), F.col("__e.rank").alias("rank"))
    found, made = [], []
    while True:
        settled = F.col("low") == F.col("high")
        found.append(open_.where(settled).select(*keys, "end", F.col("low").alias("at")))
        wide = open_.where(~settled)
        n_wide = wide.count()
        if not n_wide:
            break
        within = _with(kept, wide, keys, n_wide).where(x.between(F.col("low"), F.col("high")))
        steps = within.groupBy(*keys, "end", "rank", _step(x, F.col("low"), F.col("high"), len(made) % 2 == 1).alias("step")).agg(F.count("*").alias("n"), F.min("__x").alias("low"), F.max("__x").alias("high"))
        order = Window.partitionBy(*keys, "end").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
        told = steps.withColumn("to", F.sum("n").over(order)).withColumn("from", F.col("to") - F.col("n"))
        open_ = cut(told.where((F.col("from") <= F.col("rank")) & (F.col("rank") < F.col("to"))).select(*keys, "low", "high", "end", (F.col("rank") - F.col("from")).alias("rank")), "ranges")
        made.append(open_)
    pair = reduce(DataFrame.unionAll, found).groupBy(*keys).agg(F.max(F.when(F.col("end") == 0, F.col("at"))).alias("a"), F.max(F.when(F.col("end") == 1, F.col("at"))).alias("b"))
    pair = cut(pair, "ends")
    for ranges in made:
        drop_cut(ranges)
    a, b = F.col("a"), F.col("b")
    sums = _with(kept, pair, keys, n).groupBy(*keys, "a", "b").agg(
        F.count("*").alias("n"), F.sum(F.when((x > a) & (x < b), x).otherwise(0.0)).alias("inner"), F.count_if(x <= a).alias("to_a"), F.count_if(x < b).alias("below_b")
    ).withColumn("trim", trim)
    left = F.col("n") - 2 * F.col("trim")
    total = F.col("inner") + a * (F.col("to_a") - F.col("trim")) + b * (F.col("n") - F.col("trim") - F.col("below_b"))
    return sums.select(*(F.col(g).alias(k) for k, g in zip(given, keys, strict=True)), F.when(a == b, a).otherwise(total / left).alias(name))
