"""What a log of attempts says of a classifier's retries: counts, device, reserve and lasting failure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from babelshelf.functions import numeric

LIMIT, FALL_BACK_AT = 10, 5


def tracked(attempts: DataFrame, key: str, order: str, ok: str, limit: int = LIMIT, fall_back_at: int = FALL_BACK_AT) -> DataFrame:
    """Adds retries, device, scale and failed to attempts with a boolean ``ok`` (null: not ok).

    ``retries`` counts the attempts that ran out of memory since the last one that did not; from the fifth on the device
    is the processor, each shrinks the segment by a fixed share, and after more than ten ``failed`` stays true. A task
    orders the attempts of one ``key``; attempts that tie in ``order`` may stand either way.
    """
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    good = F.coalesce(F.col(ok), F.lit(False))
    runs = attempts.withColumn("__run", F.count_if(good).over(before))
    within = Window.partitionBy(key, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = runs.withColumn("retries", F.count_if(~good).over(within).cast("int")).drop("__run")
    return counted.withColumns({
        "device": F.when(F.col("retries") >= fall_back_at, "cpu").otherwise("gpu"), "scale": numeric.shrunk(F.lit(1.0), F.least(F.col("retries"), F.lit(limit))),
        "failed": F.bool_or(F.col("retries") > limit).over(before),
    })
