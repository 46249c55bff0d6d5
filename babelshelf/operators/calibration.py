"""Memory model calibration: least-squares fits by sums, and their residuals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelshelf.storage import cut

ACCEPTED = 0.05
#: So many keys' centres are sent to all tasks, at most; more of them are shuffled with the samples.
BROADCAST_ROWS = 50_000


def linear(samples: DataFrame, key: str) -> DataFrame:
    """(key, m, c) of y = c + m x over samples (key, x, y)."""
    return samples.groupBy(key).agg(F.regr_slope("y", "x").alias("m"), F.regr_intercept("y", "x").alias("c"))


def quadratic(samples: DataFrame, key: str) -> DataFrame:
    """(key, a, b, c) of y = c + b x + a x^2: normal equations of centred sums, solved by Cramer's rule."""
    centre = samples.groupBy(key).agg(F.avg("x").alias("__x"), F.avg("y").alias("__y"))
    centre = cut(centre, "centres")
    rows = samples.join(F.broadcast(centre) if centre.count() <= BROADCAST_ROWS else centre.hint("merge"), key).select(key, "__x", "__y", (F.col("x") - F.col("__x")).alias("u"), (F.col("y") - F.col("__y")).alias("v"))
    u, v = F.col("u"), F.col("v")
    s = rows.groupBy(key, "__x", "__y").agg(F.count("*").alias("n"), F.sum(u * u).alias("s2"), F.sum(u * u * u).alias("s3"), F.sum(u * u * u * u).alias("s4"), F.sum(u * v).alias("t1"), F.sum(u * u * v).alias("t2"))
    n, s2, s3, s4, t1, t2 = (F.col(x) for x in ("n", "s2", "s3", "s4", "t1", "t2"))
    det = s2 * s4 - s3 * s3 - s2 * s2 * s2 / n
    a, b = F.try_divide(s2 * t2 - s3 * t1, det), F.try_divide(t1 * (s4 - s2 * s2 / n) - s3 * t2, det)
    solved = s.select(key, "__x", "__y", (s2 / n).alias("mean2"), a.alias("a"), b.alias("b0"))
    x, y = F.col("__x"), F.col("__y")
    b1 = F.col("b0") - 2 * F.col("a") * x
    return solved.select(key, "a", b1.alias("b"), (y - F.col("a") * F.col("mean2") - F.col("b0") * x + F.col("a") * x * x).alias("c"))


def residuals(samples: DataFrame, fits: DataFrame, key: str) -> DataFrame:
    """(key, degree, residual, accepted, place): mean relative residuals of fits (key, degree, c, b, a), best first.

    The mean of (y - (c + b x + a x^2)) / y comes from those of 1 / y, x / y and x^2 / y, so that samples are summed by key
    before they meet the fits.
    """
    x, y = F.col("x"), F.col("y")
    means = samples.groupBy(key).agg(*(F.avg(F.when(x.isNotNull() & y.isNotNull(), top / y)).alias(name) for name, top in (("__0", F.lit(1.0)), ("__1", x), ("__2", x * x))))
    residual = 1 - (F.col("c") * F.col("__0") + F.col("b") * F.col("__1") + F.col("a") * F.col("__2"))
    rows = fits.join(means, key).select(key, "degree", residual.alias("residual"))
    place = F.expr(f"CAST(row_number() OVER (PARTITION BY {key} ORDER BY abs(round(residual, 9)), degree) AS INT)")
    return rows.withColumn("accepted", F.abs("residual") <= ACCEPTED).withColumn("place", place)
