"""Episodes that a season lacks, and those it has more than once (an extension: the catalogue only declares them).

A number is missing if it lies between ``first`` and the greatest one of its season. Rows without a number, or with one
below ``first``, such as specials, don't count. A season without other rows has no result, nor has an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbers(episodes: DataFrame, season: list[str], number: str, first: int = 1) -> DataFrame:
    """(*season, number, copies): each number once, added up before rows are shuffled."""
    return episodes.where(F.col(number) >= first).groupBy(*season, F.col(number).alias("number")).agg(F.count("*").alias("copies"))


def missing(episodes: DataFrame, season: list[str], number: str, first: int = 1) -> DataFrame:
    """(*season, complete, first_missing, last_missing, n): a row for each range of missing numbers, one with nulls and
    ``complete`` for a season that lacks none.

    Each number is compared with the one before it, so a range takes no more room than its ends. One shuffle and one
    sort serve the counts and both windows; no season is held in memory. Null keys are keys like any other.
    """
    order = Window.partitionBy(*season).orderBy("number")
    before = F.coalesce(F.lag("number").over(order), F.lit(first - 1))
    rows = numbers(episodes, season, number, first).repartition(*season).withColumns({"before": before, "last": F.lead("number").over(order).isNull()})
    gap = F.col("number") - F.col("before") > 1
    told = rows.withColumn("gaps", F.count_if(gap).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    complete = F.col("last") & (F.col("gaps") == 0)
    of_gap = lambda value: F.when(gap, value)
    return told.where(gap | complete).select(
        *season, complete.alias("complete"), of_gap(F.col("before") + 1).alias("first_missing"), of_gap(F.col("number") - 1).alias("last_missing"), F.when(gap, F.col("number") - F.col("before") - 1).otherwise(0).alias("n")
    )


def duplicates(episodes: DataFrame, season: list[str], number: str, first: int = 1) -> DataFrame:
    """(*season, number, copies) of the numbers that a season has more than once."""
    return numbers(episodes, season, number, first).where("copies > 1")
