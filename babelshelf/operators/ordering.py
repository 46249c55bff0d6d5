"""Row numbers within groups without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelshelf.storage import cut


def numbered(rows: DataFrame, groups: list[str], order: list[str], name: str = "position") -> DataFrame:
    """Adds the place of each row in its group, from 0, in ascending order of ``order`` (nulls first).

    Rows are range-partitioned by groups and order, and sorted and written once. A row's place is its place in its
    partition plus the group's rows in the partitions before, which one count per partition and group gives. Rows that
    tie in ``order`` get different numbers.
    """
    tie = F.xxhash64(*rows.columns)
    dealt = rows.withColumn("__tie", tie).repartitionByRange(*groups, *order, "__tie").sortWithinPartitions(*groups, *order, "__tie")
    placed = cut(dealt.drop("__tie").withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33).alias("__part")
    counts = placed.groupBy(*groups, part).agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    before = f"sum(n) OVER (PARTITION BY {', '.join(f'`{g}`' for g in groups)} ORDER BY __part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    offsets = counts.select(*(F.col(f"`{g}`").alias(f"__{i}") for i, g in enumerate(groups)), F.col("__part").alias("__p"), (F.coalesce(F.expr(before), F.lit(0)) - F.col("first")).alias("__shift"))
    same = F.shiftright("__at", 33) == F.col("__p")
    for i, g in enumerate(groups):
        same = same & F.col(f"`{g}`").eqNullSafe(F.col(f"__{i}"))
    return placed.join(offsets, same).select(*(f"`{c}`" for c in rows.columns), (F.col("__at") + F.col("__shift")).alias(name))
