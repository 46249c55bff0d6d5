"""Scan quotas: offset and amount over the eligible rows of each kind, in traversal order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within_quota(rows: DataFrame, kind: str, order: list[str], start: int, amount: int, eligible: Column, kinds: list[str] | None = None) -> DataFrame:
    """The rows to scan, with their ``position`` among the eligible rows of their kind.

    These are the positions ``start`` to ``start + amount - 1``. The first rows of each kind are found by a group limit
    before the shuffle, so that no task sorts all rows of a kind. A null kind is a kind of its own unless ``kinds`` are
    given; null orders come first, and rows that tie are ordered by a hash of all their columns.
    """
    allowed = eligible & (F.col(kind).isin(*kinds) if kinds is not None else F.lit(True))
    w = Window.partitionBy(kind).orderBy(*order, F.xxhash64(*rows.columns))
    first = rows.where(allowed).withColumn("position", F.row_number().over(w)).where(F.col("position") <= start + amount)
    return first.withColumn("position", F.col("position") - 1).where(F.col("position") >= start)
