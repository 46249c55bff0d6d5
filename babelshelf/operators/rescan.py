"""Comparison of a walked library with the saved snapshot, both of (path, checksum, mtime, ...).

A walk has each path once. Of snapshot rows that repeat a path, the one with the latest time counts, of equals that with
the greatest checksum. Rows without a path are no entries: they are left out on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from babelshelf.operators.ordering import numbered


def outdated(old_mtime: Column, new_mtime: Column, old_checksum: Column, new_checksum: Column) -> Column:
    """Newer and with another checksum; a newer file of equal checksum only gets its time moved."""
    return (new_mtime > old_mtime) & ~new_checksum.eqNullSafe(old_checksum)


def entries(saved: DataFrame) -> DataFrame:
    """The snapshot with one row for each path; the aggregate's shuffle is the one that the joins need."""
    rest = [c for c in saved.columns if c != "path"]
    rank = [c for c in ("mtime", "checksum") if c in rest]
    found = saved.where("path IS NOT NULL")
    if not rest:
        return found.distinct()
    latest = F.max(F.struct(*rank, *(c for c in rest if c not in rank))).alias("__latest")
    return found.groupBy("path").agg(latest).select(*("path" if c == "path" else F.col("__latest").getField(c).alias(c) for c in saved.columns))


def matched(saved: DataFrame, walked: DataFrame) -> DataFrame:
    """Walked entries with the snapshot's columns as ``old_*``, nulls for new entries."""
    known = entries(saved)
    old = known.select(F.col("path"), *(F.col(c).alias(f"old_{c}") for c in known.columns if c != "path"))
    return walked.where("path IS NOT NULL").join(old, "path", "left")


def deleted(saved: DataFrame, walked: DataFrame) -> DataFrame:
    return entries(saved).join(walked.select("path"), "path", "left_anti")


def inserted(saved: DataFrame, walked: DataFrame) -> DataFrame:
    return walked.where("path IS NOT NULL").join(saved.select("path"), "path", "left_anti")


def merged(saved: DataFrame, walked: DataFrame) -> DataFrame:
    """Survivors, then inserts, with ``origin``; one join decides on survivors and new entries alike."""
    marked = saved.select("path").distinct().withColumn("known", F.lit(True))
    return walked.where("path IS NOT NULL").join(marked, "path", "left").withColumn("origin", F.when(F.col("known"), "kept").otherwise("new")).drop("known")


def moved(saved: DataFrame, walked: DataFrame) -> DataFrame:
    """(old_path, path, checksum): deleted and inserted entries that are the same file at another place (an extension).

    Entries of equal checksum are paired in path order, the first deleted with the first inserted one and so on, each
    in one pair at most; what is left over was deleted or is new. Both sides are numbered by ranges of checksum and
    path, so that the copies of one file are neither sorted in one task nor joined with each other. Entries without a
    checksum are in no pair.
    """
    gone = numbered(deleted(saved, walked).where("checksum IS NOT NULL").select("checksum", F.col("path").alias("old_path")), ["checksum"], ["old_path"])
    came = numbered(inserted(saved, walked).where("checksum IS NOT NULL").select("checksum", "path"), ["checksum"], ["path"])
    return gone.join(came, ["checksum", "position"]).select("old_path", "path", "checksum")


def refreshed(saved: DataFrame, checksums: DataFrame) -> DataFrame:
    """``saved`` with the checksums of ``checksums`` (path, checksum) where it has one."""
    new = checksums.select("path", F.col("checksum").alias("__new"))
    return saved.join(new, "path", "left").withColumn("checksum", F.coalesce("__new", "checksum")).drop("__new")


def plan(found: DataFrame) -> DataFrame:
    """Adds the tasks of a rescan from (outdated, language_default, metadata_missing): checksum, language, metadata."""
    changed = F.col("outdated")
    return found.withColumns({
        "do_checksum": changed, "do_language": changed | F.col("language_default"), "do_metadata": F.col("metadata_missing"),
    })
