"""A saved listing of a library, and its refresh in place: only new and changed files are opened, only folders with changes written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from babelshelf.operators import rescan
from babelshelf.sources import listing
from babelshelf.storage import cut, delete

SCHEMA = "path string, checksum string, mtime double, length long, folder string"
#: What a run may say of a file; moved ones count as such only.
STATUSES = ("new", "deleted", "moved", "changed", "touched", "kept")


def folder_of(path: str):
    """The folder of a relative path, ``.`` for the library's own."""
    return F.coalesce(F.nullif(F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))


def saved(spark: SparkSession, path: str) -> DataFrame:
    """(path, checksum, mtime, length, folder) of the listing at ``path``, none if there is none yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def _below(rows: DataFrame, folders: DataFrame) -> DataFrame:
    """The rows whose ``folder``, or one around it, is among ``folders`` (path), by their folders' names alone."""
    parts = F.split("folder", "/")
    around = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    own = rows.select("folder").distinct().select("folder", F.explode(around).alias("path"))
    return rows.join(own.join(folders, "path", "left_semi").select("folder").distinct(), "folder", "left_semi")


def refresh(spark: SparkSession, root: str, path: str, formats: list[str] | None = None, ignored: tuple[str, ...] = ()) -> dict[str, int]:
    """Brings the listing at ``path`` up to date with the library below ``root``; the number of files by status, and of those hashed.

    A file is read if it is new, or if its time or length is another than before. It is ``changed`` if its checksum is, too,
    else ``touched``; new and deleted files of equal checksum are ``moved``. What lies in a folder that can't be opened
    stays as it was saved, and so does a checksum if the file can't be read. Folders without changes keep their saved files.
    A run that is repeated, also after it broke off, ends with the same listing. One writer at a time.
    """
    entries = listing.walked(spark, root, formats, ignored)
    closed = entries.where("error IS NOT NULL").select("path")
    if not entries.where("error IS NOT NULL AND path = ''").isEmpty():
        raise OSError(f"no folder to list: {root}")
    files = entries.where("kind = 'file' AND NOT ignored").select("path", "mtime", "length")
    old = rescan.entries(saved(spark, path))
    hidden = cut(_below(old, closed), "hidden")
    matched = cut(rescan.matched(old, files), "matched")
    stale = matched.where(~(F.col("mtime").eqNullSafe(F.col("old_mtime")) & F.col("length").eqNullSafe(F.col("old_length")) & F.col("old_checksum").isNotNull()))
    base = root.rstrip("/")
    read = cut(listing.hashed(stale.select(F.concat(F.lit(base + "/"), "path").alias("path"))), "checksums")
    sums = read.select(F.substring("path", len(base) + 2, 1_000_000).alias("path"), F.col("checksum").alias("new_checksum"))
    fresh = matched.join(sums, "path", "left").select("path", F.coalesce("new_checksum", "old_checksum").alias("checksum"), "mtime", "length", folder_of("path").alias("folder"))
    now = cut(fresh.unionByName(hidden.select("path", "checksum", "mtime", "length", "folder")), "listing")
    before = old.select("path", *(F.col(c).alias(f"old_{c}") for c in ("checksum", "mtime", "length", "folder")), F.lit(True).alias("was"))
    same = F.col("mtime").eqNullSafe(F.col("old_mtime")) & F.col("length").eqNullSafe(F.col("old_length"))
    status = (
        F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "deleted").when(~F.col("checksum").eqNullSafe(F.col("old_checksum")), "changed").when(same, "kept").otherwise("touched")
    )
    told = cut(now.withColumn("is", F.lit(True)).join(before, "path", "full").select("path", F.coalesce("folder", "old_folder").alias("folder"), status.alias("status")), "told")
    counts = dict.fromkeys(STATUSES, 0) | {r.status: r["count"] for r in told.groupBy("status").count().collect()}
    counts["moved"] = rescan.moved(old.select("path", "checksum"), now.select("path", "checksum")).count()
    counts |= {"new": counts["new"] - counts["moved"], "deleted": counts["deleted"] - counts["moved"], "hashed": read.count()}
    folders = told.where("status <> 'kept'").select("folder").distinct()
    gone = folders.join(now.select("folder").distinct(), "folder", "left_anti")
    left = [r[0] for r in saved(spark, path).select("folder", "_metadata.file_path").join(gone, "folder", "left_semi").select("file_path").distinct().collect()] if counts["deleted"] or counts["moved"] else []
    now.join(folders, "folder", "left_semi").repartition("folder").sortWithinPartitions("path").write.partitionBy("folder").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    for file in left:  # folders without files any more
        delete(spark, file)
    return counts
