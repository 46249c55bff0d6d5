"""Snapshots of a library as JSON documents, one for each season, so that none grows with the library."""

from __future__ import annotations

from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from babelshelf.storage import cut, drop_cut, shared_path

METADATA = "struct<provider:string,data:struct<metadata_type:string,episode_number:bigint>>"
SCHEMA = f"collection string, series string, season bigint, episodes array<struct<episode:bigint,language:string,metadata:{METADATA}>>"
PROVIDER = "tmdb"
#: What names a season; by default each has a folder of its own in a snapshot that is refreshed in place.
SEASON = ("collection", "series", "season")


def metadata_of(status: Column, episode: Column) -> Column:
    """The union {provider, data} of an episode's metadata; null for missing and for skipped metadata alike."""
    data = F.struct(F.lit("episode").alias("metadata_type"), episode.cast("bigint").alias("episode_number"))
    return F.when(status == "ok", F.struct(F.lit(PROVIDER).alias("provider"), data.alias("data")))


def nest(episodes: DataFrame) -> DataFrame:
    """One row for each season of (collection, series, season, episode, language, status): its episodes, in order."""
    entry = F.struct(F.col("episode").cast("bigint").alias("episode"), "language", metadata_of(F.col("status"), F.col("episode")).alias("metadata"))
    return episodes.groupBy("collection", "series", F.col("season").cast("bigint").alias("season")).agg(F.sort_array(F.collect_list(entry)).alias("episodes"))


def flatten(nested: DataFrame) -> DataFrame:
    """The episodes again; metadata that was skipped comes back as missing."""
    rows = nested.select("collection", "series", "season", F.explode("episodes").alias("e"))
    return rows.select("collection", "series", "season", "e.episode", "e.language", F.when(F.col("e.metadata").isNull(), "missing").otherwise("ok").alias("status"))


def _checked(path: str) -> str:
    suffix = PurePosixPath(path.rstrip("/")).suffix
    if suffix not in ("", ".json"):
        raise ValueError(f"a snapshot is a JSON file or folder, not {suffix!r}: {path}")
    return suffix


def write(nested: DataFrame, path: str) -> None:
    """A folder of files with one document a line; the folder must not be the one that ``nested`` reads."""
    _checked(path)
    nested.write.mode("overwrite").json(path)


def read(spark, path: str) -> DataFrame:
    """Documents of a folder, one a line, or of a ``.json`` file, which may also hold an array over several lines."""
    return spark.read.schema(SCHEMA).option("multiLine", _checked(path) == ".json").json(path)


def roundtrip(nested: DataFrame) -> DataFrame:
    """Writes to a new path of the shared folder and reads it."""
    path = shared_path(nested.sparkSession, "snapshot")
    write(nested, path)
    return read(nested.sparkSession, path)


def _same(keys: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys))


def write_parts(nested: DataFrame, path: str, by: tuple[str, ...] = SEASON) -> None:
    """The documents in folders by ``by``, a leading part of ``SEASON``; other folders of ``path`` stay as they are.

    All documents of a folder are written together, by one task, so ``nested`` must have them all. Names must not be
    null or empty, for which folders have no name.
    """
    dealt = nested.repartition(*by).sortWithinPartitions(*SEASON)
    dealt.write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def refresh(spark, path: str, changes: DataFrame, by: tuple[str, ...] = SEASON) -> int:
    """Puts ``changes`` (collection, series, season, episode, language, status[, deleted]) into a snapshot of ``write_parts``.

    Only folders in which a document changes are written again, the files of the others keep their names and times.
    Episodes are replaced or added, or taken out if ``deleted``; a season that loses all of them stays as an empty
    document. The number of folders written is returned. A run that is repeated, also after it broke off, ends with the
    same documents, and writes nothing if they were there; but one writer at a time. Changes without a name or number
    are left out; of several for one episode the greatest by deleted, language and status holds.
    """
    columns = ("deleted", "language", "status")
    rows = changes if "deleted" in changes.columns else changes.withColumn("deleted", F.lit(False))
    named = reduce(lambda a, b: a & b, (F.col(k).isNotNull() & (F.col(k).cast("string") != "") for k in (*SEASON, "episode")))
    typed = [F.col(k).cast("bigint" if k in ("season", "episode") else "string").alias(k) for k in (*SEASON, "episode")]
    new = cut(rows.where(named).select(*typed, F.coalesce("deleted", F.lit(False)).alias("deleted"), "language", "status"), "changes")
    # Documents are read from a copy, as the folders that they come from may be replaced.
    old = cut(read(spark, path).join(F.broadcast(touched) if (touched := new.select(*by).distinct()).count() <= 10_000 else touched, list(by), "left_semi"), "touched")
    known = flatten(old).select(*SEASON, "episode", F.lit(False).alias("deleted"), "language", "status", F.lit(0).alias("later"))
    last = F.max(F.struct("later", *columns)).alias("last")
    latest = known.unionByName(new.withColumn("later", F.lit(1))).groupBy(*SEASON, "episode").agg(last)
    nested = nest(latest.where(~F.col("last.deleted")).select(*SEASON, "episode", "last.language", "last.status"))
    seasons = old.select(*SEASON).union(new.select(*SEASON)).distinct()
    full = seasons.alias("o").join(nested.alias("n"), _same(SEASON), "left").select(*(f"o.{k}" for k in SEASON), F.coalesce("n.episodes", F.array().cast(nested.schema["episodes"].dataType)).alias("episodes"))
    full = cut(full, "refreshed")
    differs = full.alias("n").join(old.alias("o"), _same(SEASON), "left").where(~F.col("n.episodes").eqNullSafe(F.col("o.episodes")))
    folders = cut(differs.select(*(f"n.{k}" for k in by)).distinct(), "folders")
    n = folders.count()
    if n:
        write_parts(full.join(folders, list(by), "left_semi"), path, by)
    for done in (new, old, full, folders):
        drop_cut(done)
    return n
