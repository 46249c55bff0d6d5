"""Entities from walked paths: nesting, type and name decide what a file or folder is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from babelshelf.functions import names

MAX_PARENTS = 3


def levels(files: DataFrame, path: str = "path") -> DataFrame:
    """All folders above the files, and the files: (path, kind, depth). Folders are counted once."""
    parts = F.split(F.col(path), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("path"), F.when(k == F.size(parts), "file").otherwise("folder").alias("kind"), k.alias("depth")))
    return files.select(F.explode(prefixes).alias("x")).select("x.*").distinct()


def classify(entries: DataFrame, specials: list[str], trailers: list[str], parser: names.Parser = names.Parser()) -> DataFrame:  # noqa: B008
    """Adds ``entity`` and ``problem`` to entries (path, kind, ...), with names as ``parser`` reads them.

    ``entity`` is collection, series, season or episode, null if the entry is a trailer, which is dropped, or has a
    problem: an unexpected kind at its depth, a name that can't be parsed or too deep a nesting.
    """
    parts = F.split("path", "/")
    depth, name, folder = F.size(parts), F.element_at(parts, -1), F.col("kind") == "folder"
    in_collection = parser.series(parts[0]).isNull()
    role: Column = (
        F.when(depth == 4, "episode").when(depth == 3, F.when(in_collection, "season").otherwise("episode"))
        .when(depth == 2, F.when(in_collection, "series").otherwise("season")).when(depth == 1, F.when(in_collection & folder, "collection").otherwise("series"))
    )
    rows = entries.withColumns({"__role": role, "__name": name})
    wants_file = F.col("__role") == "episode"
    misplaced = (F.col("kind") == "file") != wants_file
    trailer = misplaced & (F.col("__role") == "season") & names.is_trailer(F.col("__name"), trailers)
    parsed = (
        F.when(F.col("__role") == "episode", parser.episode(F.col("__name")).isNotNull() & (parser.episode(F.col("__name"))["episode"] >= 1))
        .when(F.col("__role") == "season", parser.season(F.col("__name"), specials).isNotNull())
        .when(F.col("__role") == "series", parser.series(F.col("__name")).isNotNull()).otherwise(F.lit(True))
    )
    problem = F.when(F.col("__role").isNull(), "too_deep").when(trailer, "trailer").when(misplaced, "unexpected_kind").when(~F.coalesce(parsed, F.lit(False)), "unparsable_name")
    return rows.withColumn("problem", problem).withColumn("entity", F.when(F.col("problem").isNull(), F.col("__role"))).drop("__role", "__name")


def admitted(classified: DataFrame, strict: bool = False) -> DataFrame:
    """(path, entity) of the entries without a problem; with ``strict``, one with a problem is an error. Trailers always go."""
    rows = classified.where(~F.coalesce(F.col("problem") == "trailer", F.lit(False)))
    if not strict:
        return rows.where("problem IS NULL").select("path", "entity")
    told = F.concat(F.lit("can't parse "), F.col("path"), F.lit(": "), F.col("problem"))
    return rows.select("path", F.when(F.col("problem").isNull(), F.col("entity")).otherwise(F.raise_error(told).cast("string")).alias("entity"))
