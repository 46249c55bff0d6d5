"""Roll-ups of the flat hierarchy table (collection, series, season, episode, language, status)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("ok", "missing", "skipped")
KINDS = ("series", "season", "episode")


def by_language(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy("language").agg(F.count("*").alias("n"))


def rolled_up(episodes: DataFrame) -> DataFrame:
    """Episode counts per language at every level, the grand total included; one pass over the episodes."""
    level = F.when(F.grouping("collection") == 1, "total").when(F.grouping("series") == 1, "collection").when(F.grouping("season") == 1, "series").otherwise("season")
    counts = episodes.groupBy("collection", "series", "season", "language").agg(F.count("*").alias("n"))
    return counts.groupingSets(
        [["collection", "series", "season", "language"], ["collection", "series", "language"], ["collection", "language"], ["language"]], "collection", "series", "season", "language"
    ).agg(level.alias("level"), F.sum("n").alias("n"))


def metadata_counts(entities: DataFrame) -> DataFrame:
    """(kind, ok, missing, skipped) of rows (kind, status), zeros filled in."""
    return entities.groupBy("kind").agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))


def entities(episodes: DataFrame) -> DataFrame:
    """(kind, status): an episode's own, for seasons and series the worst below (missing, skipped, ok)."""
    rank = F.when(F.col("status") == "missing", 2).when(F.col("status") == "skipped", 1).otherwise(0)
    seasons = episodes.groupBy("collection", "series", "season").agg(F.max(rank).alias("rank"))
    series = seasons.groupBy("collection", "series").agg(F.max("rank").alias("rank"))
    back = F.element_at(F.array(F.lit("ok"), F.lit("skipped"), F.lit("missing")), F.col("rank") + 1)
    parts = [episodes.select(F.lit("episode").alias("kind"), "status")] + [x.select(F.lit(kind).alias("kind"), back.alias("status")) for kind, x in (("season", seasons), ("series", series))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def outcomes(results: DataFrame) -> DataFrame:
    """(success, n) for both values, of rows with a boolean ``ok``."""
    counts = results.agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"))
    return counts.select(F.explode(F.array(F.struct(F.lit(True).alias("success"), F.col("good").alias("n")), F.struct(F.lit(False).alias("success"), F.col("bad").alias("n")))).alias("x")).select("x.*")


def detailed_outcomes(results: DataFrame) -> DataFrame:
    """(success, key, n): successes by language, failures by reason."""
    key = F.when(F.col("ok"), F.col("language")).otherwise(F.col("reason"))
    return results.groupBy(F.col("ok").alias("success"), key.alias("key")).agg(F.count("*").alias("n"))


def log_lines(languages: DataFrame, metadata: DataFrame, outcomes_: DataFrame) -> DataFrame:
    """(place, line): what a run reports of the counts (language, n), (kind, ok, missing, skipped) and (success, key, n).

    One entry for each language, kind and outcome, in alphabetical order; a few each, as they are counts already.
    """

    def line(rows: DataFrame, place: int, title: str, *entry) -> DataFrame:
        found = F.array_join(F.sort_array(F.collect_list(F.concat(*entry))), ", ")
        return rows.agg(F.lit(place).alias("place"), F.concat(F.lit(title), found).alias("line"))

    parts = [part for s in STATUSES for part in (F.lit(f" {s}="), F.col(s).cast("string"))]
    success = F.when(F.col("success"), "ok ").otherwise("failed ")
    return (
        line(languages, 0, "languages: ", F.col("language"), F.lit("="), F.col("n").cast("string"))
        .unionAll(line(metadata, 1, "metadata: ", F.col("kind"), *parts))
        .unionAll(line(outcomes_, 2, "scans: ", success, F.col("key"), F.lit("="), F.col("n").cast("string")))
    )
