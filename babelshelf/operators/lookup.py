"""Metadata by provider tables: first hits, composite keys, propagation and dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_hit(hits: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first of each key's hits."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return hits.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def enriched(rows: DataFrame, provider: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the provider's columns, nulls where it has none. The provider has one row per key."""
    return rows.join(provider, keys, "left")


def seasons(requests: DataFrame, provider: DataFrame) -> DataFrame:
    """``requests`` (series_id, season) with ``season_number``: the provider's own, the requested one if it has none or 0."""
    known = provider.select("series_id", "season", "season_number")
    found = requests.join(known, ["series_id", "season"], "left")
    return found.withColumn("season_number", F.coalesce(F.nullif("season_number", F.lit(0)), "season"))


def status(found: str = "found", skipped: str = "skipped"):
    """missing, skipped or ok."""
    return F.when(~F.coalesce(F.col(found), F.lit(False)), "missing").when(F.col(skipped), "skipped").otherwise("ok")


def propagated(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """A child's ``status`` under ``parent_status``: a missing parent hides it, a skipped one skips it."""
    own = F.col("status")
    joined = children.join(parents.select(key, F.col("status").alias("parent_status")), key, "left")
    return joined.withColumn("effective", F.when(F.coalesce(F.col("parent_status"), F.lit("missing")) == "missing", "missing").when(F.col("parent_status") == "skipped", "skipped").otherwise(own))


#: Fields that hold the number of each type of metadata, those without a number included.
NUMBERS = {"series": "series_id", "season": "season_number", "episode": "episode_number", "skip": None}
PROVIDER = "tmdb"


def _text(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def _tags(rows: DataFrame, column: str) -> DataFrame:
    """Rows with their JSON as ``__value``, parsed once, its tags and what is wrong with these."""
    parsed = rows.withColumn("__value", F.try_parse_json(F.col(column)))
    tagged = parsed.withColumns({"__provider": _text(F.col("__value"), "$.provider"), "__kind": _text(F.col("__value"), "$.data.metadata_type")})
    error = (
        F.when(F.col(column).isNull(), None).when(F.col("__value").isNull(), "bad JSON")
        .when(~F.coalesce(F.col("__provider") == PROVIDER, F.lit(False)), "unknown provider")
        .when(~F.coalesce(F.col("__kind").isin(*NUMBERS), F.lit(False)), "unknown metadata_type")
    )
    return tagged.withColumn("__error", error)


def dispatched(rows: DataFrame, column: str = "metadata") -> DataFrame:
    """``kind`` and ``number`` of tagged JSON ({provider, data: {metadata_type, ...}}) by its type; ``error`` for other texts.

    Each text is parsed once, as a variant. Null is no metadata and no error; a text that isn't JSON, lacks a tag or has
    an unknown one is an error row. A number that is missing or none is null.
    """
    number = F.coalesce(*(F.when(F.col("__kind") == kind, _text(F.col("__value"), f"$.data.{field}").try_cast("int")) for kind, field in NUMBERS.items() if field))
    fine = F.col("__error").isNull()
    found = _tags(rows, column).withColumns({"kind": F.when(fine, F.col("__kind")), "number": F.when(fine, number), "error": F.col("__error")})
    return found.drop("__value", "__provider", "__kind", "__error")


def unknown(rows: DataFrame, column: str = "metadata") -> DataFrame:
    """(provider, kind, n, shape) of the JSON whose tags are unknown: how many there are of each, and one schema for all."""
    odd = _tags(rows, column).where(F.col("__error").startswith("unknown"))
    return odd.groupBy(F.col("__provider").alias("provider"), F.col("__kind").alias("kind")).agg(F.count("*").alias("n"), F.schema_of_variant_agg("__value").alias("shape"))
