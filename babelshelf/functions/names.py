"""Names and paths of media files as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The naming scheme of the library's files and folders.
EPISODE = r"Episode ([0-9]{2}) - (.*) \[S([0-9]{2})E([0-9]{2})\]\.(.*)"
SEASON = r"Staffel ([0-9]{2})"
SERIES = r"(.*) \(([0-9]{4})\)"
DEFAULT_LANGUAGE = ("un", "Unknown")
NO_LANGUAGE = ("no_lang", "No Language")
VENDORS = ("nvidia", "amd", "intel")


def _group(name: Column, pattern: str, k: int) -> Column:
    """Group k, null if the pattern doesn't match; only a line feed ends a line."""
    return F.when(name.rlike(f"(?d){pattern}"), F.regexp_extract(name, f"(?d){pattern}", k))


def episode(name: Column) -> Column:
    """struct(name, season, episode)."""
    found = F.struct(_group(name, EPISODE, 2).alias("name"), _group(name, EPISODE, 3).cast("int").alias("season"), _group(name, EPISODE, 4).cast("int").alias("episode"))
    return F.when(name.rlike(f"(?d){EPISODE}"), found)


def season(name: Column, specials: list[str]) -> Column:
    """The number after the keyword; 0 for the names of special seasons."""
    special = F.when(name.isin(*specials), F.lit(0)) if specials else F.lit(None).cast("int")
    return F.coalesce(_group(name, SEASON, 1).cast("int"), special)


def series(name: Column) -> Column:
    """struct(name, year)."""
    return F.when(name.rlike(f"(?d){SERIES}"), F.struct(_group(name, SERIES, 1).alias("name"), _group(name, SERIES, 2).cast("int").alias("year")))


@dataclass(frozen=True)
class Parser:
    """A naming scheme: how the names of episodes, seasons and series are read, as column expressions."""

    episode: Callable[[Column], Column] = episode
    season: Callable[[Column, list[str]], Column] = season
    series: Callable[[Column], Column] = series


# The texts of descriptions.
def episode_text(season: Column, episode: Column, name: Column) -> Column:
    return F.format_string("<Episode season: %d episode: %d name: %s>", season, episode, name)


def season_text(season: Column) -> Column:
    return F.format_string("<Season season: %d>", season)


def series_text(name: Column, year: Column) -> Column:
    return F.format_string("<Series name: %s year: %d>", name, year)


def language(text: Column) -> Column:
    """struct(short, long) of ``short: long``; null unless there are exactly two parts."""
    parts = F.transform(F.split(text, ":"), lambda x: F.trim(x))
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("short"), parts[1].alias("long")))


def is_default(short: Column, long: Column) -> Column:
    return (short == DEFAULT_LANGUAGE[0]) & (long == DEFAULT_LANGUAGE[1])


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(name: Column) -> Column:
    """The last extension without its dot, null without one; a leading dot starts no extension."""
    return F.nullif(F.regexp_extract(name, r"^.+\.([^.]+)$", 1), F.lit(""))


def stem(name: Column) -> Column:
    return F.when(suffix(name).isNull(), name).otherwise(F.regexp_extract(name, r"^(.+)\.[^.]+$", 1))


def is_ignored(name: Column, kind: Column, formats: list[str], ignored: list[str]) -> Column:
    """Hidden and listed folders, and files with another extension (case counts)."""
    folder = name.startswith(".") | (name.isin(*ignored) if ignored else F.lit(False))
    return F.when(kind == "folder", folder).otherwise(~F.coalesce(suffix(name).isin(*formats), F.lit(False)))


def is_trailer(name: Column, trailers: list[str]) -> Column:
    return stem(name).isin(*trailers)


def vendor(text: Column) -> Column:
    """The first vendor whose name occurs in the text."""
    found = F.lit(None).cast("string")
    for v in reversed(VENDORS):
        found = F.when(F.lower(text).contains(v), F.lit(v)).otherwise(found)
    return found
