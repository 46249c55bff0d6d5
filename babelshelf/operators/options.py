"""Options of a run: merging, aliases, enumerations and file lists."""

from __future__ import annotations

import json
import math
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from babelshelf.storage import cut, drop_cut

# Names and numbers of the log levels.
LOG_LEVELS = {"critical": 50, "error": 40, "warning": 30, "info": 20, "debug": 10, "notset": 0}
LOG_ALIASES = {"warn": "warning", "fatal": "critical"}


def merged(defaults: dict, *templates: dict) -> dict:
    """Defaults overlaid by templates: the last value that isn't None wins, nested sections merge."""
    out = dict(defaults)
    for template in templates:
        for key, value in template.items():
            if isinstance(value, dict) and isinstance(out.get(key), dict):
                out[key] = merged(out[key], value)
            elif value is not None:
                out[key] = value
    return out


def resolve_alias(name: str, aliases: dict[str, str], known: set[str]) -> tuple[str | None, str | None]:
    """(target, None) at the end of a chain of aliases, else (None, cycle or unknown)."""
    seen = set()
    while name not in known:
        if name in seen:
            return None, "cycle"
        if name not in aliases:
            return None, "unknown"
        seen.add(name)
        name = aliases[name]
    return name, None


def load_config(path: str) -> dict | None:
    """A JSON or YAML file's settings; None if there is no such file."""
    file = Path(path)
    if not file.exists():
        return None
    if file.suffix == ".json":
        return json.loads(file.read_text())
    if file.suffix in (".yml", ".yaml"):
        try:
            import yaml
        except ImportError as error:
            raise ValueError("reading YAML needs the yaml package") from error
        return yaml.safe_load(file.read_text())
    raise ValueError(f"a configuration is a JSON or YAML file: {path}")


def enum_value(name: Column, values: dict[str, int], aliases: dict[str, str]) -> Column:
    """Value by name or alias, in any case; null for others."""
    every = values | {a: values[t] for a, t in aliases.items()}
    table = F.create_map(*(F.lit(x) for pair in every.items() for x in pair))
    return F.try_element_at(table, F.lower(name))


def expanded(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """(path): files reachable from ``roots`` (path) over (parent, child) rows of lists and folders, each once.

    A file is what is no parent; an empty list or folder has a row with a null child. Breadth first: each round follows the paths that are new and writes them, until there
    are none, so that neither the depth is limited nor a cycle walked again.
    """
    new = cut(roots.select("path").where("path IS NOT NULL").distinct(), "reached")
    seen = [new]
    while True:
        next_ = entries.join(new.withColumnRenamed("path", "parent"), "parent").select(F.col("child").alias("path")).where("path IS NOT NULL").distinct()
        new = cut(next_.join(reduce(DataFrame.unionAll, seen), "path", "left_anti"), "reached")
        if new.isEmpty():
            return reduce(DataFrame.unionAll, seen).join(entries.select(F.col("parent").alias("path")).distinct(), "path", "left_anti")
        seen.append(new)


def resolved(names: DataFrame, aliases: DataFrame, known: DataFrame) -> DataFrame:
    """(name, target, error) of each name: the known name at the end of its chain of aliases, else ``cycle`` or ``unknown``.

    ``aliases`` has one target for each alias; a known name is not followed. Each round doubles the length of the jumps,
    so that there are as many as the logarithm of the longest chain. Nothing is broadcast: the files of a table of names are
    far smaller than its rows, so that by their size alone it would be sent through the driver.
    """
    jumps = cut(aliases.select("alias", "target").join(known.select(F.col("name").alias("alias")).hint("merge"), "alias", "left_anti"), "jumps")
    for _ in range(math.ceil(math.log2(jumps.count() + 1))):
        on = jumps.select(F.col("alias").alias("at"), F.col("target").alias("on")).hint("merge")
        longer = cut(jumps.join(on, F.col("target") == F.col("at"), "left").select("alias", F.coalesce("on", "target").alias("target"), F.col("on").isNotNull().alias("moved")), "jumps")
        drop_cut(jumps)
        jumps = longer
        if longer.where("moved").isEmpty():
            break
    ends = names.select("name").join(jumps.select(F.col("alias").alias("name"), F.col("target").alias("at")).hint("merge"), "name", "left").withColumn("at", F.coalesce("at", "name"))
    marked = ends.join(known.select(F.col("name").alias("at"), F.lit(True).alias("known")).hint("merge"), "at", "left").join(jumps.select(F.col("alias").alias("at"), F.lit(True).alias("alias")).hint("merge"), "at", "left")
    return marked.select("name", F.when(F.col("known"), F.col("at")).alias("target"), F.when(F.col("known"), None).when(F.col("alias"), "cycle").otherwise("unknown").alias("error"))


def layered(*layers: DataFrame) -> DataFrame:
    """(owner, key, value): of each owner's key, the value of the last layer (owner, key, value) that has one.

    The outer merge of defaults and templates: a key of any layer is there, with null if no layer has a value.
    """
    ranked = (x.select("owner", "key", "value", F.lit(i).alias("layer")) for i, x in enumerate(layers))
    return reduce(DataFrame.unionAll, ranked).groupBy("owner", "key").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("layer"))).alias("value"))
