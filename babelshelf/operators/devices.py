"""Device inventories: union, fallback, duplicates, ranking and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def united(sources: list[DataFrame]) -> DataFrame:
    whole = sources[0]
    for more in sources[1:]:
        whole = whole.unionByName(more)
    return whole


def fallback(devices: DataFrame, priority: str = "priority") -> DataFrame:
    """The rows of the first source that has any."""
    first = devices.agg(F.min(priority).alias("__first"))
    return devices.join(first, F.col(priority) == F.col("__first")).drop("__first")


def deduplicated(devices: DataFrame, key: str = "unique_id", order: str = "ord") -> DataFrame:
    """The first row of each id; devices without an id all stay."""
    w = Window.partitionBy(key).orderBy(order)
    first = devices.where(F.col(key).isNotNull()).withColumn("__k", F.row_number().over(w)).where(F.col("__k") == 1).drop("__k")
    return first.unionByName(devices.where(F.col(key).isNull()))


def best(devices: DataFrame, use_integrated: bool = False) -> DataFrame:
    """The device with most compute units, then memory (null: 0), dedicated ones first."""
    rows = devices if use_integrated else devices.where("type != 'integrated'")
    return rows.orderBy((F.col("type") == "integrated"), F.coalesce("num_compute_units", F.lit(0)).desc(), F.coalesce("memory_amount", F.lit(0)).desc(), "unique_id").limit(1)


def matched(devices: DataFrame, runtime: DataFrame, keys: list[str], unique: bool = False) -> DataFrame:
    """Each device with the lowest index of the runtime devices of its keys, and their number.

    With ``unique``, a device that has none or more than one is an error.
    """
    found = runtime.groupBy(*keys).agg(F.min("index").alias("index"), F.count("*").alias("n_matches"))
    joined = devices.join(found, keys, "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0).cast("long")))
    if not unique:
        return joined
    told = F.concat(F.col("n_matches").cast("string"), F.lit(" runtime devices for "), F.concat_ws(" ", *(F.col(k).cast("string") for k in keys)))
    # The index depends on the check, so that no plan leaves it out.
    return joined.withColumn("index", F.when(F.col("n_matches") == 1, F.col("index")).otherwise(F.raise_error(told).cast("long")))


# What a PCI listing calls graphics devices, their vendors and integrated ones; case counts.
LISTED_CLASSES = "VGA compatible controller|3D controller"
LISTED_VENDORS = (("NVIDIA", "nvidia"), ("AMD", "amd"), ("ATI", "amd"), ("Intel", "intel"))
LISTED_INTEGRATED = "APU"


def listed(lines: DataFrame, line: str = "value") -> DataFrame:
    """(unique_id, name, vendor, type, origin) of the graphics devices in the lines of a PCI listing, as ``spark.read.text`` gives it.

    The id is the address before the first blank. Devices of other vendors are left out.
    """
    text = F.col(line)
    vendor = F.coalesce(*(F.when(text.contains(word), F.lit(v)) for word, v in LISTED_VENDORS))
    kind = F.when(text.contains(LISTED_INTEGRATED), "integrated").otherwise("dedicated")
    parts = F.split(text, " ", 2)
    rows = lines.where(text.rlike(LISTED_CLASSES)).select(parts[0].alias("unique_id"), F.get(parts, F.lit(1)).alias("name"), vendor.alias("vendor"), kind.alias("type"), F.lit("lspci").alias("origin"))
    return rows.where(F.col("vendor").isNotNull())
