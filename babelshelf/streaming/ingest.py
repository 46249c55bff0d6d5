"""Running summaries over a folder into which prediction files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file_id long, segment int, language string, p double, ord long, scored_at timestamp"


def arriving(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def language_counts(predictions: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Segments and mean probability of each language by window; late rows count within the delay."""
    rows = predictions.withWatermark("scored_at", delay)
    counts = rows.groupBy(F.window("scored_at", window), "language").agg(F.count("*").alias("n"), F.avg("p").alias("mean"))
    return counts.select(F.col("window.start").alias("start"), "language", "n", "mean")
