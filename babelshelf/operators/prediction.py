"""Language decisions from per-segment probabilities: ranking, early stopping and thresholds.

Inputs are long tables of (file_id, segment, language, p, ord); ``ord`` orders the labels within a segment.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from babelshelf.functions import means


@dataclass(frozen=True)
class Thresholds:
    normal: float = 0.95
    final: float = 0.75
    minimum: float = 0.40
    maximum: float | None = None
    use_picker: bool = True
    default_language: str = "Unknown"

    @property
    def scans_nothing(self) -> bool:
        """No scan can satisfy a maximum below the minimum."""
        return self.maximum is not None and self.maximum < self.minimum


def ranked(predictions: DataFrame, mean: str = "arithmetic", digits: int = 9) -> DataFrame:
    """(file_id, language, accuracy, place): labels by mean, the one seen first wins a tie."""
    first = F.min(F.struct("segment", "ord")).alias("first")
    rows = predictions.groupBy("file_id", "language").agg(F.round(means.MEANS[mean](F.col("p")), digits).alias("accuracy"), first)
    order = Window.partitionBy("file_id").orderBy(F.desc("accuracy"), "first", "language")
    return rows.withColumn("place", F.row_number().over(order).cast("int")).drop("first")


def scannable(runtime: str) -> Column:
    """Runtimes that can be cut into segments: not null, negative, infinite or not a number."""
    return F.col(runtime).cast("double").between(0.0, 1.7976931348623157e308)


def segments(files: DataFrame, length: Column) -> DataFrame:
    """(file_id, segment, start_s, end_s, scanned) for files of (file_id, runtime) seconds.

    The last segment has no end; a runtime that is a multiple of the length gets an empty one behind it.
    Files with a runtime that is null, negative or not finite, and lengths that aren't above zero, give no rows.
    """
    rows = files.withColumn("length", length).where(scannable("runtime") & (F.col("length") > 0)).select("*", F.explode(F.sequence(F.lit(0), F.floor(F.col("runtime") / F.col("length")).cast("int"))).alias("segment"))
    start = F.col("segment") * F.col("length")
    end = F.when(start + F.col("length") <= F.col("runtime"), start + F.col("length"))
    return rows.select("file_id", "segment", start.alias("start_s"), end.alias("end_s"), F.try_divide(F.coalesce(end, F.col("runtime")).cast("double"), F.col("runtime").cast("double")).alias("scanned"))


def prefix_best(predictions: DataFrame, scan: DataFrame, digits: int = 9) -> DataFrame:
    """(file_id, segment, scanned, language, accuracy, failed) for each row of ``scan`` (file_id, segment, scanned).

    Label and accuracy are the best by truncated mean over segments 0 to this one; predictions beyond a file's own last
    segment are not its own. ``failed`` says that this segment has no prediction. Rows are shuffled once, by file, and
    all windows are over one file's labels, so the work of a task is bounded by its files' segments.
    """
    scored = predictions.repartition("file_id")
    by_segment = scored.groupBy("file_id", "language", "segment").agg(F.collect_list("p").alias("ps"), F.min("ord").alias("ord"))
    labels = by_segment.groupBy("file_id", "language").agg(
        F.min(F.struct("segment", "ord")).alias("first"), F.map_from_entries(F.collect_list(F.struct("segment", "ps"))).alias("by_segment")
    )
    steps = scan.select("file_id", "segment", "scanned").repartition("file_id").join(labels, "file_id", "left")
    # A file without any prediction, and segments before the first one, have a row without a label.
    begun = F.col("segment") >= F.col("first.segment")
    steps = steps.select("file_id", "segment", "scanned", F.when(begun, F.col("language")).alias("language"), F.when(begun, F.col("first")).alias("first"), F.try_element_at("by_segment", "segment").alias("ps"))
    before = Window.partitionBy("file_id", "language").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    prefix = steps.withColumn("seen", F.sort_array(F.flatten(F.collect_list("ps").over(before))))
    ranked_ = prefix.withColumn("accuracy", F.when(F.size("seen") > 0, F.round(means.truncated_of(F.col("seen")), digits)))
    own = Window.partitionBy("file_id", "segment")
    order = own.orderBy(F.desc_nulls_last("accuracy"), "first", "language")
    rows = ranked_.withColumns({"place": F.row_number().over(order), "failed": ~F.bool_or(F.col("ps").isNotNull()).over(own)})
    return rows.where("place = 1").select("file_id", "segment", "scanned", "language", "accuracy", "failed")


def stopping_point(best: DataFrame, t: Thresholds) -> DataFrame:
    """(file_id, segment, scanned, language, accuracy) where scanning stops, from ``prefix_best``.

    That is the first segment that satisfies a rule or has failed, else the last; after a failed segment there is no
    language, whatever the others say. If the rules let nothing be scanned, nothing is: each file has nulls.
    """
    if t.scans_nothing:
        return best.select("file_id").distinct().select("file_id", *(F.lit(None).cast(best.schema[c].dataType).alias(c) for c in ("segment", "scanned", "language", "accuracy")))
    sure = (F.col("language") != t.default_language) & (F.col("accuracy") >= t.normal)
    enough = F.col("scanned") >= t.maximum if t.maximum is not None else F.lit(False)
    stops = F.col("failed") | (F.col("scanned") >= t.minimum) & (enough | F.coalesce(sure, F.lit(False)))
    at = F.struct("segment", "scanned", "language", "accuracy", "failed")
    chosen = best.groupBy("file_id").agg(F.coalesce(F.min_by(at, F.when(stops, F.col("segment"))), F.max_by(at, "segment")).alias("x"))
    return chosen.select("file_id", "x.segment", "x.scanned", *(F.when(~F.col("x.failed"), F.col(f"x.{c}")).alias(c) for c in ("language", "accuracy")))


def decided(stopped: DataFrame, t: Thresholds, picks: DataFrame | None = None) -> DataFrame:
    """Adds ``outcome``: success or the reason of failure, that of memory errors if ``failed_too_often`` says so. ``picks`` (file_id, picked) stands for the picker."""
    rows = stopped.join(picks, "file_id", "left") if picks is not None else stopped.withColumn("picked", F.lit(None).cast("string"))
    too_often = F.col("failed_too_often") if "failed_too_often" in stopped.columns else F.lit(False)
    at_end = F.col("scanned") >= (1.0 if t.maximum is None else t.maximum)
    final_ok = F.col("accuracy") >= t.final
    picked = at_end & ~final_ok & F.lit(t.use_picker) & F.col("picked").isNotNull()
    outcome = (
        F.when(too_often, "failed_too_often")
        .when(F.col("language").isNull(), "no_best_available")
        .when(at_end & final_ok, "success")
        .when(picked, "success")
        .when(at_end, "pick_failed" if t.use_picker else "final_threshold_failed")
        .when(F.col("accuracy") >= t.normal, "success")
        .otherwise("normal_threshold_failed")
    )
    return rows.select(
        "file_id", "segment", "scanned", F.when(picked, F.col("picked")).otherwise(F.col("language")).alias("language"), F.when(picked, F.lit(1.0)).otherwise(F.col("accuracy")).alias("accuracy"), outcome.alias("outcome")
    )
