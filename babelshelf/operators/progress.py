"""Counts of a scan, taken by the job that writes its results, so that they cost no second pass.

Spark adds the counts up task by task and hands them to the driver when the job ends: a number each, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def written(rows: DataFrame, path: str, counts: dict[str, Column], mode: str = "errorifexists") -> dict:
    """Writes ``rows`` as Parquet and returns the aggregates ``counts`` over what was written; of no rows, too.

    The rows are computed once. Tasks that run again after a failure count once.
    """
    if not counts:
        raise ValueError("nothing to count")
    seen = Observation()
    rows.observe(seen, *(value.alias(name) for name, value in counts.items())).write.mode(mode).parquet(path)
    return dict(seen.get)


def outcome_counts(ok: str = "ok") -> dict[str, Column]:
    """Processed rows, successes and failures by a boolean; null is neither."""
    return {"total": F.count(F.lit(1)), "good": F.count_if(F.col(ok)), "bad": F.count_if(~F.col(ok))}


class Progress(StreamingQueryListener):
    """Tells ``report`` of each micro-batch of queries that ``watched`` streams: the counts by name."""

    def __init__(self, name: str, report: Callable[[dict], None]):
        self.name, self.report = name, report

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if (row := event.progress.observedMetrics.get(self.name)) is not None:
            self.report(row.asDict())

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def watched(stream: DataFrame, name: str, counts: dict[str, Column]) -> DataFrame:
    """``stream`` with counts over each micro-batch, which a ``Progress`` of the same name is told."""
    return stream.observe(name, *(value.alias(key) for key, value in counts.items()))
