"""Scan quotas over requests as they arrive, with counters that outlive the run and that an abort freezes.

The state of a kind is its counter and whether it was aborted. It lies in the stream's checkpoint, so that a run which
ends or fails goes on where it stopped. Kinds are counted apart, each in one task, as a counter has one order; what a task
holds at once is the kind's part of one micro-batch, which the source's limit of files per trigger bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: A column of the requests within the stream; the processor renames those that begin with an underscore.
TIE = "tie_of_request"


class Counter(StatefulProcessor):
    """Counts a kind's requests, and passes those whose place is within the quota."""

    def __init__(self, quotas: dict[str, tuple[int, int]], order: list[str], abort: str | None):
        self.quotas, self.order, self.abort = quotas, order, abort

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("counter", "position long, aborted boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        position, aborted = self.state.get() if self.state.exists() else (0, False)
        if aborted:
            return
        part = pd.concat(list(rows), ignore_index=True).sort_values([*self.order, TIE], na_position="first", kind="stable")
        if self.abort is not None:
            ends = part[self.abort].fillna(False).astype(bool)
            if ends.any():
                aborted = True
                part = part.iloc[: int(ends.to_numpy().argmax())]
        start, amount = self.quotas[key[0]]
        first, last = max(0, start - position), max(0, start + amount - position)
        chosen = part.iloc[first:last].drop(columns=[TIE])
        chosen.insert(len(chosen.columns), "position", range(position + first, position + first + len(chosen)))
        self.state.update((position + len(part), aborted))
        if len(chosen):
            yield chosen


def counted(requests: DataFrame, kind: str, order: list[str], quotas: dict[str, tuple[int, int]], abort: str | None = None) -> DataFrame:
    """The requests to scan with their ``position`` among the requests of their kind.

    These are positions ``start`` to ``start + amount - 1`` of the kind's (start, amount) in ``quotas``; requests of other
    kinds are not counted. Micro-batches count one after the other, requests of one by ``order``, nulls first, those that
    tie by a hash of all their columns. A row whose column ``abort`` is true is no request: it freezes the counter of its
    kind, of all kinds if that is null, for all that comes after it, in this run and in later ones.
    """
    kinds = F.array(*map(F.lit, quotas))
    if abort is not None:
        of_all = F.coalesce(F.col(abort), F.lit(False)) & F.col(kind).isNull()
        requests = requests.withColumn(kind, F.explode(F.when(of_all, kinds).otherwise(F.array(kind))))
    rows = requests.where(F.col(kind).isin(*quotas)).withColumn(TIE, F.xxhash64(*requests.columns))
    schema = T.StructType([*requests.schema.fields, T.StructField("position", T.LongType())])
    return rows.groupBy(kind).transformWithStateInPandas(Counter(quotas, order, abort), schema, "append", "none")


@contextmanager
def _state_store(spark: SparkSession):
    """The state store that keyed state needs, for queries that start within."""
    name, value = _PROVIDER
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Appends what ``stream`` gives for all files that have arrived to the Parquet folder ``out``, and returns.

    Files that ``checkpoint`` knows are not read again.
    """
    with _state_store(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
