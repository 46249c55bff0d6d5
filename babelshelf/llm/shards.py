"""Sharding by histogram sort, with DataFrame functions only.

Each row has a 60-bit hash key. Exact bytes are counted below candidate boundaries, ten key bits at a time: the
first round over the whole key range, each later one only inside the cells that hold an unsettled splitter, until
every splitter is within the tolerance or its cell can't be divided. Only keys and sizes are written for counting. Then
the whole rows are exchanged once, into cells of bounded size, within which they are ordered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from babelshelf.llm.common import cut, identified

KEY_BITS = 60
ROUND_BITS = 10
#: Bytes of ``size`` that a task of the exchange reads, on average, at most; the session may ask for smaller ones.
TASK_BYTES = 256 << 20
#: Rows that one task orders at once, on average.
CELL_ROWS = 20_000


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus 1; null has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def splitters(rows: DataFrame, n_shards: int, tolerance: float = 0.0005, key: str = "__key", size: str = "size") -> tuple[list[int], int, int]:
    """The lowest key of each shard but the first, and the numbers of rows and of bytes.

    ``tolerance`` is a share of the mean shard. Each round sends at most ``2 ** ROUND_BITS`` counts for each
    unsettled splitter to the driver, however large ``rows`` is.
    """
    step = 1 << ROUND_BITS
    aims: dict[int, float] = {}
    open_cells: dict[int, tuple[list[int], int]] = {0: (list(range(1, n_shards)), 0)}  # prefix: its splitters, bytes below it
    cuts: dict[int, int] = {}
    n_rows = total = 0
    for depth in range(1, KEY_BITS // ROUND_BITS + 1):
        shift = KEY_BITS - depth * ROUND_BITS
        within = rows if depth == 1 else rows.where(F.shiftright(key, shift + ROUND_BITS).isin(*open_cells))
        counts = within.groupBy(F.shiftright(key, shift).alias("cell")).agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).orderBy("cell").collect()
        if depth == 1:
            total, n_rows = sum(x.bytes for x in counts), sum(x.n for x in counts)
            aims = {i: total * i / n_shards for i in range(1, n_shards)}
            slack = tolerance * total / n_shards
        cells: dict[int, list] = {}
        for x in counts:
            cells.setdefault(x.cell // step, []).append(x)
        left: dict[int, tuple[list[int], int]] = {}
        for prefix, (waiting, below) in open_cells.items():
            for x in cells.get(prefix, []):
                above = below + x.bytes
                for i in [i for i in waiting if below <= aims[i] <= above]:
                    waiting.remove(i)
                    low, high = aims[i] - below, above - aims[i]
                    if min(low, high) <= slack or x.n == 1 or shift == 0:
                        cuts[i] = (x.cell if low <= high else x.cell + 1) << shift
                    else:
                        left.setdefault(x.cell, ([], below))[0].append(i)
                below = above
            for i in waiting:  # an empty table
                cuts[i] = 0
        open_cells = left
        if not open_cells:
            break
    return [cuts[i] for i in range(1, n_shards)], n_rows, total


def _shard_of(key: str, bounds: list[int], first: int = 0) -> Column:
    """Number of bounds at or below the key, by binary search in one expression."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(F.col(key) < F.lit(bounds[mid]), _shard_of(key, bounds[:mid], first)).otherwise(_shard_of(key, bounds[mid + 1 :], first + mid + 1))


def histogram_shards(docs: DataFrame, n_shards: int = 16, tolerance: float = 0.0005, keys: tuple[str, ...] = ("doc_id", "text"), size: str = "size", cell_rows: int = CELL_ROWS) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``: shards of near-equal sums of ``size``, slots gapless from 0.

    The order within and across shards is that of a hash of ``keys``. Rows with equal keys stay together, so that at
    most the rows of one key stand between a shard's size and its aim; let the keys tell repeated rows apart, as
    ``sharded_documents`` does. Null keys are keys like any other; ``size`` must not be null. Columns ``shard`` and
    ``slot`` of the input are replaced. An empty table gives an empty result.
    """
    rows = docs.drop("shard", "slot").withColumn("__key", F.shiftrightunsigned(F.xxhash64(*keys), 64 - KEY_BITS))
    slim = cut(rows.select("__key", F.col(size).alias("size")), "shard-keys")
    bounds, n_rows, total = splitters(slim, n_shards, tolerance)
    bits = max(0, math.ceil(math.log2(max(1, n_rows / cell_rows))))

    def placed(df: DataFrame) -> DataFrame:
        return df.select("*", _shard_of("__key", bounds).cast("int").alias("shard"), F.shiftright("__key", KEY_BITS - bits).alias("__cell"))

    before = "sum(n) OVER (PARTITION BY shard ORDER BY __cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    offsets = placed(slim).groupBy("shard", "__cell").agg(F.count("*").alias("n")).select("shard", "__cell", F.expr(f"coalesce({before}, 0)").alias("__before"))
    rank = F.expr(f"row_number() OVER (PARTITION BY shard, __cell ORDER BY __key, {', '.join(f'`{k}`' for k in keys)})")
    whole, least = placed(rows), math.ceil(total / TASK_BYTES)
    if least > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        whole = whole.repartition(least, "shard", "__cell")
    ranked = whole.withColumn("__rank", rank)
    joined = ranked.join(offsets, ["shard", "__cell"])
    return joined.withColumn("slot", F.col("__before") + F.col("__rank") - 1).drop("__before", "__rank", "__key", "__cell")


def text_crc32(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes; null is empty."""
    return F.crc32(F.coalesce(text, F.lit("")))


def sharded_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """(doc_id, text, size, shard, slot): the whole documents, in shards of near-equal sums of ``text_size``.

    The key holds a row's file and place besides its id and text, so that repeated rows are spread like any others:
    a shard's size is within the tolerance and one document of its aim. Null ids and texts are values like any other.
    """
    rows = identified(docs, "__place", ("doc_id", "text"))
    whole = rows.withColumns({"size": text_size(F.col("text")), "__crc": text_crc32(F.col("text"))})
    return histogram_shards(whole, n_shards, keys=("doc_id", "__crc", "__place")).drop("__crc", "__place")


def op3_histogram_sort(spark, sf_dir: str) -> DataFrame:
    """Shard, slot, size and checksum of each document, by the law ``bytes``.

    The documents are sharded with their texts; the checksum returned is that of the sharded text.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = sharded_documents(docs)
    return placed.select("doc_id", "size", text_crc32(F.col("text")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
