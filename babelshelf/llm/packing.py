"""Bounded-space online packing of token ids into sequences of fixed length.

Each partition keeps a fixed number of open windows. Whole windows are cut off a document first; its rest goes
into the fullest window that has room (best fit). If none has, the fullest window is emitted: as it is when it
lacks only a few ids, else topped up with the head of the rest, which is then placed anew. Windows that are still
open at the end of a partition are handed to a merging round, in which one task packs the leftovers of a fixed
number of partitions, until one group is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelshelf.llm.common import cut
from babelshelf.llm.tokens import blocks, encoder, tokenizer_path

LENGTH = 1024
OPEN_WINDOWS = 32
#: An emitted window may lack so many ids.
SLACK = 8
#: Partitions whose leftovers meet in one task: at most 64 x 32 windows.
FAN_IN = 64
END_ID = 0
#: Pieces in each generation of a worker's cache; packing shares its workers with the other stages of a pipeline.
CACHE_PIECES = 250_000
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, part long, open boolean"
_NAMES = [x.split(" ")[0] for x in SCHEMA.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]


class Packer:
    """The windows of one task. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, stage: int, part: int, length: int = LENGTH, windows: int = OPEN_WINDOWS, slack: int = SLACK):
        self.length, self.most, self.slack, self.part = length, windows, slack, part
        self.next_id = (stage << 56) + (part << 28)
        self.open: list[list] = []
        self.room: list[int] = []
        self.rows: list[tuple] = []

    def add_document(self, doc_id: int | None, ids: np.ndarray) -> None:
        n = len(ids)
        whole = n - n % self.length
        for at in range(0, whole, self.length):
            self._emit([(doc_id, at, ids[at : at + self.length], n)])
        if whole < n:
            self.add((doc_id, whole, ids[whole:], n))

    def add(self, piece: tuple) -> None:
        doc_id, start, ids, n = piece
        while True:
            fits = [(r, k) for k, r in enumerate(self.room) if r >= len(ids)]
            if fits:
                room, k = min(fits)
                self.open[k].append((doc_id, start, ids, n))
                self.room[k] = room - len(ids)
                if not self.room[k]:
                    self._close(k)
                return
            if len(self.open) < self.most:
                self.open.append([])
                self.room.append(self.length)
                continue
            k = self.room.index(min(self.room))
            if self.room[k] > self.slack:
                head = self.room[k]
                self.open[k].append((doc_id, start, ids[:head], n))
                start, ids = start + head, ids[head:]
            self._close(k)

    def _close(self, k: int) -> None:
        self._emit(self.open.pop(k))
        self.room.pop(k)

    def _emit(self, pieces: list[tuple], still_open: bool = False) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), n, self.next_id, offset, self.part, still_open))
            offset += len(ids)
        self.next_id += 1

    def hand_over(self) -> None:
        """Emits the open windows as leftovers for the next round."""
        for pieces in self.open:
            self._emit(pieces, True)
        self.open, self.room = [], []

    def finish(self) -> None:
        """Pours the open windows together; all but the last are then full."""
        left = [piece for _, pieces in sorted(zip(self.room, self.open, strict=True), key=lambda x: x[0]) for piece in pieces]
        self.open, self.room = [], []
        now, room = [], self.length
        for doc_id, start, ids, n in left:
            while len(ids):
                now.append((doc_id, start, ids[:room], n))
                start, ids, room = start + min(room, len(ids)), ids[room:], room - min(room, len(ids))
                if not room:
                    self._emit(now)
                    now, room = [], self.length
        if now:
            self._emit(now)

    def batches(self, least: int = 4096) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= max(1, least):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*self.rows, strict=True), _TYPES, strict=True)], names=_NAMES)
            self.rows = []


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, windows: int = OPEN_WINDOWS, slack: int = SLACK, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): each id of each document in one piece.

    A document is its text's ids and an end id; null and empty texts are the end id alone. ``ids`` holds
    little-endian unsigned 32-bit integers. Repeated rows and null ids are documents of their own. Other columns
    are ignored, an empty table gives an empty result.
    """
    path = tokenizer or tokenizer_path()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(path, CACHE_PIECES), Packer(0, TaskContext.get().partitionId(), length, windows, slack)
        for batch, texts in blocks(batches):
            ends, ids = enc(texts)
            a = 0
            for doc_id, b in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
                packer.add_document(doc_id, np.append(ids[a:b], enc.dtype.type(END_ID)))
                a = b
                yield from packer.batches()
        packer.hand_over()
        yield from packer.batches(1)

    def merge(stage: int, last: bool):
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by([(x, "ascending") for x in ("part", "sequence_id", "offset")])
            packer = Packer(stage, table.column("part")[0].as_py() // fan_in, length, windows, slack)
            for doc_id, start, raw, n in zip(*(table.column(x).to_pylist() for x in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
                packer.add((doc_id, start, np.frombuffer(raw, dtype="<u4"), n))
            packer.finish() if last else packer.hand_over()
            return pa.Table.from_batches(packer.batches(1), schema=pa.schema(list(zip(_NAMES, _TYPES, strict=True))))

        return run

    packed = cut(docs.select("doc_id", "text").mapInArrow(first, SCHEMA), "packed")
    done = [packed.where("NOT open")]
    stage, parts = 0, (packed.where("open").agg(F.max("part")).first()[0] or 0) + 1
    while True:
        stage, groups = stage + 1, -(-parts // fan_in)
        left = packed.where("open").withColumn("__group", F.floor(F.col("part") / fan_in))
        packed = cut(left.groupBy("__group").applyInArrow(merge(stage, groups == 1), SCHEMA), "packed")
        done.append(packed.where("NOT open"))
        if groups == 1:
            break
        parts = groups
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionAll(more)
    return whole.drop("part", "open")


def op5_bounded_windows(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024."""
    pieces = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
