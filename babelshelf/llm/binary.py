"""Token ids in binary files of fixed bit width, with block offsets for random access.

File: 8 bytes ``BSHELF1`` and a zero; blocks of ``BLOCK_IDS`` ids (the last may be shorter), each id in ``width``
bits, high bit first, each block padded to a whole byte; then the footer: block offsets, doc_ids, ends (ids of the
file up to and with each document), each ``<i8``, one byte per document that is 1 where doc_id is null; then
``<5q``: number of blocks, documents and ids, width, footer's offset; then the 8 bytes again.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelshelf.llm.common import cut, identified, shared_path
from babelshelf.llm.tokens import blocks, encoder, tokenizer_path

MAGIC = b"BSHELF1\0"
BLOCK_IDS = 1 << 16
END_ID = 0
MANIFEST = "part int, path string, n_docs long, n_ids long"


def width_for(n_ids: int) -> int:
    """Fewest bits that hold the ids 0 to ``n_ids - 1``."""
    return max(1, (n_ids - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width == 16:
        return ids.astype(">u2").tobytes()
    bits = np.unpackbits(ids.astype(">u4").view(np.uint8)).reshape(-1, 32)[:, 32 - width :]
    return np.packbits(bits.ravel()).tobytes()


def unpack(raw: bytes, n: int, width: int) -> np.ndarray:
    if width == 16:
        return np.frombuffer(raw, dtype=">u2", count=n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=n * width).reshape(n, width)
    wide = np.zeros((n, 32), dtype=np.uint8)
    wide[:, 32 - width :] = bits
    return np.packbits(wide, axis=1).reshape(-1).view(">u4").astype("<u4")


class Writer:
    """Writes one file; ids are held until a block is full."""

    def __init__(self, out, width: int, block_ids: int = BLOCK_IDS):
        self.out, self.width, self.block_ids = out, width, block_ids
        self.rest, self.n_rest, self.n_ids, self.at = [], 0, 0, len(MAGIC)
        self.blocks, self.docs, self.ends = [], [], []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.n_ids += len(ids)
        self.ends.append(self.n_ids)
        self.rest.append(ids)
        self.n_rest += len(ids)
        if self.n_rest >= self.block_ids:
            held = np.concatenate(self.rest)
            whole = len(held) // self.block_ids * self.block_ids
            for a in range(0, whole, self.block_ids):
                self._block(held[a : a + self.block_ids])
            self.rest, self.n_rest = [held[whole:]], len(held) - whole

    def _block(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.width)
        self.blocks.append(self.at)
        self.at += len(raw)
        self.out.write(raw)

    def close(self) -> None:
        if self.n_rest:
            self._block(np.concatenate(self.rest))
        none = np.array([x is None for x in self.docs], dtype=np.uint8)
        for part in (self.blocks, [x or 0 for x in self.docs], self.ends):
            self.out.write(np.array(part, dtype="<i8").tobytes())
        self.out.write(none.tobytes())
        self.out.write(struct.pack("<5q", len(self.blocks), len(self.docs), self.n_ids, self.width, self.at) + MAGIC)


class Reader:
    """Random access to one file: only the footer and the blocks asked for are read."""

    def __init__(self, source, block_ids: int = BLOCK_IDS):
        self.source, self.block_ids = source, block_ids
        end = source.size()
        tail = 40 + len(MAGIC)
        last = self._at(end - tail, tail)
        if last[40:] != MAGIC or self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token file, or cut short")
        n_blocks, self.n_docs, self.n_ids, self.width, self.foot = struct.unpack("<5q", last[:40])
        foot = self._at(self.foot, end - tail - self.foot)
        numbers = np.frombuffer(foot, dtype="<i8", count=n_blocks + 2 * self.n_docs)
        self.offsets, self.docs, self.ends = numbers[:n_blocks], numbers[n_blocks : n_blocks + self.n_docs], numbers[n_blocks + self.n_docs :]
        self.none = np.frombuffer(foot, dtype=np.uint8, offset=8 * len(numbers)).astype(bool)

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, k: int) -> np.ndarray:
        n = min(self.block_ids, self.n_ids - k * self.block_ids)
        return unpack(self._at(int(self.offsets[k]), (n * self.width + 7) // 8), n, self.width)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a to b - 1 of the file."""
        if a >= b:
            return np.zeros(0, dtype="<u4")
        first = a // self.block_ids
        found = np.concatenate([self.block(k) for k in range(first, (b - 1) // self.block_ids + 1)])
        return found[a - first * self.block_ids : b - first * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        """Ids of the file's document number i."""
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order, each block read once."""
        held, at, k = np.zeros(0, dtype="<u4"), 0, 0
        begin = 0
        for i in range(self.n_docs):
            end, parts = int(self.ends[i]), [held[begin - at :]]
            have = at + len(held)
            while have < end:
                parts.append(self.block(k))
                have += len(parts[-1])
                k += 1
            if len(parts) > 1:
                held, at = np.concatenate(parts), begin
            yield None if self.none[i] else int(self.docs[i]), held[begin - at : end - at]
            begin = end


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes files below ``folder`` (a URI that pyarrow opens) and returns one row for each, with ``first_id``.

    Files and the documents in them are in ascending doc_id order, null ids first; ``first_id`` counts the ids of
    all files before. Null texts are empty: such a document is its end id. Rows with equal ids stand next to each
    other, ordered by a hash of their texts and then by their place, so that not even repeated rows need go into one
    file. Other columns are ignored; an empty table gives no files. A task that runs again writes the same file again
    under the same name.
    """
    path = tokenizer or tokenizer_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        store, base = pafs.FileSystem.from_uri(folder)
        final, own = f"{base}/tokens-{part:06d}.bin", f"{base}/.tokens-{part:06d}-{TaskContext.get().taskAttemptId()}"
        writer = out = None
        for batch, texts in blocks(batches):
            if writer is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(own)
                writer = Writer(out, width_for(enc.n_ids))
            ends, ids = enc(texts)
            a = 0
            for doc_id, b in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
                writer.add(doc_id, np.append(ids[a:b], enc.dtype.type(end_id)))
                a = b
        if writer is not None:
            writer.close()
            out.close()
            store.move(own, final)
            uri = folder.rstrip("/") + f"/tokens-{part:06d}.bin"
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [uri], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids]})

    keys = ("doc_id", "__text", "__place")
    rows = identified(docs, "__at", ("doc_id", "text")).select("doc_id", "text", F.xxhash64("text").alias("__text"), F.xxhash64("__at").alias("__place"))
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    files = cut(ordered.mapInArrow(write, MANIFEST), "token-files")
    # One row per file, of at least tens of MB at scale.
    return files.withColumn("first_id", F.expr("coalesce(sum(n_ids) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))


def read_token_files(files: DataFrame, spread: int) -> DataFrame:
    """(doc_id, start, ids) of every document; ``ids`` as little-endian unsigned 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, path = pafs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as source:
                    rows, held, start = [], 0, first
                    for doc_id, ids in Reader(source).documents():
                        rows.append((doc_id, start, ids.astype("<u4").tobytes()))
                        start += len(ids)
                        held += 4 * len(ids)
                        if held >= 8 << 20:
                            yield _rows(rows)
                            rows, held = [], 0
                    if rows:
                        yield _rows(rows)

    return files.select("path", "first_id").repartition(spread, "path").mapInArrow(read, "doc_id long, start long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "ids"])


def op6_bit_packed(spark, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents and reads them back from the files."""
    files = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_path(spark, "token-bin"))
    found = read_token_files(files, max(1, files.count()))
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
