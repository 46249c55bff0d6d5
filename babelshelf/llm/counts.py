"""Token counts by a two-tier lookup of pre-token lengths on the map side.

The first tier is a compact hash table of frequent pre-tokens and their lengths, which is broadcast: those that occur
most often in a bounded sample of the documents, and the pieces that the tokenizer itself holds as words of their own.
It is open-addressed: arrays of 64-bit hashes, of places, of lengths and of bytes that confirm what a hash finds. The
second tier encodes what the table lacks, once for each worker as long as it stays in its cache. Rows stay in their
tasks; nothing is shuffled. The sample decides what is looked up where, never a count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelshelf.llm.tokens import Generations, PieceEncoder, blocks, encoder, is_safe, safe, split, tokenizer_path

#: Lengths remembered by a worker, in each of two generations.
CACHE_LENGTHS = 500_000
#: The sample: so many files, evenly spread over all, so many documents of each, of no more than so many characters.
SAMPLE_FILES, SAMPLE_DOCS, SAMPLE_CHARS = 8, 250, 50_000
#: Pieces of the sample that the table takes, the most frequent first, and bytes of a piece in it: 14 MB at most.
MOST_PIECES, PIECE_BYTES = 200_000, 48
_lengths: dict[str, Generations] = {}


def hashes_of(words: pa.Array) -> np.ndarray:
    """64-bit hashes, none of them 0, which marks a free slot."""
    found = pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    return np.where(found == 0, np.uint64(1), found)


class LengthTable:
    """An open-addressed hash table from pieces to their numbers of tokens; a piece is in the next free slot after its hash's."""

    def __init__(self, pieces: list[str], lengths: list[int]):
        self.pieces, self.lengths = pa.array(pieces, pa.large_string()), np.array(lengths, dtype=np.int32)
        size = 1 << max(1, (2 * len(pieces)).bit_length())  # half of the slots stay free at least
        self.mask, self.hashes, self.which = np.uint64(size - 1), np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.int32)
        own = hashes_of(self.pieces)
        left = np.sort(np.unique(own, return_index=True)[1])  # of pieces with equal hashes only the first is held
        slot = own & self.mask
        while len(left):
            free = left[self.hashes[slot[left]] == 0]
            taken, first = np.unique(slot[free], return_index=True)
            self.hashes[taken], self.which[taken] = own[free[first]], free[first]
            left = np.setdiff1d(left, free[first])
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def find(self, words: pa.Array) -> np.ndarray:
        """Numbers of tokens, -1 for pieces that the table lacks."""
        out = np.full(len(words), -1, dtype=np.int64)
        if not len(self.pieces) or not len(words):
            return out
        short = np.flatnonzero(pc.binary_length(words).to_numpy() <= PIECE_BYTES)
        names = words.take(pa.array(short))
        own, which = hashes_of(names), np.full(len(short), -1, dtype=np.int32)
        slot, left = own & self.mask, np.arange(len(short))
        while len(left):
            there = self.hashes[slot[left]]
            hit = there == own[left]
            which[left[hit]] = self.which[slot[left[hit]]]
            left = left[~hit & (there != 0)]
            slot[left] = (slot[left] + np.uint64(1)) & self.mask
        hits = np.flatnonzero(which >= 0)
        same = pc.equal(names.take(pa.array(hits)).cast(pa.large_string()), self.pieces.take(pa.array(which[hits]))).to_numpy(zero_copy_only=False)
        hits = hits[same.astype(bool)]
        out[short[hits]] = self.lengths[which[hits]]
        return out


def sampled(docs: DataFrame) -> list[str]:
    """The texts of a bounded number of documents of bounded length, from files that lie evenly among all; they choose the table's pieces only."""
    files = sorted(docs.inputFiles())
    few = files[:: max(1, -(-len(files) // SAMPLE_FILES))]
    texts = docs.where(F.length("text") <= SAMPLE_CHARS)
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation" or not few:
        parts = [texts]
    else:
        parts = [texts.where(F.col("_metadata.file_path").isin(f, f.replace("file:///", "file:/"))) for f in few]  # both forms occur
    return [r[0] for part in parts for r in part.select("text").limit(SAMPLE_DOCS).collect()]


def frequent_lengths(path: str, texts: list[str] = ()) -> LengthTable:
    """The safe pieces of ``texts``, the most frequent first, then those that are words of the vocabulary, by their ids.

    Nothing if pieces don't work for the vocabulary.
    """
    enc = encoder(path)
    if not enc.by_piece:
        return LengthTable([], [])
    seen: Counter = Counter()
    for at in range(0, len(texts), 100):
        _, index, words = split(pa.array(texts[at : at + 100], pa.large_string()))
        seen.update(dict(zip(words.to_pylist(), np.bincount(index, minlength=len(words)).tolist(), strict=True)))
    often = [x for x, n in seen.most_common(MOST_PIECES) if n > 1 and is_safe(x)]
    words = [text[1:] if text[0] == " " else text for text in enc.words() if is_safe(text[1:])]
    pieces = [x for x in dict.fromkeys([*often, *words]) if len(x.encode()) <= PIECE_BYTES]
    return LengthTable(pieces, [len(x) // enc.dtype.itemsize for x in enc.encode_pieces(pieces)])


def count_tokens(texts: pa.Array, enc: PieceEncoder, table: LengthTable, cache: Generations) -> np.ndarray:
    """Tokens of each text: sums of piece lengths from ``table``, then ``cache``, then the encoder."""
    if not enc.by_piece:
        return np.array([len(x) for x in enc.encode(texts.to_pylist())], dtype=np.int64)
    offsets, index, words = split(texts)
    found = table.find(words)
    rare = np.flatnonzero(found < 0)
    left = words.take(pa.array(rare))
    names = left.to_pylist()
    lengths = cache.find(names)
    missing = [i for i, ok in enumerate(safe(left).tolist()) if ok and lengths[i] is None]
    pieces = [names[i] for i in missing]
    new = [len(ids) // enc.dtype.itemsize for ids in enc.encode_pieces(pieces)]
    for i, x in zip(missing, new, strict=True):
        lengths[i] = x
    cache.put_all(pieces, new)
    found[rare] = [-1 if x is None else x for x in lengths]
    lens = found[index]
    counts = np.add.reduceat(lens, offsets[:-1]) - 1  # the leading newline's
    for r in np.flatnonzero(np.minimum.reduceat(lens, offsets[:-1]) < 0).tolist():
        counts[r] = len(enc.encode_doubtful(words.take(pa.array(index[offsets[r] : offsets[r + 1]])).to_pylist()))
    return counts


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row's whole text.

    Counts are those of the library for the file, without added special tokens; null and empty texts have none.
    Rows are independent: repeated rows and null ids are counted like any other, other columns are ignored, an
    empty table gives an empty result.
    """
    path = tokenizer or tokenizer_path()
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(path, sampled(docs)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, cache = encoder(path), _lengths.setdefault(path, Generations(CACHE_LENGTHS))
        for batch, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count_tokens(texts, enc, table.value, cache), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    slim = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    id_type = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op7_two_tier_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
