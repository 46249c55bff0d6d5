"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are taken relative to a centre, scaled to length one and rotated at random; the signs of what results are the
code. ``close`` is the inner product of the unit vector with its code (as a unit vector, too). The inner product with a
query is estimated without bias as that of code and query, divided by ``close``; its error has a standard deviation of
sqrt((1 - close^2) / close^2 / (dim - 1)), as the code's part across the vector points in a random direction. The query is
rounded to ``QUERY_BITS`` bits, so that its inner product with a code is a few counts of common bits. A vector whose
distance may be below the query's threshold when the estimate errs by ``SURE`` standard deviations is ranked by its exact
distance, others are left out.

A first threshold for each query is its k-th distance in a bounded sample, so that every task leaves out nearly all
from the start; each task lowers it as it goes and returns k rows for a query at most. Queries are broadcast in blocks of
bounded size, and for each block the index is read once, without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from babelshelf.llm.common import cut
from babelshelf.llm.vectors import dimension, first_of_each, matrix, packed, unpacked

TOP = 10
SEED = 13
QUERY_BITS = 4
#: Standard deviations by which an estimate may err; one neighbour in 4,000 errs by more to the wrong side.
SURE = 3.5
#: The sample from which the centre and the first thresholds come: so many rows, and no more than so many bytes.
SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 16 << 20
#: Bytes of the queries that are broadcast at once, and vectors of the index that a task compares at once.
BLOCK_BYTES = 16 << 20
TILE_ROWS = 8_192
#: Pairs estimated or ranked at once.
TILE_PAIRS = 1 << 20


def clean(rows: DataFrame, row_id: str, vector: str, dim: int) -> DataFrame:
    """(vec_id, vector) of the rows that have an id and ``dim`` finite components, not all of them zero."""
    x = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return rows.where(F.col(f"`{row_id}`").isNotNull() & (F.size(f"`{vector}`") == dim) & fine).select(F.col(f"`{row_id}`").cast("long").alias("vec_id"), x.alias("vector"))


def sample_of(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a bounded sample, the same in each run: those with the smallest hashes."""
    n = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    found = rows.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(n).toArrow().combine_chunks()
    _, x = matrix(found.column("vector").combine_chunks() if found.num_rows else pa.array([], pa.list_(pa.float64())), dim)
    return found.column("vec_id").to_numpy(), x


def rotation(dim: int) -> np.ndarray:
    """A random rotation, the same for all who ask."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words, filled up with zeros."""
    return np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1).view(np.uint64)


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes as words, distances from the centre, and inner products of unit vectors with their codes."""
    off = x - centre
    norm = np.linalg.norm(off, axis=1)
    z = off @ turn / np.where(norm > 0, norm, 1)[:, None]
    return words(z > 0), norm, np.where(norm > 0, np.abs(z).sum(axis=1) / math.sqrt(x.shape[1]), 1.0)


class Queries:
    """A block of queries, made ready for estimates: bit planes and what they stand for."""

    def __init__(self, x: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        dim = x.shape[1]
        off = x - centre
        self.dim, self.norm = dim, np.linalg.norm(off, axis=1)
        z = off @ turn / np.where(self.norm > 0, self.norm, 1)[:, None]
        self.low = z.min(axis=1)
        self.step = np.maximum((z.max(axis=1) - self.low) / ((1 << QUERY_BITS) - 1), 1e-300)
        levels = np.rint((z - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        rounded = self.low[:, None] + self.step[:, None] * levels
        self.total = rounded.sum(axis=1)
        self.lost = np.linalg.norm(z - rounded, axis=1)
        self.planes = np.stack([words((levels >> b & 1).astype(bool)) for b in range(QUERY_BITS)])

    def nearest_possible(self, at: slice, codes: np.ndarray, norm: np.ndarray, close: np.ndarray) -> np.ndarray:
        """For queries ``at`` and each vector, a squared distance that the true one is hardly below."""
        common = np.zeros((len(self.norm[at]), len(codes)), dtype=np.int32)
        for b in range(QUERY_BITS):
            for w in range(codes.shape[1]):
                common += np.bitwise_count(self.planes[b, at, w, None] & codes[None, :, w]).astype(np.int32) << b
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int32)
        with_code = (2 * (self.low[at, None] * ones + self.step[at, None] * common) - self.total[at, None]) / math.sqrt(self.dim)
        spread = np.sqrt(np.maximum(0, 1 - close**2) / max(1, self.dim - 1))
        lost = self.lost[at, None] / math.sqrt(self.dim)
        reach = np.minimum(1.0, (with_code + SURE * np.hypot(spread, lost)) / close)
        return self.norm[at, None] ** 2 + norm**2 - 2 * self.norm[at, None] * norm * reach


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, added up from the first component to the last."""
    return np.cumsum((x - y) ** 2, axis=1)[:, -1]


class Nearest:
    """The best rows so far for each query of a block; ``limit`` is the squared distance from which on others don't count."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, limit: np.ndarray, top: int):
        self.ids, self.x, self.limit, self.top = ids, x, limit.copy(), top
        self.query = self.found = np.zeros(0, dtype=np.int64)
        self.square = np.zeros(0)

    def add(self, query: np.ndarray, row: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Pairs of a query's place and a row's, ranked by their exact distance."""
        for a in range(0, len(query), TILE_PAIRS // 8):
            q, r = query[a : a + TILE_PAIRS // 8], row[a : a + TILE_PAIRS // 8]
            square = squares(x[r], self.x[q])
            ok = (square <= self.limit[q]) & (ids[r] != self.ids[q])
            self.query, self.found, self.square = np.r_[self.query, q[ok]], np.r_[self.found, ids[r[ok]]], np.r_[self.square, square[ok]]
            self.trim()

    def trim(self) -> None:
        kept = first_of_each(self.query, self.top, self.square, self.found)
        self.query, self.found, self.square = self.query[kept], self.found[kept], self.square[kept]
        full = np.flatnonzero(np.bincount(self.query, minlength=len(self.ids)) == self.top)
        worst = np.zeros(len(self.ids))
        np.maximum.at(worst, self.query, self.square)
        self.limit[full] = np.minimum(self.limit[full], worst[full])


def first_limits(ids: np.ndarray, x: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, top: int) -> np.ndarray:
    """For each query a squared distance that its ``top``-th nearest row doesn't exceed, as the sample shows."""
    if len(sample_ids) <= top:
        return np.full(len(ids), np.inf)
    lengths, out = (sample**2).sum(axis=1), np.empty(len(ids))
    step = max(1, TILE_PAIRS * 4 // len(sample_ids))
    for a in range(0, len(ids), step):
        q = x[a : a + step]
        square = (q**2).sum(axis=1)[:, None] + lengths - 2 * (q @ sample.T)
        square += 1e-9 * ((q**2).sum(axis=1)[:, None] + lengths)  # what rounding may have taken
        square[sample_ids[None, :] == ids[a : a + step, None]] = np.inf
        out[a : a + step] = np.partition(square, top - 1, axis=1)[:, top - 1]
    return out


def search(rows: DataFrame, asked: Column | str, top: int = TOP, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest rows found for each row where ``asked`` holds.

    ``score`` is the Euclidean distance of the vectors as they are given, in double precision; equal scores come by ascending id.
    Rows without an id, and vectors that are null, empty, zero or hold a null or non-finite component take no part; nor
    do vectors of another length than the commonest. Rows that repeat an id are ranked one by one, but not for a query
    with that id, which is asked once, with the smallest of its vectors. With fewer rows than ``top`` all are returned;
    an empty table gives an empty result. Other columns are ignored.
    """
    spark = rows.sparkSession
    schema = "query_id long, vec_id long, square double"
    dim = dimension(rows, vector)
    fine = clean(rows, row_id, vector, max(dim, 1))
    sample_ids, sample = sample_of(fine, max(dim, 1))
    if not len(sample_ids):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    centre, turn = sample.mean(axis=0), rotation(dim)
    width = -(-dim // 64)
    shared = spark.sparkContext.broadcast((sample_ids, sample, centre, turn))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, centre, turn = shared.value
        for batch in batches:
            at, x = matrix(batch.column(1), dim)
            codes, norm, close = encode(x, centre, turn)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), packed(codes), pa.array(norm), pa.array(close), packed(x)], names=["vec_id", "code", "norm", "close", "vector"])

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample_ids, sample, _, _ = shared.value
        for batch in batches:
            at, x = matrix(batch.column(1), dim)
            ids = batch.column(0).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([ids, packed(x), pa.array(first_limits(ids.to_numpy(), x, sample_ids, sample, top))], names=["vec_id", "vector", "square"])

    index = cut(fine.mapInArrow(coded, "vec_id long, code binary, norm double, close double, vector binary"), "codes")
    questions = rows.where(asked).select(F.col(f"`{row_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("vector"))
    questions = clean(questions, "vec_id", "vector", dim).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    questions = cut(questions.mapInArrow(started, "vec_id long, vector binary, square double"), "queries")
    n_blocks = max(1, -(-questions.count() * (8 * dim + 16) // BLOCK_BYTES))
    results = []
    for k in range(n_blocks):
        block = questions.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == k).toArrow().combine_chunks()
        sent = spark.sparkContext.broadcast((block.column("vec_id").to_numpy(), unpacked(block.column("vector"), "f8", dim), block.column("square").to_numpy()))
        results.append(cut(index.mapInArrow(_scan(shared, sent, dim, width, top), schema), "nearest"))
        sent.destroy()
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionAll(more)
    order = Window.partitionBy("query_id").orderBy("square", "vec_id")
    ranked = whole.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", F.sqrt("square").alias("score"))


def _scan(shared, sent, dim: int, width: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, centre, turn = shared.value
        ids, x, limit = sent.value
        if not len(ids):
            return
        queries, nearest = Queries(x, centre, turn), Nearest(ids, x, limit, top)
        for batch in batches:
            for a in range(0, batch.num_rows, TILE_ROWS):
                part = batch.slice(a, TILE_ROWS)
                codes, vectors, found = unpacked(part.column(1), "u8", width), unpacked(part.column(4), "f8", dim), part.column(0).to_numpy()
                norm, close = part.column(2).to_numpy(), part.column(3).to_numpy()
                step = max(1, TILE_PAIRS // len(codes))
                for b in range(0, len(ids), step):
                    tile = slice(b, b + step)
                    query, row = np.nonzero(queries.nearest_possible(tile, codes, norm, close) <= nearest.limit[tile, None])
                    nearest.add(query + b, row, found, vectors)
        yield pa.RecordBatch.from_arrays([pa.array(ids[nearest.query]), pa.array(nearest.found), pa.array(nearest.square)], names=["query_id", "vec_id", "square"])

    return run


def op13_rotated_codes(spark, sf_dir: str) -> DataFrame:
    """The ten nearest rows found for each row whose id is divisible by 100."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT vec_id, r FROM (SELECT vec_id, r, unnest(x) AS c FROM v) GROUP BY vec_id, r HAVING bool_and(c IS NOT NULL AND isfinite(c)) AND bool_or(c <> 0)),
f AS (SELECT v.* FROM v JOIN ok USING (vec_id, r)),
d AS (SELECT q.vec_id AS query_id, f.vec_id, f.r, sqrt(list_reduce(list_transform(range(1, len(f.x) + 1), lambda i: (f.x[i] - q.x[i]) * (f.x[i] - q.x[i])), lambda a, b: a + b)) AS score
FROM (SELECT * FROM f WHERE vec_id % 100 = 0) q JOIN f ON f.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score FROM d) WHERE rank <= 10
"""
