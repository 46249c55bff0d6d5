"""Hard-negative mining by a distributed kNN join over Voronoi cells.

The largest inner product is turned into the smallest distance: each row's integer vector x gets one more component,
sqrt(M^2 - |x|^2), M being the greatest length of all, and each anchor is scaled to length M with a further component of
zero. All points then lie at distance M from the origin, and a score s of an anchor a stands for the distance
sqrt(2 M^2 - 2 s M / |a|).

Anchors go to the cell of their nearest pivot, neighbouring cells to a group of bounded size. For each anchor a score is known that the rows it needs reach at least
(the fifth best of a bounded sample), so that they lie within a radius; a cell keeps the largest of these, and the least
and greatest distance of its anchors from the pivot. A row is sent once to each group with a cell that it might serve: by
the triangle inequality with the cell's own pivot, and by its distance from the plane between that pivot and its nearest
one. Cells with many anchors are groups of their own, in parts, and what a group gets is dealt to slices, so that no
group grows with the input. Rows are sent as often as there are groups, and anchors as often as there are slices, at most.
Within a group the join is exact, over blocks of integers. The join runs twice: among rows of an anchor's label for its
positives, then among the others for the negatives in the bands that the positives' scores set.

Of rows equal in label and vector, only those with the smallest ids can be among the first few of any anchor; the
others leave before the joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from babelshelf.llm.common import cut
from babelshelf.llm.vectors import dimension, first_of_each, matrix, packed, unpacked

POSITIVES = NEGATIVES = 5
#: Negatives score at least this part of their positive's score, in hundredths, and at most as much as the positive.
LOWEST = 80
SCALE = 256
#: Components from here on (after scaling) take no part: below, sums of products are whole numbers in doubles.
LARGEST = 1 << 20
#: Pivots, and anchors for each when there are many; anchors of a group, or of a part of a cell with more.
PIVOTS, MOST_PIVOTS = 64, 1_024
ANCHORS_PER_PIVOT, GROUP_ANCHORS = 4_096, 16_384
#: Mean rows of a slice, and rows of a slice that are compared at once.
SLICE_ROWS = 65_536
TILE_ROWS = 4_096
TILE_PAIRS = 1 << 21
#: The sample that gives the first bounds: so many rows, and no more than so many bytes.
SAMPLE_ROWS = 8_192
SAMPLE_BYTES = 16 << 20

_ROW = "vec_id long, label long, vec binary, square double"


def whole_rows(rows: DataFrame, row_id: str, label: str, vector: str, dim: int) -> DataFrame:
    """(vec_id, label, vec, square, row) with components of floor(256 x) as 32-bit integers and their sum of squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = matrix(batch.column(2), dim)
            x = np.floor(SCALE * x)
            small = (np.abs(x) < LARGEST).all(axis=1)
            at, x = pa.array(at[small]), x[small]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), packed(x.astype("<i4")), pa.array((x**2).sum(axis=1))], names=["vec_id", "label", "vec", "square"])

    slim = rows.select(F.col(f"`{row_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").alias("vec"))
    found = slim.where("vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL").mapInArrow(run, _ROW)
    return cut(found.withColumn("row", F.monotonically_increasing_id()), "whole")


class Space:
    """What all tasks share: the pivots and the sample, both bounded, and the greatest length."""

    def __init__(self, dim: int, most: float, vecs: np.ndarray, labels: np.ndarray, ids: np.ndarray, rows: np.ndarray, n_pivots: int):
        self.dim, self.most = dim, most
        self.x, self.labels, self.ids, self.rows = vecs.astype(float), labels, ids, rows
        distinct = np.sort(np.unique(vecs, axis=0, return_index=True)[1])
        self.pivots = self.lifted(self.x[distinct[:n_pivots]])
        self.between = np.linalg.norm(self.pivots[:, None] - self.pivots[None], axis=2)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Rows with their further component."""
        return np.c_[x, np.sqrt(np.maximum(0.0, self.most**2 - (x**2).sum(axis=1)))]

    def scaled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchors at length M, and the factors; those of zeros only stay at the origin."""
        length = np.linalg.norm(x, axis=1)
        factor = np.where(length > 0, self.most / np.where(length > 0, length, 1), 0)
        return np.c_[x * factor[:, None], np.zeros(len(x))], factor

    def from_pivots(self, points: np.ndarray) -> np.ndarray:
        square = (points**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1) - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def radius(self, x: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The distance within which rows lie that reach a score; a little more, for what rounding takes."""
        points, factor = self.scaled(x)
        square = (points**2).sum(axis=1) + self.most**2 - 2 * factor * np.where(np.isfinite(least), least, 0)
        return np.where(np.isfinite(least), np.sqrt(np.maximum(square, 0)), np.inf) + self.slack()

    def slack(self) -> float:
        return 1e-6 * (self.most + 1)

    def cells_for(self, x: np.ndarray, cells: dict[str, np.ndarray]) -> np.ndarray:
        """Whether each row might serve each of the ``cells``."""
        away = self.from_pivots(self.lifted(x))
        home = away.argmin(axis=1)
        own = away[:, cells["cell"]]
        gap = self.between[home][:, cells["cell"]]
        plane = (own**2 - away[np.arange(len(x)), home, None] ** 2) / (2 * np.where(gap > 0, gap, 1))
        reach = cells["reach"] + self.slack()
        return (own - cells["far"] <= reach) & (cells["near"] - own <= reach) & ((gap == 0) | (plane <= reach))


def tiles(n_anchors: int, n_rows: int) -> Iterator[tuple[slice, slice]]:
    step = max(1, TILE_PAIRS // TILE_ROWS)
    for a in range(0, n_anchors, step):
        for b in range(0, n_rows, TILE_ROWS):
            yield slice(a, a + step), slice(b, b + TILE_ROWS)


def best_of(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, column) of each anchor's ``k`` highest scores, equal ones by id; -inf is none."""
    if score.shape[1] > k:
        kth = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        a, c = np.nonzero((score >= kth[:, None]) & (score > -np.inf))
    else:
        a, c = np.nonzero(score > -np.inf)
    kept = first_of_each(a, k, -score[a, c], ids[c], rows[c])
    return a[kept], c[kept]


def kth_score(score: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th highest of each row, -inf if there are fewer."""
    return np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k] if score.shape[1] >= k else np.full(len(score), -np.inf)


def _settled(space, prepare):
    """Anchors with their cell, distance from its pivot and radius, from a function that gives the least score needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = space.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unpacked(batch.column("vec"), "<i4", shared.dim).astype(float)
            more, least = prepare(shared, batch, x)
            points, _ = shared.scaled(x)
            away = shared.from_pivots(points)
            cell = away.argmin(axis=1)
            columns = [*batch.columns, *more.values(), pa.array(cell.astype(np.int32)), pa.array(away.min(axis=1)), pa.array(shared.radius(x, least))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *more, "cell", "away", "reach"])

    return run


def _for_positives(wanted: int):
    def prepare(shared: Space, batch: pa.RecordBatch, x: np.ndarray):
        least = np.empty(len(x))
        labels, rows = batch.column("label").to_numpy(), batch.column("row").to_numpy()
        for at, _ in tiles(len(x), 1):
            score = x[at] @ shared.x.T
            score[(labels[at, None] != shared.labels) | (rows[at, None] == shared.rows)] = -np.inf
            least[at] = kth_score(score, wanted)
        return {}, least

    return prepare


def _for_negatives(wanted: int, lowest: int):
    def prepare(shared: Space, batch: pa.RecordBatch, x: np.ndarray):
        labels, scores = batch.column("label").to_numpy(), batch.column("scores")
        lengths = np.diff(scores.offsets.to_numpy())
        flat = scores.flatten().to_numpy()
        anchor = np.repeat(np.arange(len(x)), lengths)
        floor_ = -((-lowest * flat) // 100)
        for at, _ in tiles(len(flat), 1):
            score = x[anchor[at]] @ shared.x.T
            outside = (labels[anchor[at], None] == shared.labels) | (score > flat[at, None]) | (score < floor_[at, None])
            score[outside] = -np.inf
            found = kth_score(score, wanted)
            floor_[at] = np.maximum(floor_[at], np.where(np.isfinite(found), found, -(2.0**62)).astype(np.int64))
        floors = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(floor_))
        least = np.full(len(x), np.inf)
        np.minimum.at(least, anchor, floor_.astype(float))
        return {"floors": floors}, np.where(np.isfinite(least), least, -np.inf)

    return prepare


def _serving(space, cells: dict[str, np.ndarray]):
    """Rows with the list of the groups that they might serve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = space.value
        for batch in batches:
            if not batch.num_rows:
                continue
            serves = shared.cells_for(unpacked(batch.column("vec"), "<i4", shared.dim).astype(float), cells)
            wanted = np.zeros((batch.num_rows, int((cells["first"] + cells["parts"]).max())), dtype=bool)
            for cell, (first, parts) in enumerate(zip(cells["first"].tolist(), cells["parts"].tolist(), strict=True)):
                wanted[:, first : first + parts] |= serves[:, cell, None]
            row, groups = np.nonzero(wanted)
            offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=batch.num_rows))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(groups.astype(np.int32)))], names=[*batch.schema.names, "groups"])

    return run


def grouped(sizes: list[int], between: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first group, number of groups) of each cell: cells of more than ``most`` anchors have groups of their own, for their parts;
    the others are chained from neighbour to nearest neighbour, and share a group while it has room."""
    first, parts = np.zeros(len(sizes), dtype=np.int64), np.ones(len(sizes), dtype=np.int64)
    left, at, group, held = set(range(len(sizes))), 0, -1, most + 1
    while left:
        at = min(left, key=lambda c: (between[at, c], c))
        left.remove(at)
        if sizes[at] > most:
            parts[at] = -(-sizes[at] // most)
            first[at] = group + 1
            group, held = group + int(parts[at]), most + 1
            continue
        if held + sizes[at] > most:
            group, held = group + 1, 0
        first[at], held = group, held + sizes[at]
    return first, parts


def joined(space, anchors: DataFrame, rows: DataFrame, keys: list[str], kernel, schema: str) -> DataFrame:
    """The local joins of ``anchors`` and the ``rows`` that might serve them, in groups by cell, part, slice and ``keys``."""
    stats = anchors.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("near"), F.max("away").alias("far"), F.max("reach").alias("reach"))
    found = stats.orderBy("cell").toArrow().to_pydict()  # a row for each pivot at most
    own = np.array(found["cell"], dtype=np.int64)
    first, parts = grouped(found["n"], space.value.between[np.ix_(own, own)], GROUP_ANCHORS)
    cells = {"cell": own, "parts": parts, "first": first} | {x: np.array(found[x], dtype=float) for x in ("near", "far", "reach")}
    n_slices = max(1, -(-rows.count() // SLICE_ROWS))
    placed = anchors.sparkSession.createDataFrame([(int(c), int(p), int(f)) for c, p, f in zip(cells["cell"], parts, cells["first"], strict=True)], "cell int, parts long, first long")
    held = anchors.join(F.broadcast(placed), "cell").withColumn("group", (F.col("first") + F.pmod(F.xxhash64("row"), "parts")).cast("int")).drop("cell", "parts", "first", "away", "reach")
    held = held.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))))
    sent = rows.mapInArrow(_serving(space, cells), f"{_ROW}, row long, groups array<int>").withColumn("group", F.explode("groups")).drop("groups", "square")
    sent = sent.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(n_slices)).cast("int"))
    by = [*keys, "group", "slice"]
    return held.groupBy(*by).cogroup(sent.groupBy(*by)).applyInArrow(kernel, schema)


def _positives(dim: int, wanted: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if len(anchors) and len(rows):
            a, x = unpacked(anchors["vec"], "<i4", dim).astype(float), unpacked(rows["vec"], "<i4", dim)
            own, ids, row = anchors["row"].to_numpy(), rows["vec_id"].to_numpy(), rows["row"].to_numpy()
            for at, to in tiles(len(a), len(x)):
                score = a[at] @ x[to].astype(float).T
                score[own[at, None] == row[to]] = -np.inf
                i, j = best_of(score, ids[to], row[to], wanted)
                out.append(np.c_[i + at.start, j + to.start, score[i, j].astype(np.int64)])
        found = np.concatenate(out) if out else np.zeros((0, 3), dtype=np.int64)
        if len(found):
            found = found[first_of_each(found[:, 0], wanted, -found[:, 2], ids[found[:, 1]], row[found[:, 1]])]
        return pa.table({"row": anchors["row"].take(pa.array(found[:, 0])), "positive_id": rows["vec_id"].take(pa.array(found[:, 1])), "positive_row": rows["row"].take(pa.array(found[:, 1])), "score": pa.array(found[:, 2])})

    return run


def _negatives(dim: int, wanted: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if len(anchors) and len(rows):
            a, x = unpacked(anchors["vec"], "<i4", dim).astype(float), unpacked(rows["vec"], "<i4", dim)
            labels, other = anchors["label"].to_numpy(), rows["label"].to_numpy()
            ids, row = rows["vec_id"].to_numpy(), rows["row"].to_numpy()
            scores, floors = anchors["scores"].to_pylist(), anchors["floors"].to_pylist()
            deep = max(map(len, scores))
            high, low = (np.array([[*v, *[fill] * (deep - len(v))] for v in values], dtype=float) for values, fill in ((scores, -np.inf), (floors, np.inf)))
            for at, to in tiles(len(a), len(x)):
                score = a[at] @ x[to].astype(float).T
                score[labels[at, None] == other[to]] = -np.inf
                for p in range(deep):
                    i, j = np.nonzero((score <= high[at, p, None]) & (score >= low[at, p, None]))
                    value = score[i, j].astype(np.int64)
                    kept = first_of_each(i, wanted, -value, ids[to][j], row[to][j])
                    out.append(np.c_[i[kept] + at.start, np.full(len(kept), p), j[kept] + to.start, value[kept]])
        found = np.concatenate(out) if out else np.zeros((0, 4), dtype=np.int64)
        if len(found):
            found = found[first_of_each(found[:, 0] * deep + found[:, 1], wanted, -found[:, 3], ids[found[:, 2]], row[found[:, 2]])]
        return pa.table({"row": anchors["row"].take(pa.array(found[:, 0])), "place": pa.array(found[:, 1]), "negative_id": rows["vec_id"].take(pa.array(found[:, 2])), "negative_row": rows["row"].take(pa.array(found[:, 2])), "negative_score": pa.array(found[:, 3])})

    return run


def first_rows(rows: DataFrame, by: list[str], n: int, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(vectors: DataFrame, anchor: Column | str, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, row_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the hard negatives of each anchor and positive.

    Components become floor(256 x); a score is the integer inner product with the anchor; higher scores come first, equal ones
    by ascending id. ``anchor``, a condition on the id, tells the anchors. Their positives are the first ``positives`` other rows of
    their label; for each, the first ``negatives`` rows of other labels come that score between ``lowest`` hundredths of the
    positive's score and that score. Rows without id or label, vectors that are null, empty, hold a null or non-finite
    component or one of 4,096 or more, or have another length than the commonest take no part. Rows that repeat an id are
    rows of their own, as anchors too. An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    dim = dimension(vectors, vector)
    if not dim:
        return spark.createDataFrame([], _RESULT)
    rows = whole_rows(vectors, row_id, label, vector, dim)
    first = cut(first_rows(rows, ["label", "vec"], max(positives + 1, negatives), F.col("vec_id"), F.col("row")).drop("rank"), "first")
    chosen = rows.where(anchor)
    n_anchors, most = chosen.count(), first.agg(F.max("square")).first()[0]
    sample = first.orderBy(F.xxhash64("vec", "vec_id"), "row").limit(min(SAMPLE_ROWS, max(1, SAMPLE_BYTES // (8 * dim)))).toArrow()
    if not n_anchors:
        return spark.createDataFrame([], _RESULT)
    n_pivots = min(MOST_PIVOTS, max(PIVOTS, -(-n_anchors // ANCHORS_PER_PIVOT)))
    space = spark.sparkContext.broadcast(Space(dim, math.sqrt(most), unpacked(sample["vec"], "<i4", dim), sample["label"].to_numpy(), sample["vec_id"].to_numpy(), sample["row"].to_numpy(), n_pivots))
    cell = "cell int, away double, reach double"

    settled = cut(chosen.mapInArrow(_settled(space, _for_positives(positives)), f"{_ROW}, row long, {cell}"), "anchors")
    near = joined(space, settled, first, ["label"], _positives(dim, positives), "row long, positive_id long, positive_row long, score long")
    near = first_rows(near, ["row"], positives, F.desc("score"), F.col("positive_id"), F.col("positive_row"))
    listed = near.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "score"))).alias("found"))  # at most ``positives`` each
    banded = chosen.join(listed, "row").select(*chosen.columns, F.col("found.positive_id").alias("positive_ids"), F.col("found.score").alias("scores"))

    lists = "positive_ids array<long>, scores array<long>, floors array<long>"
    settled = cut(banded.mapInArrow(_settled(space, _for_negatives(negatives, lowest)), f"{_ROW}, row long, {lists}, {cell}"), "banded")
    hard = joined(space, settled, first, [], _negatives(dim, negatives), "row long, place long, negative_id long, negative_row long, negative_score long")
    hard = first_rows(hard, ["row", "place"], negatives, F.desc("negative_score"), F.col("negative_id"), F.col("negative_row"))
    at = (F.col("place") + 1).cast("int")
    named = settled.select("row", F.col("vec_id").alias("anchor_id"), "positive_ids", "scores")
    return hard.join(named, "row").select("anchor_id", F.element_at("positive_ids", at).alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id", F.element_at("scores", at).alias("positive_score"), "negative_score")


def op12_voronoi_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of each row whose id is divisible by 100, after every seventh id has moved to the next label."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH c AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
t AS (SELECT a.r AS a, a.vec_id AS anchor_id, a.label AS anchor_label, b.r AS b, b.vec_id, b.label, list_dot_product(a.v, b.v)::BIGINT AS score FROM (SELECT * FROM c WHERE vec_id % 100 = 0) a JOIN c b ON a.r <> b.r),
p AS (SELECT * FROM t WHERE label = anchor_label QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.vec_id, n.b)::INTEGER AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN t n ON n.a = p.a AND n.label <> n.anchor_label AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""
