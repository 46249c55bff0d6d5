import math
import random
from collections import Counter

import numpy as np
import pytest

from babelshelf.llm import negatives, neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, row string, score int, cell long"
INF, NAN = float("inf"), float("nan")


def clusters(n, dim, seed, labels=4, spread=0.3):
    """Vectors of unit length around a few centres, labelled by centre with some noise."""
    dice = np.random.default_rng(seed)
    centres = dice.standard_normal((6, dim))
    kind = dice.integers(0, 6, n)
    x = centres[kind] + spread * dice.standard_normal((n, dim))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    label = np.where(dice.random(n) < 0.3, dice.integers(0, labels, n), kind % labels)
    return [(i, x[i].tolist(), int(label[i]), "y", 1, 2) for i in range(n)]


def odd_vectors(dim=8):
    """Nulls in each column, empty, zero, short, long and non-finite vectors, copies, ties and repeated rows."""
    rows = clusters(130, dim, seed=5)
    same = rows[3][1]
    rows += [(200 + i, same, i % 3, None, None, None) for i in range(60)]
    rows += [rows[0], rows[0], (100, same, 1, "", 0, 0), (0, rows[8][1], 2, "", 0, 0), (None, rows[1][1], 1, "", 0, 0), (None, None, None, None, None, None)]
    rows += [(300, None, 1, "", 0, 0), (400, [], 1, "", 0, 0), (500, [0.0] * dim, 1, "", 0, 0), (600, [1.0] * (dim - 1), 1, "", 0, 0), (700, [NAN, *([1.0] * (dim - 1))], 1, "", 0, 0)]
    rows += [(800, [INF, *([1.0] * (dim - 1))], 1, "", 0, 0), (900, [None, *([1.0] * (dim - 1))], 1, "", 0, 0), (1000, rows[2][1], None, "", 0, 0), (1100, [-x for x in same], 0, "", 0, 0), (1200, [5000.0] * dim, 1, "", 0, 0)]
    return rows


def fine(vector, dim):
    return vector is not None and len(vector) == dim and all(v is not None and math.isfinite(v) for v in vector)


def brute_nearest(rows, dim, asked, top=10):
    kept = [(r[0], np.array(r[1], dtype=float)) for r in rows if r[0] is not None and fine(r[1], dim) and any(r[1])]
    queries = {}
    for i, x in kept:
        if asked(i):
            queries[i] = min(queries.get(i, x.tolist()), x.tolist())
    out = Counter()
    for q, x in queries.items():
        found = sorted((math.sqrt(np.cumsum((y - x) ** 2)[-1]), i) for i, y in kept if i != q)[:top]
        out.update((q, rank, i, d) for rank, (d, i) in enumerate(found, 1))
    return out


def brute_hard(rows, dim, asked, positives=5, negatives_=5):
    kept = [(r[0], r[2], np.floor(256 * np.array(r[1], dtype=float))) for r in rows if r[0] is not None and r[2] is not None and fine(r[1], dim)]
    kept = [(i, label, x.astype(int)) for i, label, x in kept if (np.abs(x) < negatives.LARGEST).all()]
    out = Counter()
    for n, (a, label, x) in enumerate(kept):
        if not asked(a):
            continue
        scores = [(-int(x @ y), i, other) for k, (i, other, y) in enumerate(kept) if k != n]
        ranked = sorted(scores, key=lambda s: s[:2])
        for score, positive, _ in [s for s in ranked if s[2] == label][:positives]:
            hard = [s for s in ranked if s[2] != label and 80 * -score <= 100 * -s[0] <= 100 * -score][:negatives_]
            out.update((a, positive, rank, i, -score, -s) for rank, (s, i, _) in enumerate(hard, 1))
    return out


def result(df):
    return Counter(map(tuple, df.collect()))


HUNDREDS = "vec_id % 100 = 0"


@pytest.fixture(scope="module")
def odd_table(spark):
    return spark.createDataFrame(odd_vectors(), SCHEMA).repartition(4)


def test_negatives_of_odd_rows(spark, odd_table):
    assert result(negatives.mine(odd_table, HUNDREDS)) == brute_hard(odd_vectors(), 8, lambda i: i % 100 == 0)


@pytest.mark.parametrize("dim", [3, 40])
def test_negatives_in_many_groups(spark, monkeypatch, dim):
    """Cells with several parts, several slices, small tiles and a sample too small for bounds."""
    for name, value in (("PIVOTS", 7), ("GROUP_ANCHORS", 5), ("SLICE_ROWS", 90), ("TILE_ROWS", 16), ("TILE_PAIRS", 64), ("SAMPLE_ROWS", 40)):
        monkeypatch.setattr(negatives, name, value)
    rows = clusters(300, dim, seed=dim)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert result(negatives.mine(df, "vec_id % 10 = 0", positives=3, negatives=2)) == brute_hard(rows, dim, lambda i: i % 10 == 0, 3, 2)


def test_groups_of_cells():
    """Every anchor has room; cells share groups with neighbours, those with too many anchors have groups for their parts."""
    dice = np.random.default_rng(6)
    points = dice.standard_normal((40, 3))
    between = np.linalg.norm(points[:, None] - points[None], axis=2)
    sizes = dice.integers(1, 30, 40).tolist()
    sizes[7] = 95
    first, parts = negatives.grouped(sizes, between, 40)
    held = Counter()
    for n, f, p in zip(sizes, first.tolist(), parts.tolist(), strict=True):
        held.update({f + k: n / p for k in range(p)})
    assert parts[7] == 3 and parts.sum() == 42 and max(held.values()) <= 40 and set(held) == set(range(len(held))) and len(held) < 30
    assert [x.tolist() for x in negatives.grouped([5], np.zeros((1, 1)), 9)] == [[0], [1]]


def test_rows_go_only_where_they_may_serve():
    """No row that an anchor of a cell needs is kept from the cell, and with clear clusters most rows are kept from most cells."""
    rows = clusters(2000, 16, seed=1, spread=0.1)
    x = np.floor(256 * np.array([r[1] for r in rows], dtype=float))
    labels, ids = np.array([r[2] for r in rows]), np.arange(len(x))
    space = negatives.Space(16, math.sqrt((x**2).sum(axis=1).max()), x[:800].astype("<i4"), labels[:800], ids[:800], ids[:800], 12)
    anchors = x[::20]
    score = anchors @ x.T
    least = np.sort(score, axis=1)[:, -6]
    points, _ = space.scaled(anchors)
    away = space.from_pivots(points)
    cell, reach = away.argmin(axis=1), space.radius(anchors, least)
    used = np.unique(cell)
    bounds = {"cell": used} | {k: np.array([f(v[cell == c]) for c in used]) for k, f, v in (("near", np.min, away.min(axis=1)), ("far", np.max, away.min(axis=1)), ("reach", np.max, reach))}
    serves = space.cells_for(x, bounds)
    needed = np.zeros_like(serves)
    for a, c in enumerate(cell):
        needed[score[a] >= least[a], np.searchsorted(used, c)] = True
    assert (serves | ~needed).all()
    assert serves.mean() < 0.5


def test_nearest_of_odd_rows(odd_table):
    assert result(neighbours.search(odd_table, HUNDREDS)) == brute_nearest(odd_vectors(), 8, lambda i: i % 100 == 0)


@pytest.mark.parametrize(("dim", "spread"), [(64, 10.0), (100, 0.3), (1, 1.0)])
def test_recall(spark, monkeypatch, dim, spread):
    """Several blocks of queries and small tiles; vectors of clusters and without."""
    for name, value in (("BLOCK_BYTES", 4_000), ("TILE_ROWS", 100), ("TILE_PAIRS", 1_000), ("SAMPLE_ROWS", 300)):
        monkeypatch.setattr(neighbours, name, value)
    rows = clusters(2000, dim, seed=dim, spread=spread)
    want = brute_nearest(rows, dim, lambda i: i % 100 == 0)
    found = result(neighbours.search(spark.createDataFrame(rows, SCHEMA).repartition(3), HUNDREDS))
    assert sum(found.values()) == sum(want.values())
    assert sum((Counter((q, i) for q, _, i, _ in found) & Counter((q, i) for q, _, i, _ in want)).values()) >= 0.99 * sum(want.values())


def test_bounds_hold_and_leave_out_most():
    """A share of true distances below the bounds as small as three and a half standard deviations tell; most pairs are left out."""
    dice = np.random.default_rng(2)
    x = np.repeat(dice.standard_normal((20, 128)), 203, axis=0) + 0.7 * dice.standard_normal((4060, 128))
    x, q = x[:4000], x[4000:4050]
    turn, centre = neighbours.rotation(128), x.mean(axis=0)
    assert np.allclose(turn @ turn.T, np.eye(128))
    bound = neighbours.Queries(q, centre, turn).nearest_possible(slice(0, 50), *neighbours.encode(x, centre, turn))
    true = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    assert (bound > true).mean() < 1e-3
    assert (bound <= np.sort(true, axis=1)[:, 9, None]).mean() < 0.2


def test_first_limits_hold():
    rows = np.random.default_rng(4).standard_normal((300, 5))
    ids = np.arange(300)
    limits = neighbours.first_limits(ids, rows, ids[:200], rows[:200], 10)
    true = np.sort(((rows[:, None] - rows[None]) ** 2).sum(axis=2) + np.where(np.eye(300), np.inf, 0), axis=1)[:, 9]
    assert (limits >= true).all()
    assert np.isinf(neighbours.first_limits(ids, rows, ids[:10], rows[:10], 10)).all()


@pytest.mark.parametrize("f", [lambda df: negatives.mine(df, HUNDREDS), lambda df: neighbours.search(df, HUNDREDS)])
def test_no_vectors(spark, f):
    assert not f(spark.createDataFrame([], SCHEMA)).collect()
    assert not f(spark.createDataFrame([(100, None, 1, "", 0, 0), (200, [], 1, "", 0, 0), (300, [NAN], 1, "", 0, 0)], SCHEMA)).collect()
    assert not f(spark.createDataFrame([(101, [1.0, 2.0], 1, "", 0, 0)], SCHEMA)).collect()


def test_label_edge(spark, tmp_path):
    dice = random.Random(1)
    rows = [(i, [dice.gauss(0, 1) for _ in range(4)], dice.choice([1, 2, 9, None, 2**31 - 1]), "", 0, 0) for i in range(210)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    read = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    moved = [(i, x, label if label is None or i % 7 else (label + 1) % 10) for i, x, label, *_ in read]
    assert result(negatives.op12_voronoi_negatives(spark, str(tmp_path))) == brute_hard(moved, 4, lambda i: i % 100 == 0)


def test_queries_equal_brute_force(spark, sf):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    moved = [(i, x, label if i % 7 else (label + 1) % 10) for i, x, label in rows]
    assert result(negatives.op12_voronoi_negatives(spark, sf)) == brute_hard(moved, 64, lambda i: i % 100 == 0)
    assert result(neighbours.op13_rotated_codes(spark, sf)) == brute_nearest(rows, 64, lambda i: i % 100 == 0)
