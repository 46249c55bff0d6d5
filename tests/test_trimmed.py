import random

import pytest
from pyspark.sql import functions as F

from babelshelf.functions import means
from babelshelf.operators import trimmed


def values(dice, kind, n):
    if kind == "ties":
        return [dice.choice([0.1, 0.2, 0.2, 0.7]) for _ in range(n)]
    if kind == "powers":
        return [dice.choice([-1, 1]) * 10.0 ** dice.randrange(-300, 300) for _ in range(n)]
    if kind == "wide":
        return [dice.choice([1.7e308, -1.7e308, 5e-324, 0.0, -0.0, 1.0]) for _ in range(n)]
    return [dice.random() for _ in range(n)]


@pytest.mark.parametrize("steps", [16, 256])
def test_equals_sorted_arrays(spark, monkeypatch, steps):
    monkeypatch.setattr(trimmed, "STEPS", steps)
    dice = random.Random(steps)
    kinds = ["even", "ties"] if steps == 16 else ["even", "ties", "powers", "wide"]
    rows = [(kind, n if n % 3 else None, v) for kind in kinds for n in (1, 2, 4, 5, 6, 9, 10, 150) for v in values(dice, kind, n)]
    rows += [("odd", 1, v) for v in (None, float("nan"), float("inf"), 2.0, 4.0)] + [("none", 1, None)]
    dice.shuffle(rows)
    df = spark.createDataFrame(rows, "kind string, n int, v double").repartition(3)
    found = {(r.kind, r.n): r.mean for r in trimmed.truncated_means(df, ["kind", "n"], "v").collect()}
    finite = df.where("abs(v) < double('infinity')")
    want = {(r.kind, r.n): r.mean for r in finite.groupBy("kind", "n").agg(means.truncated(F.col("v")).alias("mean")).collect()}
    assert set(found) == set(want) and found["odd", 1] == 3.0
    for key, mean in want.items():
        assert found[key] == pytest.approx(mean, rel=1e-9, abs=1e-12) or abs(mean) == float("inf")


def test_one_large_group(spark):
    """A group with most rows, joined by a shuffle; no array stands in any plan."""
    df = spark.range(60_000).select((F.col("id") % 50 == 0).alias("small"), F.pmod(F.xxhash64("id"), F.lit(9_973)).cast("double").alias("v"))
    want = {r.small: r.mean for r in df.groupBy("small").agg(means.truncated(F.col("v")).alias("mean")).collect()}
    found = trimmed.truncated_means(df, ["small"], "v")
    assert {r.small: pytest.approx(r.mean) for r in found.collect()} == want
    assert "collect_list" not in found._jdf.queryExecution().toString()


def test_without_broadcast_and_without_rows(spark, monkeypatch):
    monkeypatch.setattr(trimmed, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame([(None, float(i)) for i in range(10)], "k string, v double")
    assert trimmed.truncated_means(df, ["k"], "v", "m").first().asDict() == {"k": None, "m": 4.5}
    assert trimmed.truncated_means(df.limit(0), ["k"], "v").count() == 0
