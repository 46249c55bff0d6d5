import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from babelshelf.operators import prediction
from babelshelf.operators.prediction import Thresholds
from babelshelf.sources import connectors

RULES = Thresholds(normal=2.0, final=0.5, minimum=0.0, use_picker=False)


def reader():
    return lambda file, segment, start, end: (file["file_id"], segment, start, file["runtime"] if end is None else end)


def short_only(most, on_cpu=None):
    """A model that runs out of memory above so many seconds, on the processor above ``on_cpu``."""

    def load(device):
        def model(sound):
            _, _, start, end = sound
            if end - start > (on_cpu if device == "cpu" and on_cpu else most):
                raise MemoryError
            return [(f"{device} {start:.3f}-{end:.3f}", 1.0)]

        return model

    return load


def run(spark, files, load, length, t=RULES, **more):
    """In one task, whose state all files share."""
    df = spark.createDataFrame(files, "file_id long, runtime double").coalesce(1)
    return connectors.classified(df, reader(), load, length, t, **more)


def test_segments_shrink_until_they_fit(spark):
    """The first file pays for the shrinks, the others begin with the length that it found."""
    length = 100.0
    errors = next(k for k in range(20) if length * 0.925**k <= 70)
    rows = run(spark, [(1, 350.0), (2, 350.0)], short_only(70), length).collect()
    short = length * 0.925**errors
    for r in rows:
        assert (r.failed_too_often, r.scanned, r.segment) == (False, 1.0, int(350 // short)) and r.language == f"gpu 0.000-{short:.3f}"
    assert errors == 5


def test_processor_after_the_sixth_error(spark):
    first, second = run(spark, [(1, 90.0), (2, 90.0)], short_only(10, on_cpu=65), 100.0).orderBy("file_id").collect()
    assert first.language == "cpu 0.000-62.640" and second.language == "cpu 0.000-62.640"  # 100 shrunk six times


@pytest.mark.parametrize("legacy", [False, True])
def test_too_often(spark, legacy):
    """A file that never fits fails; others do as well only in the legacy form."""

    def load(device):
        def model(sound):
            if sound[0] == 1:
                raise MemoryError
            return [("de", 0.9)]

        return model

    rows = prediction.decided(run(spark, [(0, 50.0), (1, 50.0), (2, 50.0)], load, 20.0, legacy=legacy), RULES)
    assert [r.outcome for r in rows.orderBy("file_id").collect()] == ["success", "failed_too_often", "failed_too_often" if legacy else "success"]


def test_legacy_counts(spark):
    """Device, errors and length over a series of files, against a plain account of the rules."""
    dice = random.Random(8)
    fails = {(f, s): dice.choice([0, 0, 0, 1, 2, 4, 6, 9]) for f in range(12) for s in range(9)}

    def load(device):
        left = {}

        def model(sound):
            key = sound[:2]
            left.setdefault(key, fails.get(key, 0) if device == "gpu" else 0)
            if left[key]:
                left[key] -= 1
                raise MemoryError
            return [(f"{device} {sound[3] - sound[2]:.6f}", 1.0 / (1 + sound[1]))]

        return model

    files = [(f, 300.0) for f in range(12)]
    want, device, length = {}, "gpu", 40.0
    for f, runtime in files:
        own, first = length, None
        for s in range(int(runtime // own) + 1):
            errors, left = 0, fails.get((f, s), 0) if device == "gpu" else 0
            while left:
                left, length = left - 1, length * 0.925
                if errors >= 5 and device == "gpu":
                    device, left = "cpu", 0
                errors += 1
            first = first or f"{device} {min(own, runtime - s * own):.6f}"
        want[f] = first
    found = {r.file_id: r.language for r in run(spark, files, load, 40.0, legacy=True).collect()}
    assert found == want and device == "cpu"


def test_odd_runtimes_agree(spark):
    """Null, zero, negative, infinite and undefined runtimes, in both forms."""
    runtimes = [None, 0.0, -5.0, float("nan"), float("inf"), 29.0, 30.0, 31.0, 95.5]
    files = spark.createDataFrame(list(enumerate(runtimes)), "file_id long, runtime double")
    scores = spark.createDataFrame([(f, s, "de", 0.9, 0) for f in range(9) for s in range(5)], "file_id long, segment int, language string, p double, ord long")
    for t in (Thresholds(use_picker=False), Thresholds(minimum=0.6, maximum=0.2)):
        windows = prediction.decided(prediction.stopping_point(prediction.prefix_best(scores, prediction.segments(files, F.lit(30))), t), t)
        loop = prediction.decided(connectors.classified(files, lambda f, s, a, b: s, lambda device: lambda s: [("de", 0.9)], 30, t), t)
        assert sorted(map(tuple, windows.collect()), key=repr) == sorted(map(tuple, loop.collect()), key=repr)
        assert [r.file_id for r in loop.orderBy("file_id").collect()] == [1, 5, 6, 7, 8]
    whole = spark.createDataFrame(pd.DataFrame({"file_id": [1, 2], "runtime": [60, 45]}))
    assert connectors.classified(whole, lambda f, s, a, b: s, lambda device: lambda s: [("de", 0.9)], 30, RULES).count() == 2


def test_nothing_is_read_when_nothing_is_to_be_scanned(spark):
    def read(*_):
        raise AssertionError("read")

    files = spark.createDataFrame([(1, 100.0)], "file_id long, runtime double")
    row = prediction.decided(connectors.classified(files, read, lambda device: None, 30, Thresholds(minimum=0.6, maximum=0.2)), Thresholds(minimum=0.6, maximum=0.2)).first()
    assert (row.segment, row.scanned, row.language, row.outcome) == (None, None, None, "no_best_available")
    assert connectors.classified(files.limit(0), read, lambda device: None, 30, RULES).count() == connectors.classified(files, read, lambda device: None, 0, RULES).count() == 0
