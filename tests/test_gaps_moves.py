import random
from collections import Counter, defaultdict

from babelshelf.operators import gaps, rescan


def test_gaps_and_duplicates(spark):
    dice = random.Random(4)
    rows = [(dice.choice(["a", "b", None]), dice.choice([1, 2]), dice.choice([None, 0, -3, *range(1, 60)])) for _ in range(160)]
    rows += [("whole", 1, n) for n in range(1, 9)] + [("one", 1, 1), ("late", 1, 10**12), ("special", 1, 0), ("none", 1, None)]
    df = spark.createDataFrame(rows, "series string, season int, episode long").repartition(3)
    by = defaultdict(Counter)
    for series, season, n in rows:
        if n is not None and n >= 1:
            by[series, season][n] += 1
    want = set()
    for key, found in by.items():
        known, holes = sorted(found), []
        for a, b in zip([0, *known], known, strict=False):
            if b - a > 1:
                holes.append((a + 1, b - 1))
        want |= {(*key, False, a, b, b - a + 1) for a, b in holes} or {(*key, True, None, None, 0)}
    assert {tuple(r) for r in gaps.missing(df, ["series", "season"], "episode").collect()} == want
    assert {tuple(r) for r in gaps.duplicates(df, ["series", "season"], "episode").collect()} == {(*key, n, c) for key, found in by.items() for n, c in found.items() if c > 1}
    assert gaps.missing(df.limit(0), ["series"], "episode").count() == gaps.duplicates(df.limit(0), ["series"], "episode").count() == 0


def test_gaps_take_one_shuffle_behind_the_counts(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5)], "season string, episode long")
    plan = gaps.missing(df, ["season"], "episode")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "collect_" not in plan and "sequence" not in plan
    assert [tuple(r) for r in gaps.missing(df, ["season"], "episode", first=0).collect()] == [("a", False, 0, 0, 1), ("a", False, 2, 4, 3)]


SCHEMA = "path string, checksum string, mtime double"


def test_moved_files(spark):
    saved = [("kept", "k", 1.0), ("a/1", "x", 1.0), ("a/2", "x", 1.0), ("a/3", "x", 1.0), ("old", "y", 1.0), ("old", "y", 2.0), ("gone", "z", 1.0), ("bare", None, 1.0), (None, "x", 1.0)]
    walked = [("kept", "k", 1.0), ("b/9", "x", 1.0), ("b/10", "x", 1.0), ("new", "y", 1.0), ("fresh", "w", 1.0), ("bare2", None, 1.0), (None, "z", 1.0)]
    found = rescan.moved(spark.createDataFrame(saved, SCHEMA), spark.createDataFrame(walked, SCHEMA))
    assert sorted(map(tuple, found.collect())) == [("a/1", "b/10", "x"), ("a/2", "b/9", "x"), ("old", "new", "y")]
    assert rescan.moved(spark.createDataFrame([], SCHEMA), spark.createDataFrame(walked, SCHEMA)).count() == 0


def test_many_copies_are_paired_once(spark):
    old = spark.range(3000).selectExpr("concat('a/', id) AS path", "if(id < 2900, 'same', cast(id AS string)) AS checksum", "1D AS mtime").repartition(7)
    new = spark.range(2500).selectExpr("concat('b/', id) AS path", "if(id < 2450, 'same', cast(id AS string)) AS checksum", "1D AS mtime").repartition(5)
    found = rescan.moved(old, new).collect()
    assert len(found) == len({r.old_path for r in found}) == len({r.path for r in found}) == 2450
    want = zip(sorted(f"a/{i}" for i in range(2900)), sorted(f"b/{i}" for i in range(2450)), strict=False)
    assert {(r.old_path, r.path) for r in found} == set(want)


def test_repeated_and_null_paths(spark):
    """A path that a snapshot repeats doesn't multiply rows; rows without a path are no entries."""
    saved = spark.createDataFrame([("a", "1", 1.0), ("a", "2", 3.0), ("a", None, None), ("d", "4", 1.0), ("d", "4", 1.0), (None, "n", 1.0), (None, "n", 1.0)], SCHEMA)
    walked = spark.createDataFrame([("a", "2", 4.0), ("b", "5", 1.0), (None, "n", 1.0)], SCHEMA)
    assert sorted((r.path, r.old_checksum, r.old_mtime) for r in rescan.matched(saved, walked).collect()) == [("a", "2", 3.0), ("b", None, None)]
    assert [(r.path, r.checksum) for r in rescan.deleted(saved, walked).collect()] == [("d", "4")]
    assert [r.path for r in rescan.inserted(saved, walked).collect()] == ["b"]
    assert sorted((r.path, r.origin) for r in rescan.merged(saved, walked).collect()) == [("a", "kept"), ("b", "new")]
