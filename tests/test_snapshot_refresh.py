from pathlib import Path

from babelshelf.sources import snapshot

SCHEMA = "collection string, series string, season long, episode long, language string, status string"


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("*.json")}


def episodes(spark, path):
    return sorted(tuple(r) for r in snapshot.flatten(snapshot.read(spark, path)).collect())


def rows(n_seasons=6):
    return [("c", f"s {k % 2}", k, e, "de", "ok") for k in range(n_seasons) for e in range(3)]


def test_only_changed_seasons_are_written(spark, tmp_path):
    path = f"{tmp_path}/snapshot"
    snapshot.write_parts(snapshot.nest(spark.createDataFrame(rows(), SCHEMA)), path)
    before, saved = files(path), episodes(spark, path)
    changes = [("c", "s 0", 2, 1, "en", "missing", False), ("c", "s 1", 3, 9, "fr", "ok", None), ("c", "s 1", 5, 0, None, None, True), ("c", "s 0", 4, 0, "de", "ok", False), ("d", "x/y=z", 1, 1, "it", "ok", False)]
    changes += [(None, "s 0", 1, 1, "en", "ok", False), ("c", "", 1, 1, "en", "ok", False), ("c", "s 0", 0, None, "en", "ok", False)]
    df = spark.createDataFrame(changes, SCHEMA + ", deleted boolean")
    assert snapshot.refresh(spark, path, df) == 4
    after = files(path)
    untouched = {f for f in before if not any(f"season={k}/" in f for k in (2, 3, 5))}
    assert len(untouched) == 3 and {f: after.get(f) for f in untouched} == {f: before[f] for f in untouched}
    want = set(saved) - {("c", "s 0", 2, 1, "de", "ok"), ("c", "s 1", 5, 0, "de", "ok")} | {("c", "s 0", 2, 1, "en", "missing"), ("c", "s 1", 3, 9, "fr", "ok"), ("d", "x/y=z", 1, 1, "it", "ok")}
    assert episodes(spark, path) == sorted(want)
    assert snapshot.refresh(spark, path, df) == 0 and files(path) == after


def test_folders_of_several_seasons(spark, tmp_path):
    """The other seasons of a folder that is written again stay in it; one that loses its episodes is an empty document."""
    path, by = f"{tmp_path}/snapshot", ("collection", "series")
    snapshot.write_parts(snapshot.nest(spark.createDataFrame(rows(), SCHEMA)), path, by)
    before = files(path)
    gone = spark.createDataFrame([("c", "s 0", 2, e, "de", "ok", True) for e in range(3)], SCHEMA + ", deleted boolean")
    assert snapshot.refresh(spark, path, gone, by) == 1
    assert episodes(spark, path) == sorted(r for r in rows() if r[2] != 2)
    assert snapshot.read(spark, path).where("season = 2").first().episodes == []
    assert {f: t for f, t in files(path).items() if "series=s 1" in f} == {f: t for f, t in before.items() if "series=s 1" in f}


def test_no_changes(spark, tmp_path):
    path = f"{tmp_path}/snapshot"
    snapshot.write_parts(snapshot.nest(spark.createDataFrame(rows(), SCHEMA)), path)
    before = files(path)
    assert snapshot.refresh(spark, path, spark.createDataFrame([], SCHEMA)) == 0 and files(path) == before
