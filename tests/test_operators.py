import hashlib
import json
import random
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from babelshelf.functions import names
from babelshelf.operators import devices, nesting, options, ordering, prediction, quota, rescan, retries
from babelshelf.operators.prediction import Thresholds
from babelshelf.sources import connectors, listing, probe, snapshot
from babelshelf.streaming import ingest

SCHEMA = "file_id long, segment int, language string, p double, ord long"


def decide(spark, rows, n, t, picks=None):
    df = spark.createDataFrame(rows, SCHEMA)
    picked = spark.createDataFrame(picks, "file_id long, picked string") if picks else None
    scan = prediction.segments(spark.createDataFrame([(1, 100 * n - 1)], "file_id long, runtime int"), F.lit(100))
    return prediction.decided(prediction.stopping_point(prediction.prefix_best(df, scan), t), t, picked).first()


def test_segments(spark):
    files = spark.createDataFrame([(1, 60), (2, 70)], "file_id long, runtime int")
    rows = prediction.segments(files, F.lit(30)).orderBy("file_id", "segment").collect()
    assert [(r.start_s, r.end_s, round(r.scanned, 4)) for r in rows] == [(0, 30, 0.5), (30, 60, 1.0), (60, None, 1.0), (0, 30, 0.4286), (30, 60, 0.8571), (60, None, 1.0)]


def test_stops_early_when_sure(spark):
    rows = [(1, s, lang, p, k) for s in range(10) for k, (lang, p) in enumerate((("de", 0.97), ("en", 0.03)))]
    r = decide(spark, rows, 10, Thresholds())
    assert (r.segment, r.language, r.outcome) == (3, "de", "success")


def test_default_language_blocks_early_stop(spark):
    rows = [(1, s, "Unknown", 0.97, 0) for s in range(10)]
    r = decide(spark, rows, 10, Thresholds())
    assert (r.segment, r.outcome) == (9, "success")


def test_failures(spark):
    rows = [(1, s, "de", 0.5, 0) for s in range(10)]
    assert decide(spark, rows, 10, Thresholds(use_picker=False)).outcome == "final_threshold_failed"
    assert decide(spark, rows, 10, Thresholds()).outcome == "pick_failed"
    picked = decide(spark, rows, 10, Thresholds(), [(1, "fr")])
    assert (picked.outcome, picked.language, picked.accuracy) == ("success", "fr", 1.0)
    assert decide(spark, rows, 10, Thresholds(minimum=0.5, maximum=0.2)).outcome == "no_best_available"
    assert decide(spark, rows, 10, Thresholds(maximum=0.5, final=0.4)).segment == 4


def test_tie_keeps_the_label_seen_first(spark):
    rows = [(1, 0, "b", 0.5, 0), (1, 0, "a", 0.5, 1)]
    assert prediction.ranked(spark.createDataFrame(rows, SCHEMA)).where("place = 1").first().language == "b"


def test_quota(spark):
    rows = spark.createDataFrame([("m", i, i % 3 != 0) for i in range(12)], "kind string, pos int, good boolean")
    found = quota.within_quota(rows, "kind", ["pos"], 2, 3, F.col("good")).orderBy("pos").collect()
    assert [r.pos for r in found] == [4, 5, 7] and [r.position for r in found] == [2, 3, 4]


def test_listing(spark, tmp_path):
    (tmp_path / "Show (2001)" / "Staffel 01").mkdir(parents=True)
    (tmp_path / "Show (2001)" / "Staffel 01" / "a.mp4").write_bytes(b"abc")
    r = listing.files(spark, str(tmp_path), checksums=True).first()
    assert r.path == "Show (2001)/Staffel 01/a.mp4" and r.length == 3 and r.checksum == hashlib.sha256(b"abc").hexdigest()
    assert "content" not in listing.files(spark, str(tmp_path)).columns


def test_probe_missing_file(spark):
    r = probe.probed(spark.createDataFrame([("/no/such/file",)], "path string")).first()
    assert (r.raw, r.error) == (None, "File doesn't exist")


def test_inference_halves_on_memory_errors(spark):
    def load():
        def model(audio):
            if len(audio) > 1 or audio[0] == b"bad":
                raise MemoryError
            return [[0.9, 0.1] for _ in audio]

        return model

    segs = spark.createDataFrame([(1, 0, b"x"), (1, 1, b"bad"), (2, 0, b"y")], "file_id long, segment int, audio binary")
    rows = connectors.inferred(segs, load, ["de", "en"]).collect()
    assert sorted((r.file_id, r.segment, r.language, r.p) for r in rows) == [(1, 0, "de", 0.9), (1, 0, "en", 0.1), (2, 0, "de", 0.9), (2, 0, "en", 0.1)]


def test_lookup_asks_once_per_key(spark):
    keys = spark.createDataFrame([("a",), ("a",), ("b",)], "name string")
    found = connectors.looked_up(keys, lambda: lambda key: {"hit": 1} if key["name"] == "a" else None, "name string, hit int").collect()
    assert [tuple(r) for r in found] == [("a", 1)]


def test_streaming_counts(spark, tmp_path):
    pd.DataFrame({"file_id": [1, 1], "segment": pd.Series([0, 1], dtype="int32"), "language": ["de", "de"], "p": [0.5, 0.7], "ord": [0, 0], "scored_at": pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:01"]).astype("datetime64[us]")}).to_parquet(tmp_path / "a.parquet")
    q = ingest.language_counts(ingest.arriving(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.language, r.n, round(r["mean"], 6)) for r in spark.table("counts").collect()] == [("de", 2, 0.6)]


def test_quota_with_ties_and_nulls(spark):
    rows = spark.createDataFrame([("m", 1, "a"), ("m", 1, "b"), ("m", None, "c"), (None, 1, "d"), (None, 2, "e"), ("m", 2, None)], "kind string, pos int, name string")
    found = quota.within_quota(rows, "kind", ["pos"], 0, 3, F.lit(True)).collect()
    assert sorted((r.kind or "", r.position) for r in found) == [("", 0), ("", 1), ("m", 0), ("m", 1), ("m", 2)]
    assert {r.name for r in found if r.kind == "m"} == {"a", "b", "c"} and [r.name for r in found if r.kind is None and r.position == 0] == ["d"]
    assert quota.within_quota(rows, "kind", ["pos"], 1, 1, F.col("name") != "a", ["m"]).first().pos == 1


def test_numbered_rows(spark):
    """Ranges of several partitions, a group that lies in many, ties and nulls."""
    rows = [("a", i % 50) for i in range(900)] + [("b", None), ("b", 3), (None, 5), (None, 4), (None, 4)]
    df = spark.createDataFrame(rows, "folder string, pos int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = defaultdict(list)
        for r in ordering.numbered(df, ["folder"], ["pos"]).collect():
            got[r.folder].append((r.position, -1 if r.pos is None else r.pos))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for folder, found in got.items():
        found.sort()
        assert [p for p, _ in found] == list(range(len(found))) and [x for _, x in found] == sorted(-1 if x is None else x for f, x in rows if f == folder)
    assert sum(map(len, got.values())) == len(rows) and ordering.numbered(df.limit(0), ["folder"], ["pos"]).count() == 0


def test_early_stop_forms_agree(spark):
    """Scores of all segments with windows, and segment by segment with a model, over files of odd lengths and failures."""
    dice = random.Random(6)
    labels, length = ["Unknown", "de", "en", "fr"], 30
    files, scores = [], {}
    for f in range(60):
        runtime = dice.choice([dice.randrange(1, 1500), 30 * dice.randrange(1, 40), 29, 30])
        files.append((f, runtime))
        for s in range(runtime // length + 1):
            if dice.random() > 0.02:
                ps = [dice.random() ** 2 + (0.6 if k == f % 4 else 0) for k in range(4)]
                scores[f, s] = [p / sum(ps) for p in ps]
    # Predictions beyond a file's end are not its own.
    rows = [(f, s, labels[k], p, k) for (f, s), ps in scores.items() for k, p in enumerate(ps)] + [(f, 2000, "de", 1.0, 0) for f in range(60)]
    df, media = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(files, "file_id long, runtime int")
    for t in (Thresholds(normal=0.5, final=0.45, minimum=0.2), Thresholds(normal=0.45, final=0.4, minimum=0.1, maximum=0.5, use_picker=False)):
        best = prediction.prefix_best(df, prediction.segments(media, F.lit(length)))
        want = {r.file_id: r for r in prediction.decided(prediction.stopping_point(best, t), t).collect()}

        def asked(file, segment, start, end):
            return (file["file_id"], segment)

        def load(device):
            return lambda key: [(label, p) for label, p in zip(labels, scores[key], strict=True)] if key in scores else []

        got = {r.file_id: r for r in prediction.decided(connectors.classified(media, asked, load, length, t), t).collect()}
        assert set(got) == set(want) == set(range(60))
        for f, r in want.items():
            assert (got[f].segment, got[f].language, got[f].outcome) == (r.segment, r.language, r.outcome) and abs(got[f].scanned - r.scanned) < 1e-12
            assert got[f].accuracy == r.accuracy or abs(got[f].accuracy - r.accuracy) < 2e-9
        outcomes = Counter(r.outcome for r in want.values())
        assert {"success", "no_best_available"} <= set(outcomes) and len({r.segment for r in want.values()}) > 8 and max(r.segment for r in want.values()) > 10


def test_last_segment_beyond_thirty(spark):
    rows = [(1, s, "de", 0.3, 0) for s in range(41)] + [(2, s, "en", 0.9, 0) for s in (0, 1, 3)]
    scan = prediction.segments(spark.createDataFrame([(1, 1210), (2, 100), (3, 50)], "file_id long, runtime int"), F.lit(30))
    found = {r.file_id: r for r in prediction.decided(prediction.stopping_point(prediction.prefix_best(spark.createDataFrame(rows, SCHEMA), scan), Thresholds(use_picker=False)), Thresholds(use_picker=False)).collect()}
    assert (found[1].segment, found[1].outcome, found[1].scanned) == (40, "final_threshold_failed", 1.0)
    # A segment without a prediction fails its file unless scanning stops before it; so does the lack of any.
    assert (found[2].segment, found[2].outcome, found[2].language) == (2, "no_best_available", None) and (found[3].segment, found[3].outcome) == (0, "no_best_available")


def test_tries_fall_back_and_give_up():
    asked = []

    def load(device):
        def model(sound):
            asked.append(device)
            if sound == "never" or sound == "late" and device == "gpu":
                raise MemoryError
            return [("de", 1.0)]

        return model

    model = connectors.Tries(load, 100.0)
    assert model.once("fine") == [("de", 1.0)] and asked == ["gpu"]
    while model.once("late") is None:
        pass
    assert asked[1:] == ["gpu"] * 6 + ["cpu"] and model.errors == 0 and model.length == pytest.approx(100 * 0.925**6)
    while not model.exhausted:
        assert model.once("never") is None
    assert len(asked) == 8 + 11 and model.length == pytest.approx(100 * 0.925**16)
    model.rested()
    assert not model.exhausted and model.errors == 0


def test_retry_log(spark):
    rows = [("a", i, i in (3, 9)) for i in range(10)] + [("b", i, False) for i in range(13)] + [("b", 13, True), ("b", 14, None)]
    found = {(r.key, r.ord): r for r in retries.tracked(spark.createDataFrame(rows, "key string, ord int, ok boolean"), "key", "ord", "ok").collect()}
    assert [found["a", i].retries for i in range(10)] == [1, 2, 3, 0, 1, 2, 3, 4, 5, 0] and [found["a", i].device for i in (7, 8, 9)] == ["gpu", "cpu", "gpu"]
    assert [found["b", i].failed for i in (9, 10, 12, 13, 14)] == [False, True, True, True, True] and found["b", 12].scale == found["b", 9].scale and found["b", 14].retries == 1


def test_file_lists(spark, tmp_path):
    """Lists nest deeper than any limit, name each other, folders, missing files and themselves."""
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    for name in ("one.mp4", "sub/two.mp4", "sub/deep/three.mp4", "end.mp4"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "sub" / "more.txt").write_text("deep\r\n../one.mp4\n")
    for i in range(23):
        (tmp_path / f"l{i}.txt").write_text(f"l{i + 1}.txt\nl0.txt\nnone.mp4\n\n" if i < 22 else f"{tmp_path}/end.mp4\nsub")
    found = {r.path.replace("/sub/../", "/") for r in listing.file_list(spark, [f"{tmp_path}/l0.txt", f"{tmp_path}/one.mp4"]).collect()}
    assert found == {f"{tmp_path}/{x}" for x in ("one.mp4", "sub/two.mp4", "sub/deep/three.mp4", "end.mp4")}
    assert listing.file_list(spark, []).count() == 0


def test_expanded_without_limit(spark):
    entries = [(f"l{i}", f"l{i + 1}") for i in range(26)] + [("l26", "end.mp4"), ("l9", "l0"), ("other", "x.mp4")]
    found = options.expanded(spark.createDataFrame(entries, "parent string, child string"), spark.createDataFrame([("l0",), ("alone.mp4",), (None,)], "path string"))
    assert sorted(r.path for r in found.collect()) == ["alone.mp4", "end.mp4"]


def test_checksums_block_by_block(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"abc" * 5000)
    rows = spark.createDataFrame([(str(tmp_path / "a"),), (str(tmp_path),), (str(tmp_path / "none"),), (None,)], "path string")
    found = {r.path: (r.checksum, r.error) for r in listing.hashed(rows, block=4096).collect()}
    assert found == {str(tmp_path / "a"): (hashlib.sha256(b"abc" * 5000).hexdigest(), None), str(tmp_path): (None, "a folder has no checksum"), str(tmp_path / "none"): (None, "no such file")}
    saved = spark.createDataFrame([(str(tmp_path / "a"), "old"), ("gone", "kept")], "path string, checksum string")
    checked = spark.createDataFrame([(str(tmp_path / "a"), "new")], "path string, checksum string")
    assert sorted(r.checksum for r in rescan.refreshed(saved, checked).collect()) == ["kept", "new"]


def test_snapshots(spark, tmp_path):
    schema = "collection string, series string, season long, episode long, language string, status string"
    rows = [("c", "s", 1, 2, "de", "ok"), ("c", "s", 1, 3, "ü", "skipped"), (None, "s", 1, 1, None, "missing")]
    nested = snapshot.nest(spark.createDataFrame(rows, schema))
    first, second = snapshot.roundtrip(nested), snapshot.roundtrip(nested.limit(0))
    # A second round trip leaves the first alone; skipped metadata comes back as missing.
    assert second.count() == 0 and sorted(map(tuple, snapshot.flatten(first).collect()), key=repr) == sorted([rows[0], (*rows[1][:5], "missing"), rows[2]], key=repr)
    (tmp_path / "whole.json").write_text(json.dumps([{"collection": "c", "series": "s", "season": 1, "episodes": [{"episode": 1, "language": "de", "metadata": {"provider": "tmdb", "data": {"metadata_type": "episode", "episode_number": 1}}}]}], indent=4))
    assert [tuple(r) for r in snapshot.flatten(snapshot.read(spark, str(tmp_path / "whole.json"))).collect()] == [("c", "s", 1, 1, "de", "ok")]
    for path in ("x.yml", "x.txt"):
        with pytest.raises(ValueError):
            snapshot.read(spark, str(tmp_path / path))
        with pytest.raises(ValueError):
            snapshot.write(nested, str(tmp_path / path))


def test_admitted_drops_or_raises(spark):
    entries = spark.createDataFrame([("Show (2001)", "folder"), ("Show (2001)/trailer.mp4", "file"), ("Show (2001)/odd", "folder")], "path string, kind string")
    found = nesting.classify(entries, [], ["trailer"])
    assert [tuple(r) for r in nesting.admitted(found).collect()] == [("Show (2001)", "series")]
    with pytest.raises(Exception, match="can't parse Show .2001./odd: unparsable_name"):
        nesting.admitted(found, strict=True).collect()
    assert nesting.admitted(found.where("path NOT LIKE '%odd'"), strict=True).count() == 1


def test_other_naming_scheme(spark):
    own = names.Parser(season=lambda name, specials: F.regexp_extract(name, "^odd(.*)$", 1).isNotNull().cast("int"))
    entries = spark.createDataFrame([("Show (2001)/odd", "folder")], "path string, kind string")
    assert nesting.classify(entries, [], [], own).first().entity == "season"


def test_unique_match_is_asserted(spark):
    owned = spark.createDataFrame([("u1",), ("u2",)], "uuid string")
    runtime = spark.createDataFrame([("u1", 0), ("u2", 1), ("u2", 2)], "uuid string, index int")
    assert devices.matched(owned.where("uuid = 'u1'"), runtime, ["uuid"], unique=True).first()["index"] == 0
    for uuid in ("u2", "u3"):
        with pytest.raises(Exception, match="runtime devices for"):
            devices.matched(spark.createDataFrame([(uuid,)], "uuid string"), runtime, ["uuid"], unique=True).collect()


def test_devices_without_an_id_all_stay(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "unique_id string, ord int")
    assert sorted(r.ord for r in devices.deduplicated(rows).collect()) == [1, 3, 4]


def test_aliases_and_layers(spark):
    aliases = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "normal"), ("l", "m"), ("m", "l"), ("s", "s"), ("g", "none"), ("fast", "loop")], "alias string, target string")
    known = spark.createDataFrame([("normal",), ("fast",)], "name string")
    found = options.resolved(spark.createDataFrame([(x,) for x in "a b fast l s g h".split()], "name string"), aliases, known)
    assert {r.name: (r.target, r.error) for r in found.collect()} == {"a": ("normal", None), "b": ("normal", None), "fast": ("fast", None), "l": (None, "cycle"), "s": (None, "cycle"), "g": (None, "unknown"), "h": (None, "unknown")}
    schema = "owner int, key string, value string"
    layers = spark.createDataFrame([(1, "x", "1"), (1, "y", None), (2, "x", "2")], schema), spark.createDataFrame([(1, "x", None), (2, "x", "3"), (2, "z", "4")], schema)
    assert {(r.owner, r.key): r.value for r in options.layered(*layers).collect()} == {(1, "x"): "1", (1, "y"): None, (2, "x"): "3", (2, "z"): "4"}
