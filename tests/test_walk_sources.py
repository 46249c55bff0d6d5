import json
import os
import uuid

import pytest

from babelshelf.sources import listing, probe, registered, snapshot

EPISODES = "collection string, series string, season long, episode long, language string, status string"


@pytest.fixture
def library(tmp_path):
    for folder in ("Show (2001)/Staffel 01", "Show (2001)/empty", ".hidden/deep", "skip/inner", "Other"):
        (tmp_path / "lib" / folder).mkdir(parents=True)
    for name in ("Show (2001)/Staffel 01/a.mp4", "Show (2001)/Staffel 01/b.txt", ".hidden/deep/x.mp4", "skip/inner/y.mp4", "top.mkv", "Show (2001)/Staffel 01/weird name ü%20.mp4"):
        (tmp_path / "lib" / name).write_bytes(b"x")
    return tmp_path


def test_ignored_folders_are_never_opened(spark, library):
    opened = f"{library}/opened"
    os.mkdir(opened)
    take = listing.folder_entries

    def noting(folder):
        with open(f"{opened}/{uuid.uuid4()}", "w") as f:
            f.write(folder)
        if folder.endswith("Other"):
            raise PermissionError("closed")
        return take(folder)

    found = {r.path: r for r in listing.walked(spark, f"{library}/lib", ["mp4", "mkv"], ("skip",), entries=noting).collect()}
    assert sorted(open(f"{opened}/{f}").read().removeprefix(f"{library}/lib") for f in os.listdir(opened)) == ["", "/Other", "/Show (2001)", "/Show (2001)/Staffel 01", "/Show (2001)/empty"]
    assert {p: r.ignored for p, r in found.items()} == {
        "Show (2001)": False, "Show (2001)/Staffel 01": False, "Show (2001)/empty": False, ".hidden": True, "skip": True, "Other": False, "top.mkv": False,
        "Show (2001)/Staffel 01/a.mp4": False, "Show (2001)/Staffel 01/b.txt": True, "Show (2001)/Staffel 01/weird name ü%20.mp4": False,
    }
    assert {p for p, r in found.items() if r.kind == "folder"} == {"Show (2001)", "Show (2001)/Staffel 01", "Show (2001)/empty", ".hidden", "skip", "Other"}
    assert found["Other"].error == "closed" and found["top.mkv"].length == 1 and found["Show (2001)/Staffel 01/a.mp4"].depth == 3


def test_counts_of_folders(spark, library):
    rows = listing.folder_counts(listing.walked(spark, f"{library}/lib", ["mp4"], ("skip",)))
    assert {tuple(r) for r in rows.collect()} == {("", 5, 2, 3), ("Show (2001)", 2, 2, 0), ("Show (2001)/Staffel 01", 3, 2, 1), ("Show (2001)/empty", 0, 0, 0), ("Other", 0, 0, 0)}


def test_no_root_and_depth(spark, library):
    (row,) = listing.walked(spark, f"{library}/none").collect()
    assert row.path == "" and row.error and row.kind == "folder"
    assert max(r.depth for r in listing.walked(spark, f"{library}/lib", max_depth=2).collect()) == 2
    assert listing.walked(spark, f"{library}/lib/Show (2001)/empty").count() == 0


def test_snapshot_source_skips_partitions(spark, tmp_path):
    registered.register(spark)
    rows = [("c", f"s/{k}=ä", k, e, "de", "ok" if e else "missing") for k in range(6) for e in range(2)]
    episodes = spark.createDataFrame(rows, EPISODES)
    snapshot.write_parts(snapshot.nest(episodes), f"{tmp_path}/parts")
    snapshot.write(snapshot.nest(episodes).coalesce(1), f"{tmp_path}/whole")
    read = spark.read.format("library_snapshot").option("files", 1).load(f"{tmp_path}/parts")
    assert sorted(map(tuple, read.collect())) == sorted(rows) and read.rdd.getNumPartitions() == 6
    for condition, n in (("series = 's/3=ä'", 1), ("season IN (1, 4, 77)", 2), ("season = 2 AND series = 's/3=ä'", 1), ("season <=> 5", 1), ("episode = 1", 6), ("season = 1 OR season = 2", 6), ("collection LIKE 'x%'", 1)):
        some = read.where(condition)
        assert some.rdd.getNumPartitions() == n, condition
        assert sorted(map(tuple, some.collect())) == sorted(map(tuple, episodes.where(condition).collect()))
    whole = spark.read.format("library_snapshot").load(f"{tmp_path}/whole").where("season = 3")
    assert sorted(map(tuple, whole.collect())) == [r for r in rows if r[2] == 3]


def probe_file(folder, name, runtime):
    path = f"{folder}/{name}.json"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path + ".part", "w") as f:
        f.write(json.dumps({"streams": [{"codec_type": "audio", "codec_name": "mp3", "duration": str(runtime)}], "format": {}}, indent=2) if runtime else "")
    os.rename(path + ".part", path)


def test_probe_source_and_stream(spark, tmp_path):
    registered.register(spark)
    folder, out, checkpoint = (f"{tmp_path}/{x}" for x in ("probes", "out", "checkpoint"))
    for k in range(5):
        probe_file(folder, f"a/{k}.mp3", k)
    read = spark.read.format("probe_results").option("files", 1).load(folder)
    found = {r.path: (r.runtime, r.status) for r in probe.status(read.withColumn("probe", probe.parsed(read.raw))).collect()}
    assert found == {"a/0.mp3": (None, None)} | {f"a/{k}.mp3": (float(k), "audio") for k in range(1, 5)}
    assert read.where("path = 'a/3.mp3'").rdd.getNumPartitions() == 1 and read.where("path LIKE 'a/%'").count() == 5 and read.where("error = 'no output'").count() == 1

    def arrive():
        stream = spark.readStream.format("probe_results").load(folder)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.path for r in spark.read.parquet(out).collect())

    assert arrive() == [f"a/{k}.mp3" for k in range(5)]
    probe_file(folder, "b/9.mp3", 9)
    assert arrive() == [*(f"a/{k}.mp3" for k in range(5)), "b/9.mp3"] == arrive()
