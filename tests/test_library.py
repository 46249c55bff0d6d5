import hashlib
import json
import os
from pathlib import Path

import pytest

from babelshelf.__main__ import main
from babelshelf.sources import library

TIME = 1_700_000_000


def put(root, name, text, time=TIME):
    file = Path(root) / name
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(text)
    os.utime(file, (time, time))


def listed(spark, path):
    return {r.path: (r.checksum, r.mtime, r.length, r.folder) for r in library.saved(spark, path).collect()}


def found(root):
    files = (f for f in Path(root).rglob("*.mp4") if not any(p.startswith(".") or p == "skip" for p in f.relative_to(root).parts))
    return {str(f.relative_to(root)): (hashlib.sha256(f.read_bytes()).hexdigest(), f.stat().st_mtime, f.stat().st_size, str(f.parent.relative_to(root))) for f in files}


def parts(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def refresh(spark, root, path):
    return library.refresh(spark, root, path, ["mp4"], ("skip",))


@pytest.fixture
def shelf(spark, tmp_path):
    root, path = f"{tmp_path}/lib", f"{tmp_path}/listing"
    for name in ("top.mp4", "a=1/one.mp4", "a=1/two.mp4", "a=1/ü b/three.mp4", "same/s.mp4", "gone/x.mp4", "gone/y.mp4", "skip/no.mp4", ".h/no.mp4", "same/no.txt"):
        put(root, name, f"text of {name}")
    counts = refresh(spark, root, path)
    assert counts == {"new": 7, "deleted": 0, "moved": 0, "changed": 0, "touched": 0, "kept": 0, "hashed": 7} and listed(spark, path) == found(root)
    return root, path


def test_nothing_changes(spark, shelf):
    root, path = shelf
    before = parts(path)
    assert refresh(spark, root, path) == {"new": 0, "deleted": 0, "moved": 0, "changed": 0, "touched": 0, "kept": 7, "hashed": 0}
    assert parts(path) == before


def test_changes_are_told_and_only_their_folders_written(spark, shelf):
    root, path = shelf
    before = parts(path)
    put(root, "a=1/one.mp4", "another text", TIME + 5)
    put(root, "top.mp4", "text of top.mp4", TIME + 5)
    put(root, "new/n.mp4", "new")
    os.makedirs(f"{root}/to")
    os.rename(f"{root}/gone/x.mp4", f"{root}/to/x.mp4")
    os.remove(f"{root}/gone/y.mp4")
    assert refresh(spark, root, path) == {"new": 1, "deleted": 1, "moved": 1, "changed": 1, "touched": 1, "kept": 3, "hashed": 4}
    assert listed(spark, path) == found(root)
    after = parts(path)
    assert {f: t for f, t in after.items() if "same" in f or "%20" in f or "ü" in f} == {f: t for f, t in before.items() if "same" in f or "%20" in f or "ü" in f} and not any("gone" in f for f in after)
    assert refresh(spark, root, path)["kept"] == 7 and parts(path) == after


def test_closed_folders_and_no_root(spark, shelf, monkeypatch):
    root, path = shelf
    before = listed(spark, path)
    take = library.listing.walked

    def closed(folder):
        if folder.endswith("/a=1"):
            raise PermissionError("closed")
        return library.listing.folder_entries(folder)

    monkeypatch.setattr(library.listing, "walked", lambda *x: take(*x, entries=closed))
    assert refresh(spark, root, path) == {"new": 0, "deleted": 0, "moved": 0, "changed": 0, "touched": 0, "kept": 7, "hashed": 0}
    assert listed(spark, path) == before
    with pytest.raises(OSError, match="no folder"):
        refresh(spark, f"{root}/none", path)


def test_command_line(spark, shelf, capsys):
    root, path = shelf
    assert main(["rescan", root, path, "--format", "mp4", "--ignore", "skip"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["kept"] == 7
