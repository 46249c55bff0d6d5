"""Listings of library folders and file lists, and checksums, on any store that Spark or pyarrow reads."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from babelshelf.functions import names
from babelshelf.storage import cut

#: Bytes hashed at once.
BLOCK = 1 << 20


def files(spark: SparkSession, root: str, checksums: bool = False) -> DataFrame:
    """(path, kind, mtime, length[, checksum]) of all files below ``root``, paths relative to it.

    Without checksums no file is opened. With them, files must be below 2 GB, the limit of a binary column; ``hashed``
    has no limit.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    relative = F.regexp_replace(F.col("path"), rf"^.*?\Q{base}\E/", "")
    columns = [relative.alias("path"), F.lit("file").alias("kind"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), "length"]
    return listed.select(*columns, *([F.sha2("content", 256).alias("checksum")] if checksums else []))


def _store(path: str):
    """The file system of a URI or an absolute path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def folder_entries(folder: str) -> list[tuple[str, str, float | None, int | None]]:
    """(name, kind, mtime, length) of what lies in a folder itself; only names and times are read."""
    from pyarrow import fs

    store, inner = _store(folder)
    found = store.get_file_info(fs.FileSelector(inner))
    return [(x.base_name, "folder" if x.type == fs.FileType.Directory else "file", None if x.mtime_ns is None else x.mtime_ns / 1e9, x.size) for x in found]


_WALKED = "path string, kind string, depth int, mtime double, length long, error string"


def walked(spark: SparkSession, root: str, formats: list[str] | None = None, ignored: tuple[str, ...] = (), max_depth: int = 64, entries: Callable[[str], list[tuple]] = folder_entries) -> DataFrame:
    """(path, kind, depth, mtime, length, error, ignored) of the files and folders below ``root``, paths relative to it.

    Level by level, the folders found are opened in the tasks, and what they hold is written; a folder that is ignored is
    told, but never opened, and neither are those at ``max_depth``. Empty folders are there like others. A folder that
    can't be opened, the root (as ``""``) included, has an ``error``; all else goes on. ``formats`` are the extensions
    of files that aren't ignored, None for all.
    """
    base = root.rstrip("/")

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, depth in zip(part["path"], part["depth"], strict=True):
                try:
                    found = entries(f"{base}/{path}" if path else base)
                except OSError as problem:
                    rows.append((path, "folder", depth, None, None, str(problem)))
                    continue
                rows += [(f"{path}/{name}" if path else name, kind, depth + 1, mtime, length, None) for name, kind, mtime, length in found]
            yield pd.DataFrame(rows, columns=["path", "kind", "depth", "mtime", "length", "error"]).astype({"depth": "Int32", "mtime": "Float64", "length": "Int64"})

    skipped = names.is_ignored(names.base_name(F.col("path")), F.col("kind"), formats or [], list(ignored))
    if formats is None:
        skipped = F.when(F.col("kind") == "folder", skipped).otherwise(False)
    new, levels, n = spark.createDataFrame([("", 0)], "path string, depth int"), [], 1
    while n:
        spread = new.repartition(min(n, 4 * spark.sparkContext.defaultParallelism))
        levels.append(cut(spread.mapInPandas(look, _WALKED).withColumn("ignored", skipped), "walk"))
        new = levels[-1].where((F.col("kind") == "folder") & ~F.col("ignored") & F.col("error").isNull() & (F.col("depth") < max_depth)).select("path", "depth")
        n = new.count()
    rows = reduce(DataFrame.unionAll, levels)
    # A folder is told by the one above it, and again, with an error, if it can't be opened: one row for each.
    failed = rows.where("error IS NOT NULL").select("path", F.col("error").alias("__error"))
    whole = rows.where("error IS NULL").drop("error").join(failed, "path", "left").withColumnRenamed("__error", "error")
    return whole.unionByName(rows.where("error IS NOT NULL AND path = ''")).select("path", "kind", "depth", "mtime", "length", "error", "ignored")


def folder_counts(entries: DataFrame) -> DataFrame:
    """(folder, total, processing, ignored) of entries by ``walked``: zeros for empty folders; the root is ``""``."""
    parent = F.regexp_replace(F.regexp_replace("path", "[^/]*$", ""), "/$", "")
    opened = entries.where((F.col("kind") == "folder") & ~F.col("ignored") & F.col("error").isNull() & (F.col("path") != "")).select(F.col("path").alias("folder"), F.lit(None).cast("boolean").alias("skip"))
    held = entries.where("path <> ''").select(parent.alias("folder"), F.col("ignored").alias("skip"))
    return held.unionAll(opened).groupBy("folder").agg(F.count("skip").alias("total"), F.count_if(~F.col("skip")).alias("processing"), F.count_if("skip").alias("ignored"))


def hashed(rows: DataFrame, path: str = "path", block: int = BLOCK) -> DataFrame:
    """(path, checksum, error) of files of any size, read block by block in the tasks; folders and missing files are errors."""

    def one(name: str) -> tuple[str | None, str | None]:
        store, inner = _store(name)
        if (kind := store.get_file_info(inner).type.name) != "File":
            return None, "a folder has no checksum" if kind == "Directory" else "no such file"
        total = hashlib.sha256()
        with store.open_input_stream(inner) as source:
            while part := source.read(block):
                total.update(part)
        return total.hexdigest(), None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [one(x) for x in part["path"]]
            yield pd.DataFrame({"path": part["path"], "checksum": [c for c, _ in found], "error": [e for _, e in found]})

    return rows.select(F.col(path).alias("path")).where("path IS NOT NULL").mapInPandas(run, "path string, checksum string, error string")


def file_list(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path): the files that ``paths`` lead to, each once, in whatever order.

    A ``.txt`` file lists paths, one a line, absolute or from the list's own folder; a folder stands for all in it;
    what does not exist is left out. Lists may name lists to any depth, and also each other. Each round looks at the
    paths that are new, in the tasks, and writes what they lead to.
    """

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for part in parts:
            rows = []
            for name in part["path"]:
                store, inner = _store(name)
                kind = store.get_file_info(inner).type
                base = name.rsplit("/", 1)[0]
                if kind == fs.FileType.Directory:
                    rows += [(f"{name.rstrip('/')}/{x.base_name}", False) for x in store.get_file_info(fs.FileSelector(inner))]
                elif kind == fs.FileType.File and PurePosixPath(inner).suffix == ".txt":
                    with store.open_input_stream(inner) as source:
                        lines = source.read().decode().split("\n")
                    rows += [(x if x.startswith("/") or "://" in x else f"{base}/{x}", False) for x in (line.rstrip("\r") for line in lines) if x]
                elif kind == fs.FileType.File:
                    rows.append((name, True))
            yield pd.DataFrame(rows, columns=["path", "is_file"])

    new, seen, found = spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "path string"), None, None
    while True:
        reached = cut(new.mapInPandas(look, "path string, is_file boolean"), "file-lists")
        seen = new if seen is None else seen.unionAll(new)
        here = reached.where("is_file").select("path")
        found = here if found is None else found.unionAll(here)
        new = cut(reached.where("NOT is_file").select("path").distinct().join(seen, "path", "left_anti"), "file-lists")
        if new.isEmpty():
            return found.distinct()
