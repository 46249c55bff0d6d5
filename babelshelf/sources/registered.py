"""Snapshots and probe results as data sources of their own: ``spark.read.format("library_snapshot")`` and the like.

    register(spark)
    spark.read.format("library_snapshot").load(folder).where("series = 'x'")
    spark.readStream.format("probe_results").load(folder)

Each partition is a few files of a folder on a store that pyarrow opens; the driver sees their names only. Filters on what
the names of folders and files tell drop files before there is a partition for them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, StringStartsWith

from babelshelf.sources.listing import _store
from babelshelf.sources.snapshot import SEASON

#: Files of a partition, unless the option ``files`` says otherwise.
FILES = 16


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def listed(folder: str) -> list[tuple[int, str]]:
    """(time, path) of the ``.json`` files below a folder, in order; hidden ones and what lies in hidden folders are left out."""
    from pyarrow import fs

    store, inner = _store(folder)
    found = store.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=False))
    base = len(inner.rstrip("/")) + 1
    return sorted((x.mtime_ns or 0, x.path) for x in found if x.type == fs.FileType.File and x.path.endswith(".json") and not any(p[0] in "._" for p in x.path[base:].split("/")))


def lines_of(folder: str, path: str) -> Iterator[str]:
    store, _ = _store(folder)
    with store.open_input_stream(path) as source:
        yield from (line for line in source.read().decode().split("\n") if line.strip())


def dealt(paths: list[str], options: dict) -> list[Files]:
    n = int(options.get("files", FILES))
    return [Files(paths[k : k + n]) for k in range(0, len(paths), n)] or [Files([])]


def allows(filters: list[Filter], known: dict[str, str | None]) -> bool:
    """Whether what a path tells of some columns, as texts, satisfies the filters on these."""
    for x in filters:
        name = x.attribute[0] if len(x.attribute) == 1 else None
        if name not in known:
            continue
        value = known[name]
        if isinstance(x, (EqualTo, EqualNullSafe)):
            ok = value == (None if x.value is None else str(x.value))
        elif isinstance(x, In):
            ok = value in {str(v) for v in x.value if v is not None}
        else:
            ok = value is not None and value.startswith(x.value)
        if not ok:
            return False
    return True


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.folder, self.filters = options, options["path"], []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Notes those that paths can be judged by. Spark still applies all of them to the rows."""
        self.filters = [x for x in filters if isinstance(x, (EqualTo, EqualNullSafe, In, StringStartsWith))]
        return filters

    def known(self, path: str) -> dict[str, str | None]:
        raise NotImplementedError

    def partitions(self) -> Sequence[InputPartition]:
        return dealt([path for _, path in listed(self.folder) if allows(self.filters, self.known(path))], self.options)


class SnapshotReader(_Reader):
    """Episodes of the documents of ``snapshot.write_parts``, or of a folder of documents without parts."""

    def known(self, path: str) -> dict[str, str | None]:
        pairs = (part.split("=", 1) for part in path.split("/")[:-1] if "=" in part)
        return {k: None if v == "__HIVE_DEFAULT_PARTITION__" else unquote(v) for k, v in pairs if k in SEASON}

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            rows, named = [], self.known(path)
            for line in lines_of(self.folder, path):
                document = named | json.loads(line)
                season = document.get("season")
                for e in document.get("episodes") or []:
                    rows.append((document.get("collection"), document.get("series"), None if season is None else int(season), e.get("episode"), e.get("language"), "ok" if e.get("metadata") else "missing"))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _EPISODE_TYPES, strict=True)], names=_EPISODE_NAMES)


_EPISODE_NAMES = ["collection", "series", "season", "episode", "language", "status"]
_EPISODE_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


class SnapshotSource(DataSource):
    """(collection, series, season, episode, language, status): an episode's metadata is there ("ok") or missing."""

    @classmethod
    def name(cls) -> str:
        return "library_snapshot"

    def schema(self) -> str:
        return "collection string, series string, season long, episode long, language string, status string"

    def reader(self, schema) -> DataSourceReader:
        return SnapshotReader(dict(self.options))


def _probes(folder: str, paths: list[str]) -> Iterator[pa.RecordBatch]:
    """What each file holds, as it is; a file that holds nothing is an error."""
    base = len(_store(folder)[1].rstrip("/")) + 1
    for path in paths:
        raw = "\n".join(lines_of(folder, path))
        yield pa.RecordBatch.from_arrays([pa.array([path[base:].removesuffix(".json")]), pa.array([raw or None], pa.string()), pa.array([None if raw else "no output"], pa.string())], names=["path", "raw", "error"])


class ProbeReader(_Reader):
    def known(self, path: str) -> dict[str, str | None]:
        return {"path": path[len(_store(self.folder)[1].rstrip("/")) + 1 :].removesuffix(".json")}

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _probes(self.folder, partition.paths)


class ProbeStream(DataSourceStreamReader):
    """Probe results as they arrive. An offset is the time and name of the last file; one that comes later with an
    earlier time is not seen, so files must be moved in when they are whole."""

    def __init__(self, options: dict):
        self.options, self.folder = options, options["path"]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        found = listed(self.folder)
        return dict(zip(("time", "path"), found[-1], strict=True)) if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        first, last = ((x["time"], x["path"]) for x in (start, end))
        return dealt([path for time, path in listed(self.folder) if first < (time, path) <= last], self.options)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _probes(self.folder, partition.paths)

    def commit(self, end: dict) -> None:
        pass


class ProbeSource(DataSource):
    """(path, raw, error): the prober's output of each media file, from ``<path>.json`` below the folder."""

    @classmethod
    def name(cls) -> str:
        return "probe_results"

    def schema(self) -> str:
        return "path string, raw string, error string"

    def reader(self, schema) -> DataSourceReader:
        return ProbeReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return ProbeStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session, and lets it push filters down to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (SnapshotSource, ProbeSource):
        spark.dataSource.register(source)
