"""Media probing: an external prober's JSON, and what it says of a file."""

from __future__ import annotations

import json
import shutil
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from babelshelf.functions import numeric

#: Fixed value: what callers are told of a path without a file.
NO_FILE = "File doesn't exist"
SCHEMA = "streams array<struct<codec_type:string,codec_name:string,duration:string>>, format struct<duration:string>"


def available(command: str = "ffprobe") -> bool:
    return shutil.which(command) is not None


def probe_file(path: str, command: str = "ffprobe") -> tuple[str | None, str | None]:
    """(JSON, None) or (None, error)."""
    if not Path(path).exists():
        return None, NO_FILE
    done = subprocess.run([command, "-v", "error", "-show_streams", "-show_format", "-of", "json", path], capture_output=True, text=True)
    if done.returncode:
        return None, done.stderr.strip()
    json.loads(done.stdout)
    return done.stdout, None


def probed(files: DataFrame, command: str = "ffprobe") -> DataFrame:
    """(path, raw, error) of rows (path): one process per file, on the executors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [probe_file(p, command) for p in part["path"]]
            yield pd.DataFrame({"path": part["path"], "raw": [r for r, _ in found], "error": [e for _, e in found]})

    return files.select("path").mapInPandas(run, "path string, raw string, error string")


def parsed(raw: Column) -> Column:
    return F.from_json(raw, SCHEMA)


def status(rows: DataFrame) -> DataFrame:
    """Adds status (video, audio or wav), runtime in seconds and error to rows with a ``probe``."""
    streams = F.coalesce(F.col("probe.streams"), F.array().cast("array<struct<codec_type:string,codec_name:string,duration:string>>"))
    of = lambda kind: F.filter(streams, lambda s: s.codec_type == kind)
    found = rows.withColumns({"__video": of("video"), "__audio": of("audio")})
    n_video, n_audio = F.size("__video"), F.size("__audio")
    main = F.when(n_video > 0, F.get("__video", F.lit(0))).otherwise(F.get("__audio", F.lit(0)))
    runtime = F.coalesce(numeric.parse_float(main["duration"]), numeric.parse_float(F.col("probe.format.duration")))
    error = (
        F.when((n_video == 0) & (n_audio == 0), "neither video nor audio").when(n_video > 1, "more than one video stream").when(runtime.isNull(), "no duration")
        .when((n_video == 1) & (n_audio == 0), "video without audio").when(n_audio > 1, "more than one audio stream")
    )
    kind = F.when(n_video == 1, "video").when(F.get("__audio", F.lit(0))["codec_name"] == "pcm_s16le", "wav").otherwise("audio")
    judged = found.withColumn("error", error)
    ok = F.col("error").isNull()
    return judged.withColumns({"status": F.when(ok, kind), "runtime": F.when(ok, runtime)}).drop("__video", "__audio")
