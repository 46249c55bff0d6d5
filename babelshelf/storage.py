"""The shared folder in which tables are kept between the steps of a job."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode, where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if master not in _own_dirs:
        _own_dirs[master] = tempfile.mkdtemp(prefix="babelshelf-")
        atexit.register(shutil.rmtree, _own_dirs[master], ignore_errors=True)
    return f"file://{_own_dirs[master]}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below one folder for each application."""
    return f"{shared_dir(spark)}/babelshelf/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it again.

    Later reads neither repeat the work nor depend on an executor that may be lost.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def drop_cut(df: DataFrame) -> None:
    """Deletes a table made by ``cut`` which no later plan reads."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        delete(df.sparkSession, folder)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application wrote into the shared folder; call it when results are written."""
    delete(spark, f"{shared_dir(spark)}/babelshelf/{spark.sparkContext.applicationId}")
