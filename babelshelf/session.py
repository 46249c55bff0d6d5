"""Spark session settings shared by the command line, the benchmark and the tests."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "babelshelf", **conf: str) -> SparkSession:
    """A session with UTC, ANSI and adaptive execution; ``conf`` wins over the defaults."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if master is None or master.startswith("local"):
        settings |= {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.driver.host": "127.0.0.1"}
    builder = SparkSession.builder.appName(app).master(master or f"local[{cpus}]")
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
