"""Views of the star-schema tables as a media library, in Spark and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds of a segment, and the hours of events that stand for one, by file.
LENGTH = 300
HOURS = (16, 24, 48, 72)

PREDICTIONS = "predictions AS (SELECT user_id AS file_id, CAST(datediff('hour', TIMESTAMP '2024-01-01', ts) // CASE user_id % 4 WHEN 0 THEN 16 WHEN 1 THEN 24 WHEN 2 THEN 48 ELSE 72 END AS INTEGER) AS segment, event_type AS language, value / 500 AS p, event_id AS ord FROM events)"
MEDIA = PREDICTIONS + ", media AS (SELECT file_id, (max(segment) + 1) * 300 - 1 - file_id % 299 AS runtime FROM predictions GROUP BY file_id)"
HIERARCHY = """hierarchy AS (SELECT r_name AS collection, n_name AS series, c_custkey AS season, o_orderkey AS episode, o_orderpriority AS language,
  CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'missing' ELSE 'skipped' END AS status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
FILES = "files AS (SELECT doc_id, source, lang, source || '/' || doc_id || '.' || lang AS path, sha256(text) AS checksum, CAST(n_chars AS DOUBLE) AS mtime FROM documents)"
SNAPSHOTS = (
    FILES
    + """, snapshot AS (SELECT doc_id, path, checksum, mtime FROM files WHERE doc_id % 10 <> 0),
walked AS (SELECT f.doc_id, path, CASE WHEN f.doc_id % 6 = 0 THEN sha256(text || 'x') ELSE checksum END AS checksum, mtime + CASE WHEN f.doc_id % 3 = 0 THEN 1 ELSE 0 END AS mtime
  FROM files f JOIN documents d ON f.doc_id = d.doc_id WHERE f.doc_id % 10 <> 1)"""
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def select_from(spark: SparkSession, sf_dir: str, sql: str, source: str) -> DataFrame:
    """Rows of a query that both engines understand, over one table; no view stays behind."""
    text = sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {source}", f"FROM {{{source}}}")
    return spark.sql(text, **{source: table(spark, sf_dir, source)})


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, segment, language, p, ord): a user is a file, some hours a segment, an event type a language."""
    hours = F.timestamp_diff("HOUR", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    each = F.element_at(F.array(*map(F.lit, HOURS)), (F.col("user_id") % len(HOURS) + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file_id"), F.floor(hours / each).cast("int").alias("segment"), F.col("event_type").alias("language"), (F.col("value") / 500).alias("p"), F.col("event_id").alias("ord")
    )


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, runtime): each file ends within its last segment; segments without events have failed."""
    runtime = (F.max("segment") + 1) * LENGTH - 1 - F.col("file_id") % 299
    return predictions(spark, sf_dir).groupBy("file_id").agg(runtime.alias("runtime"))


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(collection, series, season, episode, language, status), one row per order as an episode."""
    orders, customer, nation, region = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation", "region"))
    folders = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "missing").otherwise("skipped")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(folders, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("r_name").alias("collection"), F.col("n_name").alias("series"), F.col("c_custkey").alias("season"), F.col("o_orderkey").alias("episode"), F.col("o_orderpriority").alias("language"), status.alias("status"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, path, checksum, mtime), a document as a file in its source's folder."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "lang", F.concat("source", F.lit("/"), "doc_id", F.lit("."), "lang").alias("path"), F.sha2("text", 256).alias("checksum"), F.col("n_chars").cast("double").alias("mtime"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(saved, walked): files of the last run and of this one, with new, deleted, touched and changed ones."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "doc_id", F.lit("."), "lang").alias("path")
    saved = docs.where("doc_id % 10 <> 0").select("doc_id", path, F.sha2("text", 256).alias("checksum"), F.col("n_chars").cast("double").alias("mtime"))
    text = F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    mtime = F.col("n_chars").cast("double") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)
    walked = docs.where("doc_id % 10 <> 1").select("doc_id", path, F.sha2(text, 256).alias("checksum"), mtime.alias("mtime"))
    return saved, walked
