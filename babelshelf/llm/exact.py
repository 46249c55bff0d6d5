"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to one row per digest before any join, so
a group of copies never meets in one task. The sort-merge anti-join with the index needs no shuffle of the index; it is
written as a left join, since rows that do match want the id kept before. Rows without a match are appended. Spark sorts
the buckets anew for each batch, as each append adds a file to them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from babelshelf.llm.common import BLANKS, carried, cut, drop_cut, restored, shared_path

INDEX_SCHEMA = "digest binary, keep_id bigint, group_size bigint, batch string"


def normalised(text: Column) -> Column:
    """The text without blanks; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def digests(docs: DataFrame, keep: Sequence[str | Column] = ()) -> DataFrame:
    """(doc_id, digest, n_points, *keep): SHA-256 of the normalised text and the original's code points."""
    return docs.select(
        "doc_id", F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("digest"), F.length(F.coalesce("text", F.lit(""))).alias("n_points"), *keep
    )


def survivors(rows: DataFrame, tie: str = "doc_id") -> DataFrame:
    """(digest, keep_id, group_size, keep_tie): of each digest, most code points, then smallest doc_id (null last), then ``tie``."""
    first = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", F.col(tie).alias("tie"))).alias("first")
    return rows.groupBy("digest").agg(first, F.count("*").alias("group_size")).select("digest", F.col("first.doc_id").alias("keep_id"), "group_size", F.col("first.tie").alias("keep_tie"))


class DigestIndex:
    """Known digests as a table of the session's catalogue, bucketed and sorted by digest, kept under ``path``.

    Opening a name again, also in a later session with the same ``path``, finds what was appended before.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 64):
        self.spark, self.name = spark, name
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({INDEX_SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
        )
        self.path, self.buckets = path, int(buckets)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def judged(self, first: DataFrame, batch: str) -> DataFrame:
        """``first`` (one row per digest) with ``known``, and ``old_id`` where an earlier batch has the digest."""
        old = self.table().select("digest", F.col("keep_id").alias("old_id"), F.col("batch").alias("old_batch"))
        found = first.join(old.hint("merge"), "digest", "left")
        return found.withColumn("known", F.col("old_batch").isNotNull() & (F.col("old_batch") != batch))

    def append(self, new: DataFrame, batch: str) -> None:
        """Adds digests that the index lacks; one writer at a time."""
        rows = new.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch")).repartition(self.buckets, "digest")
        rows.write.mode("append").format("parquet").option("path", self.path).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def drop(self, files: bool = False) -> None:
        """Forgets the table's name, and deletes its files if asked to."""
        held = self.table()
        if files:
            drop_cut(held)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


_OWN = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, *keep) for each row of a batch, and its new digests are appended.

    Rows are equal when their texts are after deleting blanks; null and empty texts are equal. Of a group that is
    new to the index, the row with most code points, then the smallest doc_id (null last) is kept; if two rows
    tie in both, one of them. A digest of an earlier batch keeps that batch's ``keep_id``, and none of the new
    rows. ``group_size`` counts the rows of this batch. An empty table gives an empty result. A kept column named like
    the result's gets ``_in`` added; other columns are ignored.

    ``batch`` names the batch: one that is run again, after a failure at any point or because its result was lost, does
    not count as its own past and has the same result. Without a name each call is a batch of its own.
    """
    rows = cut(digests(docs, carried(keep)).withColumn("__row", F.monotonically_increasing_id()), "digests")
    found = judge(rows, index, batch)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"), *restored(_OWN, keep))


def judge(rows: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """``rows`` of ``digests`` with a unique ``__row``, which have been cut: adds keep_id, group_size and kept."""
    batch = batch or uuid.uuid4().hex
    first = cut(survivors(rows, "__row"), "survivors")
    state = cut(index.judged(first, batch), "states")
    index.append(state.where("old_batch IS NULL"), batch)
    drop_cut(first)
    own = state.select("digest", "group_size", F.when(F.col("known"), F.col("old_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.when(~F.col("known"), F.col("keep_tie")).alias("__kept"))
    return rows.join(own, "digest").withColumn("kept", F.col("__row").eqNullSafe(F.col("__kept"))).drop("__kept")


def fresh_index(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    """An empty index in the shared folder, for this application; give ``DigestIndex`` a path of its own for one that stays."""
    name = f"digest_index_{uuid.uuid4().hex}"
    return DigestIndex(spark, name, shared_path(spark, name), buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))


def op4_digest_index(spark, sf_dir: str) -> DataFrame:
    """All documents as the first batch of a new index, which is dropped once they are judged."""
    index = fresh_index(spark)
    found = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"), index)
    index.drop(files=True)
    return found


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w AS place
  FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM g
"""
