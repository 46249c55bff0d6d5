"""A corpus pipeline: quality, exact duplicates, near duplicates, mixing and packing.

Each stage reads all that the one before wrote. All but the last return the columns of ``documents`` and ignore others.
Rows are told apart by file and place, so that repeated rows and null ids are rows like any other; null texts are empty;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from babelshelf.llm.common import DOCUMENT_COLUMNS, cut, identified, keep_rows
from babelshelf.llm.exact import digests, fresh_index, judge
from babelshelf.llm.mixing import mix
from babelshelf.llm.packing import pack_documents
from babelshelf.llm.quality import classify
from babelshelf.llm.similar import near_copies


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*DOCUMENT_COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps. Null sources and languages are sites of their own; without labels all stay."""
    rows = identified(docs)
    scored = classify(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=("__row",))
    return _documents(keep_rows(rows, scored.where("kept")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal texts, the longest, then the one with the smallest doc_id (null last), then by place."""
    rows, index = identified(docs), fresh_index(spark)
    found = judge(cut(digests(rows, keep=("__row",)), "digests"), index)
    index.drop(files=True)
    return _documents(keep_rows(rows, found.where("kept")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with a shingle similarity of 0.8 or more, the document with the smallest doc_id (null last, then by place)."""
    rows = identified(docs)
    found = near_copies(rows)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("first")
    return _documents(keep_rows(rows, found.groupBy("__label").agg(first).select(F.col("first.__row").alias("__row"))))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 2 times; documents without words may go or stay. A null source is one of its own."""
    rows = identified(docs, "__id")
    taken = mix(rows, keep=("__id",)).where("copies > 0").select("__id", "copies")
    repeated = rows.join(taken.hint("shuffle_hash"), "__id").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return _documents(repeated)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of 1024; a document without text is its end id."""
    return pack_documents(_documents(docs))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each cut before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
