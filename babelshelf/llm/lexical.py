"""Ranked lexical search by TPUT (three-phase uniform threshold) over term-partitioned postings.

One pass over the documents keeps the postings of the items' terms. They are range-partitioned by term and falling
impact, so that a list lies in order over as many partitions as its length asks for, and a common term's list is not
one task's. Then

1. each list gives its head; the best of an item's head documents are scored exactly, and their k-th score is a lower
   bound ``tau`` of the item's k-th best;
2. a threshold, the same for all lists of an item, is set so that what lists hold below it adds up to less than ``SHARE``
   of ``tau``; each list sends its entries from there on, once for all items, to the partition of their document, where
   they are added up. A document whose sum and whose bound for the entries not sent stay below the k-th sum is out;
3. exact scores of the others are looked up in the lists.

Nothing is approximate: a document that no list sends has less than ``tau``, of which the k documents of phase 1 have at
least as much. Work grows with the documents and with the items' terms; no list, document or item meets in one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from babelshelf.llm.common import cut
from babelshelf.llm.tokens import blocks

TOP = 10
#: Entries in the head of each list, and head documents of each item that are scored exactly.
HEAD = 40
LOOKUPS = 50
#: Share of the lower bound that may hide below the thresholds. More leaves more in the lists and prunes less.
SHARE = 0.5
#: Tables of up to so many rows (of about 40 bytes) are broadcast, larger ones shuffled; the items' vocabulary, too.
BROADCAST_ROWS = 500_000
#: Bytes of a text whose terms are listed at once.
PART_BYTES = 1 << 20
#: ASCII letters and digits and all bytes of other characters stay, A-Z in lower case; the rest parts terms.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in their order."""
    return text.translate(_TERM_BYTES).split()


def counted(text: bytes, part: int = PART_BYTES) -> tuple[Counter, int]:
    """How often each term occurs, and the number of all; a long text is taken apart between terms, part by part."""
    plain, counts, total, at = text.translate(_TERM_BYTES), Counter(), 0, 0
    while at < len(plain):
        end = plain.find(b" ", at + part)
        words = plain[at : end if end >= 0 else len(plain)].split()
        counts.update(words)
        total += len(words)
        at = end if end >= 0 else len(plain)
    return counts, total


def words_of(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, word) for each different word of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            found = [sorted(set(terms_of(x))) for x in texts.cast(pa.large_binary()).to_pylist()]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
            yield pa.RecordBatch.from_arrays([ids, pa.array([w.decode() for x in found for w in x], pa.string())], names=["item_id", "word"])

    slim = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([slim.schema["item_id"], T.StructField("word", T.StringType())])
    return slim.mapInArrow(run, schema).distinct()


def bounded(df: DataFrame) -> DataFrame:
    """``df``, which must be cheap to count, with a hint to broadcast it while it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, row, doc_id, tf, n) of the words in ``vocabulary`` (term, word), n being the terms of the document.

    Each block of documents also gives a row of term -1, with the number of its documents that have terms as ``tf``,
    and all their terms as ``n``. A vocabulary too large to be broadcast is joined.
    """
    few = vocabulary.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    known = docs.sparkSession.sparkContext.broadcast({r.word.encode(): r.term for r in vocabulary.toLocalIterator()} if few else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for batch, texts in blocks(batches):
            names, tf, entries, lengths = [], [], [], []
            for text in texts.cast(pa.large_binary()).to_pylist():
                counts, total = counted(text)
                kept = [w for w in counts if w in table] if few else list(counts)
                names += [table[w] for w in kept] if few else [w.decode() for w in kept]
                tf += [counts[w] for w in kept]
                entries.append(len(kept))
                lengths.append(total)
            n, at = np.array(lengths), pa.array(np.append(np.repeat(np.arange(len(entries)), entries), 0))
            columns = [pa.array([*names, -1 if few else None], pa.int64() if few else pa.string()), batch.column(0).take(at), batch.column(1).take(at), pa.array([*tf, int((n > 0).sum())], pa.int64()), pa.array(np.append(np.repeat(n, entries), n.sum()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "row", "doc_id", "tf", "n"])

    slim = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    schema = T.StructType([T.StructField("term", T.LongType() if few else T.StringType()), *slim.schema.fields[:2], T.StructField("tf", T.LongType()), T.StructField("n", T.LongType())])
    found = cut(slim.mapInArrow(run, schema), "postings")
    if few:
        return found
    rest = found.where("term IS NULL").withColumn("term", F.lit(-1).cast("long"))
    return cut(found.withColumnRenamed("term", "word").join(vocabulary, "word").select("term", "row", "doc_id", "tf", "n").unionByName(rest), "postings")


def lists_of(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lists (term, impact, row, doc_id), by term and falling impact, and (term, w) of the terms whose weight is above 0.

    A posting's score is its impact times the weight of its term.
    """
    total = found.where("term < 0").agg(F.coalesce(F.sum("tf"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs, n_terms = total[0], max(total[1], 1)
    entries = found.where("term >= 0")
    m = f"(10L + (90L * n * {n_docs}L) div {n_terms}L)"
    impacts = entries.select("term", F.expr(f"(1000000000L * tf) div (1000L * tf + 8L * {m})").alias("impact"), "row", "doc_id")
    order = (F.col("term"), F.col("impact").desc(), F.col("row"))
    lists = cut(impacts.repartitionByRange(*order).sortWithinPartitions(*order), "lists")
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2.0) / (F.lit(2.0) * F.col("df") + F.lit(1.0))))
    return lists, entries.groupBy("term").agg(F.count("*").alias("df")).select("term", weight.alias("w")).where("w > 0")


def best(rows: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each group with their ``rank``; partitions send on their own first ``n`` only."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def scored(pairs: DataFrame, lists: DataFrame, weighed: DataFrame) -> DataFrame:
    """(item, row, doc_id, score) of ``pairs`` (item, row), looked up in the lists of the item's terms."""
    near = lists.join(bounded(pairs.select("row").distinct()), "row", "left_semi")
    keys = pairs.join(bounded(weighed), "item").select("item", "row", "term", "w")
    return near.join(keys, ["row", "term"]).groupBy("item", "row").agg(F.min("doc_id").alias("doc_id"), F.sum(F.col("w") * F.col("impact")).alias("score"))


def lower_bounds(lists: DataFrame, weighed: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """(item, tau): the ``top``-th score of an item among its best head documents, without a row if these are fewer.

    Also (term, most), the greatest impact of each list.
    """
    heads = cut(best(lists.drop("doc_id"), "term", HEAD, F.col("impact").desc(), F.col("row")), "heads")
    sums = heads.join(weighed, "term").groupBy("item", "row").agg(F.sum(F.col("w") * F.col("impact")).alias("part"))
    first = cut(best(sums, "item", max(LOOKUPS, top), F.col("part").desc(), F.col("row")).select("item", "row"), "first")
    known = best(scored(first, lists, weighed), "item", top, F.col("score").desc(), F.col("row"))
    return known.where(F.col("rank") == top).select("item", F.col("score").alias("tau")), heads.where("rank = 1").select("term", F.col("impact").alias("most"))


def thresholds(weighed: DataFrame, taus: DataFrame, most: DataFrame) -> DataFrame:
    """(item, term, w, tau, cap): entries above ``cap`` are sent; the caps of an item add up to less than its share.

    The cap is the same for all lists of an item but for those that end below it. It is the level up to which the lists,
    sorted by their greatest entry, can be filled: with the share less what the lists before hold, dealt to the rest.
    """
    rows = weighed.join(most, "term").join(taus, "item", "left").withColumn("tau", F.coalesce("tau", F.lit(0).cast("long"))).withColumn("top", F.col("w") * F.col("most"))
    before = "OVER (PARTITION BY item ORDER BY top, term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    room = F.expr(f"greatest(cast(ceil({SHARE}D * tau) AS long) - 1L, 0L)")
    level = F.expr(f"(room - coalesce(sum(top) {before}, 0L)) div (count(*) OVER (PARTITION BY item) - count(*) {before})")
    levels = rows.withColumn("room", room).withColumn("level", level)
    filled = levels.withColumn("level", F.expr("max(CASE WHEN level <= top THEN level END) OVER (PARTITION BY item)"))
    return filled.select("item", "term", "w", "tau", F.least("level", "top").alias("cap"))


def contenders(lists: DataFrame, limits: DataFrame, top: int) -> DataFrame:
    """(item, row) of the documents that may be among an item's first ``top``."""
    needed = limits.groupBy("term").agg(F.min(F.expr("cap div w + 1L")).alias("least"))
    sent = lists.join(bounded(needed), "term").where("impact >= least").select("row", "term", "impact").repartition("row")
    value = F.col("w") * F.col("impact")
    sums = sent.join(bounded(limits), "term").where(value > F.col("cap")).groupBy("row", "item").agg(F.sum(value).alias("seen"), F.sum(value - F.col("cap")).alias("gain"))
    items = limits.groupBy("item").agg(F.sum("cap").alias("hidden"), F.first("tau").alias("tau"))
    open_ = cut(sums.join(bounded(items), "item").withColumn("bound", F.col("hidden") + F.col("gain")).where("bound >= tau").select("item", "row", "seen", "bound"), "bounds")
    kth = best(open_, "item", top, F.col("seen").desc(), F.col("row")).where(F.col("rank") == top).select("item", F.col("seen").alias("kth"))
    return open_.join(bounded(cut(kth, "kth")), "item", "left").where("kth IS NULL OR bound >= kth").select("item", "row")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents with the highest scores above 0.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII; A-Z is lower-cased; an item's terms count
    once each. Equal scores come by ascending doc_id, null ids last, repeated rows one by one. Null texts have no terms.
    Rows of ``items`` with the same id, null or not, are one item with the terms of all. An empty table on either side
    gives an empty result. Other columns are ignored.
    """
    words = cut(words_of(items, item_id, text), "words")
    vocabulary = cut(words.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "vocabulary")
    names = cut(words.select("item_id").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    lists, weights = lists_of(postings(docs, vocabulary))
    asked = words.join(vocabulary, "word").alias("a").join(names.alias("n"), F.col("a.item_id").eqNullSafe(F.col("n.item_id"))).select("item", "term")
    weighed = cut(asked.join(weights, "term"), "weighed")
    taus, most = lower_bounds(lists, weighed, top)
    limits = cut(thresholds(weighed, taus, most), "limits")
    exact = scored(cut(contenders(lists, limits, top), "contenders"), lists, weighed)
    ranked = best(exact, "item", top, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row"))
    return ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_tput_search(spark, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*) AS big_n, sum(len(t))::BIGINT AS big_l FROM d WHERE len(t) > 0),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
e AS (SELECT item_id, r, doc_id, sum(CAST(floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score
FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY item_id, r, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r)::INTEGER AS rank, doc_id, score FROM e WHERE score > 0) WHERE rank <= 10
"""
