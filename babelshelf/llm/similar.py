"""Near copies by the similarity of word shingles: operator 2's index and count filtering over longer fingerprints.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more. At that similarity
the sign bits of a SimHash differ in 10 of 64 places on average and in up to 20, so that no byte need be equal and no
index over its bytes finds all pairs. So the fingerprint has ``BANDS`` x ``ROWS`` bytes, each of a minimum hash over
the set: a byte of two texts is equal with a chance equal to their similarity. The index has a list for the values of
``ROWS`` positional bytes at once. As in operator 2 the number of lists in which a pair meets is tallied, pairs that
reach ``LEAST_LISTS`` are retained, of these the ones that share ``LEAST_BYTES`` of all positional bytes, and they are
verified on the whole sets. A pair at 0.8 meets in fewer lists with a chance of 1 in 16 million, and has fewer shared bytes
with one of 1 in 34 million; a more similar pair is missed far less often. Only lists of up to ``LONG_LIST`` texts are
tallied: a pair that loses meetings by that is in a long list, where it is found without the tally.

Of a list with more than ``LONG_LIST`` texts the pairs are not written out. Texts are taken out of it that have so many
shingles of their own that no other text of a long list can be similar enough. The rest are compared with the one of
them that has the fewest shingles of its own, which links most of a group of copies. What then still has another label
in some list meets at its rarest shingles (``rare_first``): a fifth of them in one text and a ninth in the other hold one
that both share, if they are similar enough. Texts that have a template in common, and each as much of its own as makes
them differ, thus never meet; the pairs that do are tallied and verified like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from babelshelf.llm.common import cut
from babelshelf.llm.components import components

WIDTH = 5
#: The least similarity, as a fraction of whole numbers.
LEAST = (4, 5)
BANDS, ROWS = 50, 5
#: Lists, of 50, in which all but 1 in 16 million pairs at 0.8 meet.
LEAST_LISTS = 2
#: Shared bytes, of 250, that all but 1 in 34 million pairs at 0.8 have.
LEAST_BYTES = 164
LONG_LIST = 32
#: So many nodes, of 282 bytes each, are sent to all tasks, at most; more of them are shuffled like the texts they meet.
BROADCAST_ROWS = 50_000
#: Shingles hashed, and minima taken over, at once.
BLOCK, MIN_BLOCK = 1 << 16, 1 << 10
_dice = np.random.default_rng(42)
_FLIP = _dice.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)[:, None]
_FACTOR = (_dice.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]


def shingles_of(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; words as in ``fingerprint_of``."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, "<i8")
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    n, found = len(words) - width + 1, []
    for at in range(0, n, BLOCK):
        part = words[at : min(at + BLOCK, n) + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False))
        found.append(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(0)), dtype="<u8", count=len(part) - width + 1))
    return np.unique(np.concatenate(found).view("<i8"))


def sketch_of(hashes: np.ndarray) -> bytes | None:
    """The fingerprint of a set: a byte of each of its minimum hashes; an empty set has none."""
    if not len(hashes):
        return None
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    short = (hashes.view("<u8") >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), MIN_BLOCK):
        np.minimum(least, ((short[at : at + MIN_BLOCK] ^ _FLIP) * _FACTOR).min(axis=1), out=least)
    return (least * np.uint32(2_654_435_761) >> np.uint32(24)).astype(np.uint8).tobytes()


def _matrix(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(-1, BANDS * ROWS)


def keys_of(sketches: np.ndarray) -> np.ndarray:
    """(texts, BANDS): the keys of the lists, five positional bytes below the band's number."""
    wide = np.zeros((len(sketches), BANDS, 8), dtype=np.uint8)
    wide[:, :, :ROWS] = sketches.reshape(-1, BANDS, ROWS)
    wide[:, :, ROWS] = np.arange(BANDS)
    return wide.view("<i8")[:, :, 0]


def _arrays(values: list) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.asarray(x, dtype="<i8") for x in values])))


def _over_texts(docs: DataFrame, columns: tuple[str, ...], schema: str, width: int, make) -> DataFrame:
    """``columns`` and what ``make`` returns for the shingle sets of the texts."""
    rest = docs.select(*columns, "text")
    fields = [x for x in rest.schema.fields if x.name != "text"]
    whole = T.StructType([*fields, *T.StructType.fromDDL(schema).fields])
    names = whole.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                sets = [shingles_of(x, width) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *make(sets)], names=names)

    return rest.mapInArrow(run, whole)


def sketched(docs: DataFrame, row: str, width: int = WIDTH) -> DataFrame:
    """(doc_id, row, node, sketch): ``node`` is a hash of the set, the same for equal sets."""

    def make(sets: list[np.ndarray]) -> list[pa.Array]:
        nodes = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], dtype="<u8").view("<i8")
        return [pa.array(nodes), pa.array([sketch_of(x) for x in sets], pa.binary())]

    return _over_texts(docs, ("doc_id", row), "node long, sketch binary", width, make)


def shingled(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(node, sketch, hashes): the sets of ``docs`` (node, sketch, text)."""
    return _over_texts(docs, ("node", "sketch"), "hashes array<long>", width, lambda sets: [_arrays(sets)])


def postings(nodes: DataFrame) -> DataFrame:
    """(node, key): the ``BANDS`` index entries of each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                node, sketch = batch.slice(a, 2000).columns
                keys = keys_of(_matrix(sketch.to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node.to_numpy(), BANDS)), pa.array(keys.ravel())], names=["node", "key"])

    return nodes.where("sketch IS NOT NULL").select("node", "sketch").mapInArrow(run, "node long, key long")


@F.pandas_udf(T.IntegerType())
def shared_bytes(a: pd.Series, b: pd.Series) -> pd.Series:
    """Number of positional bytes in which fingerprints agree."""
    return pd.Series((_matrix(list(a)) == _matrix(list(b))).sum(axis=1), dtype="int32")


def met_often(met: DataFrame, least_lists: int = LEAST_LISTS) -> DataFrame:
    """(a, b): the pairs that meet in ``least_lists`` or more of the lists (key, node)."""
    one, other = met.withColumnRenamed("node", "a"), met.withColumnRenamed("node", "b")
    return one.join(other, "key").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least_lists).select("a", "b")


def tallied(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with their number of shared bytes ``n``."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b")
    return both.select("a", "b", shared_bytes("x", "y").alias("n"))


def verified(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    over, under = least
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    # shared / (x + y - shared) >= over / under; the smaller set is at least that share of the larger.
    close = F.least(F.size("x"), F.size("y")) * under >= F.greatest(F.size("x"), F.size("y")) * over
    shared = F.when(close, F.size(F.array_intersect("x", "y"))).otherwise(0)
    return both.where(close & (shared * (over + under) >= (F.size("x") + F.size("y")) * over)).select("a", "b")


def own_shingles(sets: DataFrame) -> DataFrame:
    """(node, own, size): how many of a set's shingles are in no other set of ``sets``."""
    once = sets.select("node", F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("n"), F.first("node").alias("node")).where("n = 1")
    return sets.select("node", F.size("hashes").alias("size")).join(once.groupBy("node").agg(F.count("*").alias("own")), "node", "left").select("node", F.coalesce("own", F.lit(0)).alias("own"), "size")


def rare_first(members: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(hash, node, label, size, place, early): the rarest shingles of each node of ``members`` (node, label).

    Shingles are ordered by the number of nodes that have them, then by hash; ``place`` is that in the node's order, from 0. Two
    sets that are similar enough share a shingle among the first (under - over) / under of each, and it is ``early``,
    among the first (under - over) / (under + over), in one of them at least: behind the first one that they share,
    too few are left otherwise. Shingles that no other node has are counted but left out.
    """
    over, under = least
    own = sets.join(members, "node").select("node", "label", F.size("hashes").alias("size"), F.explode("hashes").alias("hash"))
    often = own.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    ranked = own.join(often, "hash", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    order = Window.partitionBy("node").orderBy("n", "hash")
    placed = ranked.withColumn("place", F.row_number().over(order) - 1).where((F.col("n") > 1) & (F.col("place") * under <= F.col("size") * (under - over)))
    return placed.select("hash", "node", "label", "size", "place", (F.col("place") * (under + over) <= F.col("size") * (under - over)).alias("early"))


def apart(members: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(a, b): pairs of ``members`` (node, label) with different labels that may be similar enough.

    They meet at rare shingles. Each early one looks for labels that the same shingle has with enough left behind it, judged by
    the label's best and smallest texts, then for the texts of these, so that texts which are connected already don't
    meet. No pair is left out that is similar enough; that texts share what is common to many of them makes no row.
    """
    over, under = least
    posted = cut(rare_first(members, sets, least), "rare")
    one = posted.where("early").select("hash", F.col("label").alias("la"), F.col("node").alias("x"), F.col("size").alias("nx"), (F.col("size") - F.col("place")).alias("left_x"))
    other = posted.select("hash", F.col("label").alias("lb"), F.col("node").alias("y"), F.col("size").alias("ny"), (F.col("size") - F.col("place")).alias("left_y"))
    labels = other.groupBy("hash", "lb").agg(F.max("left_y").alias("most_left"), F.min("ny").alias("least_size"), F.max("ny").alias("most_size"))

    def enough(left_y: str, low: str, high: str) -> Column:
        """Behind the first shingle that they share, and with it, enough is left in both, and their sizes are alike."""
        shared = F.least("left_x", left_y) * (under + over) >= (F.col("nx") + F.col(low)) * over
        return shared & (F.col("nx") * under >= F.col(low) * over) & (F.col("nx") * over <= F.col(high) * under)

    met = one.join(labels, "hash").where((F.col("la") != F.col("lb")) & enough("most_left", "least_size", "most_size")).select("hash", "lb", "x", "nx", "left_x")
    return met.join(other, ["hash", "lb"]).where(enough("left_y", "ny", "ny")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def links(docs: DataFrame, nodes: DataFrame, row: str, width: int = WIDTH, least: tuple[int, int] = LEAST, long_list: int = LONG_LIST, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(a, b): verified links that connect all ``nodes`` (node, row, sketch) that are similar enough.

    Only the texts of pairs that the tally retains, and those of long lists, are shingled again and their sets kept.
    """
    over, under = least
    posted = postings(nodes)
    lists = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(posted.join(lists, "key"), "lists")
    short, long = met.where(F.col("n") <= long_list).select("key", "node"), met.where(F.col("n") > long_list).select("key", "node")
    retained = cut(tallied(met_often(short), nodes).where(F.col("n") >= least_bytes).select("a", "b"), "retained")
    wanted = retained.select(F.col("a").alias("node")).unionAll(retained.select("b")).unionAll(long.select("node")).distinct()
    chosen = cut(nodes.select("node", row, "sketch").join(wanted, "node", "left_semi"), "chosen")
    # A node, its row and its fingerprint are of fixed size.
    small = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen.hint("shuffle_hash")
    sets = cut(shingled(docs.select(row, "text").join(small, row).select("node", "sketch", "text"), width), "sets")
    if long.isEmpty():
        return cut(verified(retained, sets, least), "similar")
    own = own_shingles(sets.join(long.select("node").distinct(), "node", "left_semi")).where(F.col("own") * under <= F.col("size") * (under - over))
    long = cut(long.join(own.select("node", (F.col("own") / F.col("size")).alias("share")), "node"), "long-lists")
    leads = long.groupBy("key").agg(F.min(F.struct("share", "node")).alias("lead")).select("key", F.col("lead.node").alias("lead"))
    stars = long.join(leads, "key").where("node != lead").select(*_ordered("node", "lead")).distinct()
    near_lead = tallied(stars, sets).where(F.col("n") >= least_bytes).select("a", "b")
    found = cut(verified(retained.unionAll(near_lead).distinct(), sets, least), "similar")
    marked = long.select("key", "node").join(components(found), "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed = marked.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    members = cut(marked.join(mixed.select("key"), "key", "left_semi").select("node", "label").distinct(), "mixed-lists")
    if members.isEmpty():
        return found
    rest = tallied(cut(apart(members, sets, least), "apart"), nodes).where(F.col("n") >= least_bytes).select("a", "b")
    return found.unionAll(cut(verified(rest, sets, least), "similar"))


def near_copies(docs: DataFrame, row: str = "__row", width: int = WIDTH, least: tuple[int, int] = LEAST, long_list: int = LONG_LIST) -> DataFrame:
    """(doc_id, row, __label) for every row of ``docs`` (see ``identified``); ``__label`` is never null.

    Rows of a component share their label. Texts without words, null ones too, are equal to each other; repeated rows
    and null ids count like any other, an empty table gives an empty result, other columns are ignored.
    """
    rows = cut(sketched(docs, row, width), "sketches")
    nodes = cut(rows.groupBy("node").agg(F.min(row).alias(row), F.first("sketch").alias("sketch")), "nodes")
    named = components(links(docs, nodes, row, width, least, long_list))
    return rows.select("doc_id", row, "node").join(named, "node", "left").select("doc_id", row, F.coalesce("label", "node").alias("__label"))
