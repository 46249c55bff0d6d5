"""Near-duplicate detection over 64-bit SimHash fingerprints.

Candidates come from an inverted index over byte positions with count filtering. Two fingerprints that differ in at
most two bits share at least six of their eight bytes at the same positions. A posting list for each single byte would
hold 1/256 of all fingerprints and its pairs would grow with the square of the input, so the index has a list for the
values of four positional bytes at once, at the 14 fours of positions of which any three positions lie in exactly one
(the Steiner system S(3, 4, 8)). Two fingerprints then meet in 14 - 7 k + 3 k (k - 1) / 2 - k (k - 1) (k - 2) / 6 of the
lists if k of their bytes differ, in 7, 3 and 1 for k from 1 to 3: the number of lists in which a pair meets is tallied,
pairs that reach 3, the guaranteed minimum for six shared bytes, are retained, and these are verified bit by bit.

Lists of more than ``LONG_LIST`` fingerprints take another exact way, which needs rows in proportion to the list:
within a list only the other 32 bits vary, and two members differ in at most two of these if and only if they
share a value at distance one or less from both. Each member is posted under its 33 such values; whoever meets
there is linked (at most 33 distinct fingerprints can). A pair that the tally misses because one of its lists is long
is linked in that list.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from babelshelf.llm.common import carried, cut, restored
from babelshelf.llm.components import components

SEED = 42
MAX_BITS = 2
#: Positions of the bytes that make a list's key: all fours that add up to zero as vectors of three bits.
FOURS = tuple(four for four in combinations(range(8), 4) if four[0] ^ four[1] ^ four[2] ^ four[3] == 0)
#: Lists in which two fingerprints meet at least if ``MAX_BITS`` of their bytes differ.
LEAST_LISTS = min(sum(not set(four) & set(other) for four in FOURS) for other in combinations(range(8), MAX_BITS))
#: A list of m fingerprints makes m * m / 2 pairs or 33 * m posts; from here on the posts are fewer.
LONG_LIST = 64
#: Shingles hashed at once, which bounds the memory for very long texts.
BLOCK = 1 << 16
_BITS_OF_BYTE = (np.arange(256)[:, None] >> np.arange(8)) & 1
_SLOT = np.arange(8, dtype=np.int64) * 256


def fingerprint_of(text: str | None, width: int = 3) -> int:
    """Signed 64-bit SimHash of a text's word shingles.

    A-Z is lower-cased, words are runs without ASCII blanks, repeated shingles count each time. Fewer words than
    ``width`` make one shingle, none the fingerprint zero; null is empty.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    n, counts = len(words) - width + 1, np.zeros((8, 8), dtype=np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : min(at + BLOCK, n) + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False))
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=len(part) - width + 1)
        seen = np.bincount((h.view(np.uint8).reshape(-1, 8) + _SLOT).ravel(), minlength=2048)
        counts += seen.reshape(8, 256) @ _BITS_OF_BYTE
    return int(np.packbits(2 * counts > n, axis=1, bitorder="little").reshape(8).view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series([fingerprint_of(x) for x in part], dtype="int64")


def postings(prints: DataFrame) -> DataFrame:
    """(slot, key, fp): the 14 index entries of each fingerprint, the key being its bytes at four positions."""

    def key(four: tuple[int, ...]) -> Column:
        parts = (F.shiftleft(F.shiftright("fp", 8 * k).bitwiseAND(F.lit(255)), 8 * place) for place, k in enumerate(four))
        return reduce(Column.bitwiseOR, parts)

    entries = [F.struct(F.lit(i).cast("byte").alias("slot"), key(four).alias("key")) for i, four in enumerate(FOURS)]
    return prints.select("fp", F.explode(F.array(*entries)).alias("e")).select("e.slot", "e.key", "fp")


def tallied(met: DataFrame) -> DataFrame:
    """(a, b, n): the pairs that meet in lists (slot, key, fp), and in how many."""
    one, other = met.select("slot", "key", F.col("fp").alias("a")), met.select("slot", "key", F.col("fp").alias("b"))
    return one.join(other, ["slot", "key"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def verified(tally: DataFrame) -> DataFrame:
    """(a, b): the pairs that meet often enough and differ in at most ``MAX_BITS`` bits."""
    return tally.where(F.col("n") >= LEAST_LISTS).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b")


def links(prints: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints ``fp`` at ``MAX_BITS`` or fewer bits.

    Every pair met only in short lists is there; in a long list, enough pairs to connect the same fingerprints.
    """
    posted = postings(prints)
    lists = posted.groupBy("slot", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(posted.join(lists, ["slot", "key"]), "postings")
    pairs = verified(tallied(met.where(F.col("n") <= long_list)))
    # The bits that vary in a list are those outside its key; 0 stands for the fingerprint itself.
    free = [[8 * k + i for k in range(8) if k not in four for i in range(8)] for four in FOURS]
    flips = F.array(*(F.array(F.lit(0).cast("long"), *(F.lit(int(np.uint64(1 << b).astype(np.int64))) for b in bits)) for bits in free))
    posts = met.where(F.col("n") > long_list).select("slot", "key", "fp", F.explode(F.element_at(flips, F.col("slot") + 1)).alias("flip"))
    met_there = posts.groupBy("slot", "key", F.col("fp").bitwiseXOR(F.col("flip")).alias("value")).agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    stars = met_there.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return pairs.unionAll(stars).distinct()


_OWN = ("doc_id", "fp", "component_id", "__label")


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, component_id, __label, *keep) for every row of ``docs``; ``__label`` is never null.

    ``component_id`` is the smallest doc_id that is reachable over links of ``MAX_BITS`` or fewer bits, the row's
    own included. Null doc_ids take part but never name a component (one of nulls only has a null id). Equal and
    repeated rows share their fingerprint and so their component; an empty table gives an empty result. A kept column
    named like the result's gets ``_in`` added; other columns are ignored.
    """
    rows = cut(docs.select("doc_id", fingerprint("text").alias("fp"), *carried(keep)), "fingerprints")
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    found = components(links(prints))
    named = prints.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("__label"))
    ids = named.groupBy("__label").agg(F.min("least").alias("component_id"))
    names = named.join(ids, "__label").select("fp", "component_id", "__label")
    return rows.join(names, "fp").select(*_OWN, *restored(_OWN, keep))


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
