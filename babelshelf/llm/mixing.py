"""Mixing sources to target weights by balanced sampling with the cube method.

Each document of a source starts with the same inclusion probability. The flight moves the probabilities of three
open documents at a time along the direction that keeps both the number of documents and the number of words
(the null space of the two constraints) until one of them is 0 or 1. It runs in chunks of bounded size. The at
most two documents that a chunk leaves open, and a few that it spares, meet those of other chunks in the next round. The
last two of a source are rounded, and up to three documents of its last chunk change sides, so that the words come
nearest to the aim while the documents stay within two of theirs (the landing).
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from babelshelf.llm.common import carried, cut, restored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Mean rows of a chunk in the first round, and chunks that meet in one of the next round (two rows from each).
CHUNK_ROWS = 2_000
FAN_IN = 50
#: Documents of a chunk that stay out of its flight for the next round, so that the last one has sizes to choose from.
SPARED = 38
#: Documents among which the landing looks for such as change sides, and for three at once.
LAND_ROWS, LAND_THREES = 300, 60
#: A chunk of more than so many times the mean is parted further; but for rows that repeat there is none.
OVERFULL = 4
EPSILON = 1e-9


def words_in(text: Column) -> Column:
    """Number of runs without ASCII blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, n, source_size, target) from rows of (source, size).

    Sources in code point order, null last, get the weights in turn. A target stops at ``most`` times its source's
    size; the excess goes to the others by weight. With sizes sorted by limit over weight, the level is found from
    sums over those before and weights of those from there on. One row per source enters the windows.
    """
    sums = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    turn = f"(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(weights)}"
    weighed = sums.withColumn("weight", F.expr(f"element_at(array({', '.join(f'{float(w)}D' for w in weights)}), cast({turn} AS int) + 1)"))
    capped = weighed.withColumn("most", F.col("source_size") * F.lit(float(most)))
    # Sums over those before only: Spark adds up what follows anew for each row.
    before = "OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    level = f"({float(share)}D * sum(source_size) OVER () - coalesce(sum(most) {before}, 0D)) / (sum(weight) OVER () - coalesce(sum(weight) {before}, 0D))"
    levels = capped.withColumn("level", F.expr(level))
    best = levels.withColumn("level", F.expr("max(CASE WHEN most / weight > level THEN level END) OVER ()"))
    return best.select("source", "n", "source_size", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight"))).alias("target"))


def fly(prob: np.ndarray, size: np.ndarray, draws: np.random.Generator, spared: int = 0) -> np.ndarray:
    """Probabilities after the flight: at most two are neither 0 nor 1, and the last ``spared``, which stay as they are.

    The sums of prob and of prob * size are kept.
    """
    p, s, done = prob.tolist(), size.tolist(), 0
    todo = [i for i, x in enumerate(p) if EPSILON < x < 1 - EPSILON]
    todo = todo[: max(0, len(todo) - spared)]
    held: list[int] = []
    while True:
        while len(held) < 3 and done < len(todo):
            held.append(todo[done])
            done += 1
        if len(held) < 3:
            if len(held) < 2 or s[held[0]] != s[held[1]]:
                break
            step = (1.0, -1.0)  # of equal size
        else:
            a, b, c = (s[i] for i in held)
            step = (c - b, a - c, b - a) if not a == b == c else (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / u if u > 0 else -p[i] / u for i, u in zip(held, step, strict=True) if u)
        down = min(p[i] / u if u > 0 else (p[i] - 1) / u for i, u in zip(held, step, strict=True) if u)
        move = up if draws.random() * (up + down) < down else -down
        for i, u in zip(held, step, strict=True):
            p[i] += move * u
            p[i] = 0.0 if p[i] < EPSILON else 1.0 if p[i] > 1 - EPSILON else p[i]
        held = [i for i in held if 0 < p[i] < 1]
    return np.array(p)


def land(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rounds the open probabilities (at most two) so that words, then documents, are nearest to their aim, and mends what is left."""
    at = np.flatnonzero((prob > 0) & (prob < 1))
    aim = float(prob[at] @ size[at])
    choices = [[(k >> j) & 1 for j in range(len(at))] for k in range(1 << len(at))]
    out = prob.copy()
    if len(at):
        out[at] = min(choices, key=lambda c: (abs(float(np.dot(c, size[at])) - aim), abs(sum(c) - prob[at].sum()), c))
        for i in changing(np.where(out > 0, -size, size), np.where(out > 0, -1, 1), float((prob - out) @ size), float((prob - out).sum())):
            out[i] = 1 - out[i]
    return out


def changing(words: np.ndarray, documents: np.ndarray, lack: float, lack_documents: float) -> list[int]:
    """At most three places whose changes come nearest to ``lack``, the fewest of these, without taking documents out of balance.

    All singles and pairs of a bounded number of places are looked at, those with the fewest words and those nearest to
    the lack or its half, and all threes if there are not many.
    """
    at = np.arange(len(words))
    if len(at) > LAND_ROWS:
        nearest = [np.argsort(np.abs(np.abs(words) - abs(lack) * part), kind="stable")[: LAND_ROWS // 3] for part in (0, 0.5, 1)]
        at = np.unique(np.concatenate(nearest))
    w, d = words[at], documents[at]
    best, chosen = abs(lack), []
    room = max(2.0, abs(lack_documents))
    sums, counts, sets = w, d, np.arange(len(at))[:, None]
    for size in (1, 2, 3):
        if size > 1:
            if len(at) > (LAND_ROWS, LAND_THREES)[size - 2]:
                break
            first, more = np.nonzero(sets[:, -1, None] < np.arange(len(at)))
            sums, counts, sets = sums[first] + w[more], counts[first] + d[more], np.c_[sets[first], more]
        if not len(sets):
            break
        off = np.where(np.abs(lack_documents - counts) <= room, np.abs(lack - sums), np.inf)
        k = int(off.argmin())
        if off[k] < best - EPSILON:
            best, chosen = off[k], at[sets[k]].tolist()
    return chosen


def _round(last: bool):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("__order", "ascending"), ("__tie", "ascending"), ("__row", "ascending")])
        seed = zlib.crc32(repr((rows.column("source")[0].as_py(), rows.column("__chunk")[0].as_py(), rows.column("__part")[0].as_py())).encode())
        size = rows.column("size").to_numpy().astype(float)
        prob = fly(rows.column("__prob").to_numpy(), size, np.random.default_rng(seed), 0 if last else SPARED)
        at = rows.schema.get_field_index("__prob")
        return rows.set_column(at, "__prob", pa.array(land(prob, size) if last else prob))

    return run


def chunked(state: DataFrame, chunk_rows: int) -> tuple[DataFrame, int]:
    """``state`` with ``__part``, which parts the chunks that equal rows overfill, and the most parts of a chunk."""
    counts = state.groupBy("source", "__chunk").agg(F.count("*").alias("n")).where(F.col("n") > OVERFULL * chunk_rows)
    over = cut(counts.select(F.col("source").alias("s"), F.col("__chunk").alias("c"), F.ceil(F.col("n") / F.lit(float(chunk_rows))).alias("parts")), "overfull")
    n_over, most = over.agg(F.count("*"), F.max("parts")).first()
    if not n_over:
        return state.withColumn("__part", F.lit(0).cast("long")), 1
    joined = state.join(F.broadcast(over) if n_over <= 10_000 else over, F.col("source").eqNullSafe(F.col("s")) & (F.col("__chunk") == F.col("c")), "left")
    return joined.withColumn("__part", F.coalesce(F.pmod(F.xxhash64("__row"), F.col("parts")), F.lit(0)).cast("long")).drop("s", "c", "parts"), most


_OWN = ("doc_id", "size", "source_size", "target", "copies", "taken")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, keep: tuple[str, ...] = (), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken, *keep) for each row.

    ``size`` is the number of words, ``copies`` how often the mix takes the row, ``taken`` the words so taken. A
    null source is a source of its own, null texts have no words. Rows count one by one, also when they repeat.
    The order of flight is that of hashes of doc_id and size, then of the text and what is kept, so a rerun takes the
    same, however rows are dealt to files; rows equal in both that overfill a chunk are dealt to several. An empty table gives an empty result. A kept column named like the result's
    gets ``_in`` added; other columns are ignored.
    """
    tie = F.xxhash64("doc_id", "text", *(F.col(f"`{c}`") for c in keep)).alias("__tie")
    rows = cut(docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("__row"), tie, *carried(keep)), "sizes")
    targets = cut(source_targets(rows, weights, share, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    priced = rows.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.*", "source_size", "target", "n", rate.alias("__rate"))
    base = F.floor(F.col("__rate") + EPSILON)
    chunks = F.ceil(F.col("n") / F.lit(float(chunk_rows)))
    state = priced.select(
        *[F.col(c) for c in rows.columns], "source_size", "target", base.alias("__base"), F.greatest(F.col("__rate") - base, F.lit(0.0)).alias("__prob"),
        F.pmod(F.xxhash64("doc_id", "size"), chunks).alias("__chunk"), F.xxhash64("size", "doc_id").alias("__order"),
    )
    state, most_parts = chunked(state, chunk_rows)
    schema, done = state.schema, []
    most_chunks = math.ceil((targets.agg(F.max("n")).first()[0] or 0) / chunk_rows)
    fractional = (F.col("__prob") > EPSILON) & (F.col("__prob") < 1 - EPSILON)
    left = state
    while True:
        last = most_chunks <= 1 and most_parts <= 1
        flown = cut(left.groupBy("source", "__chunk", "__part").applyInArrow(_round(last), schema), "flight")
        done.append(flown if last else flown.where(~fractional))
        if last:
            break
        level = "__part" if most_parts > 1 else "__chunk"
        left = flown.where(fractional).withColumn(level, F.floor(F.col(level) / FAN_IN))
        most_parts, most_chunks = (-(-most_parts // FAN_IN), most_chunks) if most_parts > 1 else (1, -(-most_chunks // FAN_IN))
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionAll(more)
    copies = (F.col("__base") + F.round("__prob")).cast("long")
    return whole.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *restored(_OWN, keep))


def op8_cube_mix(spark, sf_dir: str) -> DataFrame:
    """Words taken from each document."""
    found = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "source_size", "target", "taken")
