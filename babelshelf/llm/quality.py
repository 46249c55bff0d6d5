"""Quality by hierarchical empirical Bayes: document evidence with host and path posteriors.

A logistic model of a few shape features gives each document's evidence. Hosts shrink toward the global mean and
paths toward their host, and so on over any number of levels, each with a strength estimated from the spread between groups by the method of moments.
The sums are plain grouped aggregations; a document's own evidence is taken out of its groups' sums.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from babelshelf.llm.common import DOCUMENT_COLUMNS, carried, cut, restored

#: Labelled rows from which the model is fitted, at most; chosen by a hash of their id.
TRAIN_ROWS = 20_000
THRESHOLD = 0.5
RIDGE = 1e-3
#: Evidence stays within (CLIP, 1 - CLIP), so that no model is ever certain.
CLIP = 1e-4
N_FEATURES = 9
_ODD = re.compile(r"[^\w\s.,;:'’\"()!?-]")


def features_of(text: str | None) -> list[float]:
    """Shape of a text: length, plain and upper-case words, symbols, repeats. Null is empty."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    whole = " ".join(words)
    return [
        math.log1p(n),
        sum(map(str.isalpha, (w.rstrip(".,;:!?") for w in words))) / n,
        sum(map(str.isupper, (w for w in words if len(w) > 1))) / n,
        len(_ODD.findall(whole)) / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(words)) / n**0.9,
        min(len(whole) / n, 50.0) / 10,
        whole.count("!") / n,
        sum(c.isdigit() for c in whole) / len(whole),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series([features_of(x) for x in part], dtype=object)


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> list[float]:
    """Intercept and weights for raw features, by ridge-regularised Newton steps on standardised ones."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread = np.where(spread > 1e-12, spread, 1.0)
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    w, ridge = np.zeros(z.shape[1]), np.diag([0.0, *[RIDGE * len(x)] * x.shape[1]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + ridge + 1e-9 * np.eye(len(w)), z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    raw = w[1:] / spread
    return [float(w[0] - raw @ mean), *map(float, raw)]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list[float]:
    """Weights from at most ``rows`` labelled documents; without both classes, evidence is the same for all.

    An id that stands on several documents counts once for each of its labels, by the least of their features.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality").distinct()
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    # At most ``rows`` pairs of numbers are broadcast, and as many rows of features come back.
    seen = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select(features("text").alias("x"), "quality", "doc_id")
    got = seen.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toPandas().sort_values(["doc_id", "quality"], kind="stable")
    y = (got["quality"].to_numpy() > 0).astype(float)
    if not len(y) or y.min() == y.max():
        return [3.0 if not len(y) or y[0] else -3.0, *[0.0] * N_FEATURES]
    return fit_logistic(np.array(got["x"].tolist(), dtype=float), y)


def evidence(text: str, weights: list[float]) -> Column:
    """The model's probability that a document is good."""

    @F.pandas_udf(T.DoubleType())
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = np.array(weights[1:])
        for part in texts:
            x = np.array([features_of(t) for t in part]).reshape(-1, N_FEATURES)
            yield pd.Series(np.clip(1 / (1 + np.exp(-np.clip((x * w).sum(axis=1) + weights[0], -30, 30))), CLIP, 1 - CLIP))

    return score(text)


def strength(groups: DataFrame, center: Column) -> float:
    """Prior observations a group's mean is worth, from (n, s, ss) rows: the method of moments for a Beta prior."""
    mean = F.col("s") / F.col("n")
    got = groups.where("n > 1").agg(
        F.sum(F.col("n") * F.pow(mean - center, 2)).alias("between"), F.sum(F.greatest(F.col("ss") - F.col("s") * mean, F.lit(0.0)) / (F.col("n") - 1)).alias("within"),
        F.sum("n").alias("n"), F.sum(F.col("n") * center * (1 - center)).alias("variance"), F.count("*").alias("k"),
    ).first()
    if not got.n:
        return 10.0
    spread = (got.between - got.within) / got.n
    return float(min(max(got.variance / got.n / spread - 1, 1.0), 1e4)) if spread > 1e-9 else 1e4


def _logit(p: Column) -> Column:
    bounded = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    return F.log(bounded / (1 - bounded))


_OWN = ("doc_id", "evidence", "site", "posterior", "kept")


def _same(a: str, b: str, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns), F.lit(True))


def sites(rows: DataFrame, levels: list[str]) -> tuple[DataFrame, float, list[float]]:
    """Sums of evidence by all ``levels`` and by each leading part of them, the global mean, and the strength of each level.

    A row (*levels, n1, s1, n2, s2, ...) has the numbers and sums of the groups that a site is in, the widest first. Only
    the deepest groups come from the rows, the others from those below. A group's prior is the posterior mean of the group
    around it.
    """
    sums = [F.count("*").alias("n"), F.sum("evidence").alias("s"), F.sum(F.col("evidence") * F.col("evidence")).alias("ss")]
    depths = [cut(rows.groupBy(*levels).agg(*sums), "sites")]
    for d in range(len(levels) - 1, 0, -1):
        depths.insert(0, depths[0].groupBy(*levels[:d]).agg(*(F.sum(x).alias(x) for x in ("n", "s", "ss"))))
    n, s = depths[0].agg(F.sum("n"), F.sum("s")).first()
    center = s / n if n else 0.5
    whole, mean, strengths = None, F.lit(center), []
    for d, groups in enumerate(depths, 1):
        if whole is not None:
            around = whole.select(*levels[: d - 1], *(f"{x}{k}" for k in range(1, d) for x in ("n", "s")), mean.alias("prior"))
            groups = cut(groups.alias("a").join(around.alias("b"), _same("a", "b", levels[: d - 1])).select("a.*", *(f"b.{c}" for c in around.columns[d - 1 :])), "sites")
            mean = F.col("prior")
        k = strength(groups, mean)
        strengths.append(k)
        whole = groups.withColumnsRenamed({"n": f"n{d}", "s": f"s{d}"})
        mean = (F.col(f"s{d}") + k * mean) / (F.col(f"n{d}") + k)
    return whole.select(*levels, *(f"{x}{k}" for k in range(1, len(levels) + 1) for x in ("n", "s"))), center, strengths


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", keep: tuple[str, ...] = (), threshold: float = THRESHOLD, levels: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, evidence, site, posterior, kept, *keep) for each row.

    ``evidence`` is the document's own, ``site`` its path's posterior mean without it, ``posterior`` both together:
    the evidence's log odds moved by the site's distance from the global mean. ``levels`` name the groups from the widest
    to the narrowest, one at least; they are (host, path) unless given. Null hosts and paths are groups of
    their own; null and empty texts have the features 0. Repeated rows count each time. An empty table gives an empty
    result, and without labels all rows are kept. A kept column named like the result's gets ``_in`` added; other
    columns are ignored.
    """
    levels = levels or (host, path)
    weights = train(docs, labels)
    names = [f"__level{k}" for k in range(len(levels))]
    rows = cut(docs.select("doc_id", *(F.col(f"`{c}`").alias(name) for c, name in zip(levels, names, strict=True)), evidence("text", weights).alias("evidence"), *carried(keep)), "evidence")
    groups, center, strengths = sites(rows, names)
    numbers = [c for c in groups.columns if c not in names]
    own = rows.alias("r").join(groups.alias("g"), _same("r", "g", names)).select("r.*", *(f"g.{c}" for c in numbers))
    e, site = F.col("evidence"), F.lit(center)
    for d, k in enumerate(strengths, 1):
        site = (F.col(f"s{d}") - e + k * site) / (F.col(f"n{d}") - 1 + k)
    scored = own.withColumn("site", site)
    odds = _logit(e) + _logit(F.col("site")) - _logit(F.lit(center))
    return scored.withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumn("kept", F.col("posterior") >= threshold).select(*_OWN, *restored(_OWN, keep))


def op1_quality_bayes(spark, sf_dir: str) -> DataFrame:
    """Evidence, site and posterior of each document, and whether it is kept."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    found = classify(docs.select(*DOCUMENT_COLUMNS), labels)
    return found.select("doc_id", *(F.round(x, 6).alias(x) for x in ("evidence", "site", "posterior")), "kept")
