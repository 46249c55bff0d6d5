"""The whole pipeline over written tables against a plain version of each stage."""

import math
import random
import re
import shutil
from collections import Counter, defaultdict

import numpy as np
from test_pipeline import brute_similar
from test_shards_mixing import brute_targets, near

import corpus_pipeline
from babelshelf.llm import packing, quality, tokens


def brute_strength(groups, center_of):
    """Method of moments over {group: values}."""
    many = {g: v for g, v in groups.items() if len(v) > 1}
    n = sum(map(len, many.values()))
    between = sum(len(v) * (np.mean(v) - center_of(g)) ** 2 for g, v in many.items())
    within = sum(np.var(v, ddof=1) for v in many.values())
    variance = sum(len(v) * center_of(g) * (1 - center_of(g)) for g, v in many.items())
    spread = (between - within) / n
    return min(max(variance / n / spread - 1, 1.0), 1e4) if spread > 1e-9 else 1e4


def brute_kept(rows, weights):
    evidence = [min(max(1 / (1 + math.exp(-min(max(weights[0] + float(np.dot(quality.features_of(text), weights[1:])), -30), 30))), quality.CLIP), 1 - quality.CLIP) for _, text, _, _ in rows]
    hosts, paths = defaultdict(list), defaultdict(list)
    for (_, _, lang, source), e in zip(rows, evidence, strict=True):
        hosts[source].append(e)
        paths[source, lang].append(e)
    center = float(np.mean(evidence))
    k_host = brute_strength(hosts, lambda g: center)
    host_mean = {h: (sum(v) + k_host * center) / (len(v) + k_host) for h, v in hosts.items()}
    k_path = brute_strength(paths, lambda g: host_mean[g[0]])
    logit = lambda p: math.log((q := min(max(p, quality.CLIP), 1 - quality.CLIP)) / (1 - q))
    for row, e in zip(rows, evidence, strict=True):
        host, path = hosts[row[3]], paths[row[3], row[2]]
        others = (sum(host) - e + k_host * center) / (len(host) - 1 + k_host)
        site = (sum(path) - e + k_path * others) / (len(path) - 1 + k_path)
        if logit(e) + logit(site) - logit(center) >= 0:
            yield row


def brute_exact(rows):
    best = {}
    for row in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", row[1] or "")
        if key not in best or (-len(row[1] or ""), row[0]) < (-len(best[key][1] or ""), best[key][0]):
            best[key] = row
    return list(best.values())


def brute_near(rows):
    least = {}
    for row, root in zip(rows, brute_similar([t for _, t, _, _ in rows]), strict=True):
        if root not in least or row[0] < least[root][0]:
            least[root] = row
    return list(least.values())


def test_run(spark, sf, tmp_path):
    dice = random.Random(8)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for _, text, lang, source in dice.sample(rows, 25):
        words = text.split()
        for at in dice.sample(range(len(words)), min(len(words) // 40, 3)):
            words[at] = "changed"
        rows += [(10_000 + len(rows), text + " ", lang, source), (10_000 + len(rows) + 1, " ".join(words), lang, source)]
    rows.append((10**6, None, None, None))
    schema = "doc_id long, text string, lang string, source string"
    spark.createDataFrame(rows, schema).selectExpr("*", "CAST(length(text) AS BIGINT) AS n_chars").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    shutil.copy(f"{sf}/labels.parquet", tmp_path / "labels.parquet")
    docs, labels = spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))
    kept = list(brute_kept(rows, quality.train(docs, labels)))
    left = brute_near(brute_exact(kept))
    assert len(left) < len(kept) - 20 and len(kept) < len(rows)
    library, text_of = tokens.load(tokens.tokenizer_path()), {r[0]: r[1] or "" for r in left}
    ids_of = {i: [*library.encode(t, add_special_tokens=False).ids, packing.END_ID] for i, t in text_of.items()}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    copies, ids, sequences = Counter(), Counter(), defaultdict(list)
    for p in pieces:
        copies[p.doc_id] += p.start == 0
        assert np.frombuffer(p.ids, "<u4").tolist() == ids_of[p.doc_id][p.start : p.start + p.length] and p.doc_tokens == len(ids_of[p.doc_id])
        ids.update((p.doc_id, k) for k in range(p.start, p.start + p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    # Each copy has each id once, and no document is taken more than twice.
    assert ids == Counter({(i, k): n for i, n in copies.items() for k in range(len(ids_of[i]))}) and max(copies.values()) <= 2
    for parts in sequences.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024
    size = {i: len((t or "").encode().split()) for i, t, _, _ in left}
    sums, taken, sizes = Counter(), Counter(), defaultdict(list)
    for i, _, _, source in left:
        sums[source] += size[i]
        taken[source] += copies[i] * size[i]
        sizes[source].append(size[i])
    assert all(near(taken[s], x, sizes[s]) for s, x in brute_targets(dict(sums)).items())
