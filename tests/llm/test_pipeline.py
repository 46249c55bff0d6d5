import random

import pytest

import corpus_pipeline
from babelshelf.llm.common import DOCUMENT_COLUMNS


def test_stages_run_on_odd_rows(spark, sf, odd, tmp_path):
    docs = odd
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, sf)
        got.write.parquet(str(tmp_path / name))
        got = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert tuple(got.columns) == DOCUMENT_COLUMNS and got.count() > 0
        docs = got


def test_dedup_stages_keep_one_of_each_group(spark, sf, odd):
    import hashlib
    import re

    from babelshelf.llm.simhash import near_duplicates

    first = corpus_pipeline.exact_dedup(spark, odd, sf)
    plain = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in first.collect()]
    assert len(plain) == len(set(plain)) == len({hashlib.md5(re.sub(r"[\x20\x09-\x0D]", "", r.text or "").encode()).digest() for r in odd.collect()})
    second = corpus_pipeline.near_dedup(spark, odd, sf).collect()
    assert len(second) == near_duplicates(odd).select("__label").distinct().count()


def test_mixing_stage_repeats_rows(spark, sf, documents):
    from babelshelf.llm.mixing import mix

    want = {r.doc_id: r.copies for r in mix(documents).collect() if r.copies}
    got = {r.doc_id: r["count"] for r in corpus_pipeline.mixing(spark, documents, sf).groupBy("doc_id").count().collect()}
    assert got == want


def test_run_on_empty_documents(spark, sf, none):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def brute_similar(texts):
    """Number of each text's component under links of similarity 0.8 or more."""
    words = [(t or "").encode().lower().split() for t in texts]
    sets = [{b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {b" ".join(w)} for w in words]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize(("long_list", "most"), [(32, 50_000), (2, 10)])
def test_near_dedup_finds_all_similar_pairs(spark, sf, odd, documents, monkeypatch, long_list, most):
    """Planted copies with a few changed words, up to similarity 0.8, in groups of several sizes."""
    from babelshelf.llm import similar

    monkeypatch.setattr(similar.near_copies, "__defaults__", (*similar.near_copies.__defaults__[:-1], long_list))
    monkeypatch.setattr(similar, "BROADCAST_ROWS", most)
    dice = random.Random(11)
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None] + [(1000 + r.doc_id, r.text) for r in documents.collect()]
    for group in range(12):
        base = [f"g{group}x{dice.randrange(400)}" for _ in range(dice.choice([40, 120, 300]))]
        for copy in range(dice.choice([2, 5, 50])):
            words = list(base)
            for at in dice.sample(range(len(words)), dice.randrange(1, 2 + len(words) // 60)):
                words[at] = f"new{copy}x{at}"
            rows.append((10**6 + len(rows), " ".join(words)))
    roots = brute_similar([t for _, t in rows])
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    least = {}
    for (doc_id, _), root in zip(rows, roots, strict=True):
        least[root] = min(doc_id, least.get(root, doc_id))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == sorted(least.values())


def _near(spark, rows, monkeypatch, long_list=2):
    from babelshelf.llm import similar
    from babelshelf.llm.common import identified

    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'' AS lang", "'' AS source", "0L AS n_chars").repartition(4)
    made = {}
    plain = similar.apart

    def noted(*args):
        made["pairs"] = plain(*args)
        return made["pairs"]

    monkeypatch.setattr(similar, "apart", noted)
    found = similar.near_copies(identified(docs), long_list=long_list).collect()
    return {r.doc_id: r["__label"] for r in found}, made.get("pairs")


def test_rare_shingles_find_what_leads_do_not(spark, monkeypatch):
    """Texts put together from a pool of passages, with all lists long: components are those of brute force."""
    dice = random.Random(21)
    pool = [" ".join(f"p{k}x{dice.randrange(900)}" for _ in range(dice.choice([20, 30, 60]))) for k in range(14)]
    rows = []
    for _ in range(150):
        chosen = sorted(dice.sample(range(14), dice.choice([5, 6])))
        rows += [(len(rows) + c, " ".join([*(pool[k] for k in chosen), *(f"own{len(rows)}y{c}x{j}" for j in range(dice.choice([0, 5, 12, 25])))])) for c in range(dice.choice([1, 1, 2]))]
    labels, pairs = _near(spark, rows, monkeypatch)
    roots = brute_similar([t for _, t in rows])
    assert pairs is not None and pairs.count() > 0
    groups = {}
    for (doc_id, _), root in zip(rows, roots, strict=True):
        assert groups.setdefault(root, labels[doc_id]) == labels[doc_id]
    assert len(set(groups.values())) == len(groups) < len(rows)


@pytest.mark.parametrize("n", [400, 1600])
def test_a_template_makes_no_pairs(spark, monkeypatch, n):
    """Texts that share 86 of 100 words and have 14 of their own are not similar enough, and never meet, however many they are."""
    template = [f"common{k}" for k in range(86)]
    rows = [(i, " ".join([*template, *(f"own{i}x{j}" for j in range(14))])) for i in range(n)]
    rows += [(n + i, " ".join([*template, *(f"own{i}x{j}" for j in range(13)), "changed"])) for i in range(0, n, 10)]
    labels, pairs = _near(spark, rows, monkeypatch, long_list=32)
    assert all((labels[i] == labels[n + i]) == (i % 10 == 0) for i in range(0, n, 10)) and len(set(labels.values())) == n
    assert pairs is None or pairs.count() <= 3 * n
