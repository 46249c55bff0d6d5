import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from babelshelf.llm import mixing, shards


def slim(df):
    return df.select("doc_id", shards.text_size(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))


@pytest.mark.parametrize("table", ["odd", "documents"])
@pytest.mark.parametrize("n,cell_rows", [(16, 20), (3, 20_000), (1, 10)])
def test_shards(request, table, n, cell_rows):
    df = request.getfixturevalue(table)
    found = shards.histogram_shards(slim(df), n, keys=("doc_id", "text_crc32"), cell_rows=cell_rows).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == want
    slots, sums = defaultdict(list), Counter()
    for r in found:
        slots[r.shard].append(r.slot)
        sums[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(n))
    # A boundary is at most half the row on it away from its aim.
    mean, most = sum(sums.values()) / n, max(r.size for r in found)
    assert all(abs(sums[k] - mean) <= most for k in range(n))


def test_shards_plan_has_no_python(documents):
    plan = shards.histogram_shards(slim(documents), 16, keys=("doc_id", "text_crc32"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_shards_keep_other_columns(odd, none):
    found = shards.histogram_shards(odd.withColumn("size", F.lit(1)), 4, keys=("doc_id", "text"))
    assert set(found.columns) == set(odd.columns) | {"slot"} and found.where("shard < 0 OR shard > 3").count() == 0
    assert shards.histogram_shards(slim(none), 4, keys=("doc_id", "text_crc32")).count() == 0


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return target


@pytest.mark.parametrize("table", ["odd", "documents"])
@pytest.mark.parametrize("chunk_rows", [20_000, 9])
def test_mix(request, table, chunk_rows):
    df = request.getfixturevalue(table)
    sizes, by_id, count = Counter(), defaultdict(list), Counter()
    for r in df.collect():
        n = len((r.text or "").encode().split())
        sizes[r.source] += n
        count[r.source] += 1
        by_id[r.doc_id].append(n)
    target = brute_targets(dict(sizes))
    found = mixing.mix(df, keep=("source",), chunk_rows=chunk_rows).collect()
    got = defaultdict(list)
    taken, copies, by_source = Counter(), Counter(), defaultdict(list)
    for r in found:
        got[r.doc_id].append(r.size)
        taken[r.source] += r.taken
        copies[r.source] += r.copies
        by_source[r.source].append(r.size)
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in by_id.items()}
    for s in sizes:
        assert near(taken[s], target[s], by_source[s])
        assert abs(copies[s] - (target[s] / sizes[s] * count[s] if sizes[s] else 0)) <= 4
    again = mixing.mix(df.repartition(3), keep=("source",), chunk_rows=chunk_rows).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in found)


def near(taken, target, sizes):
    """Within a hundredth, or half of the largest document where that is much of the target."""
    largest = max(sizes, default=0)
    return abs(taken - target) <= max(target / 100, largest / 2 if largest > target / 20 else 0, 1)


def test_every_source_comes_near_its_target(spark):
    """At sf0.01 each source has 50 documents, some with one of a third of its words."""
    found = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), keep=("source",))
    rows = found.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(rows) == 20 and all(abs(r.taken - r.target) <= r.target / 1000 for r in rows)


def test_landing_is_as_near_as_the_best_subset():
    """Ten documents, one far larger than the others: enumeration of all subsets is hardly better."""
    rng = np.random.default_rng(3)
    for k in range(40):
        size = np.r_[rng.integers(1, 60, 9), 5000.0].astype(float)
        prob = np.full(10, 0.4)
        landed = mixing.land(mixing.fly(prob, size, np.random.default_rng(k)), size)
        aim = prob @ size
        errors = sorted(abs(sum(size[i] for i in range(10) if s >> i & 1) - aim) for s in range(1024))
        assert abs(landed @ size - aim) <= max(errors[0] * 1.1, size[:9].min())


def test_changing_keeps_documents_in_balance():
    words, documents = np.array([10.0, 20.0, -30.0, 5.0, 7.0]), np.array([1, 1, -1, 1, 1])
    assert mixing.changing(words, documents, 0.0, 0.0) == [] and mixing.changing(words, documents, 30.0, 0.0) == [0, 1]
    assert mixing.changing(words, documents, 35.0, 0.0) in ([0, 1], [1, 4]) and mixing.changing(words, documents, 35.0, 1.0) == [0, 1, 3]
    assert mixing.changing(words, documents, -3.0, 0.0) == [1, 2, 4] and mixing.changing(words[:0], documents[:0], 9.0, 0.0) == []


def test_reruns_agree_on_rows_of_equal_size(spark):
    """Rows that are equal in id and size are taken by their text, not by the file that they are in."""
    rows = [(k % 3, f"{'abc'[k % 3]} word {k}", "s") for k in range(90)]
    first, again = (spark.createDataFrame(r, "doc_id long, text string, source string").repartition(n) for r, n in ((rows, 2), (rows[::-1], 7)))
    found = [Counter(map(tuple, mixing.mix(df, weights=(1,), share=0.5, keep=("text",)).select("text", "copies").collect())) for df in (first, again)]
    assert found[0] == found[1] and set(x for _, x in found[0]) == {0, 1}


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(1)
    size = rng.integers(0, 500, 4000).astype(float)
    prob = np.full(4000, 0.37)
    out = mixing.fly(prob, size, np.random.default_rng(2))
    assert ((out > 0) & (out < 1)).sum() <= 2 and abs(out.sum() - prob.sum()) < 1e-6 and abs(out @ size - prob @ size) < 1e-3
    landed = mixing.land(out, size)
    assert set(landed.tolist()) <= {0.0, 1.0} and abs(landed @ size - prob @ size) <= 500
    # Unbiased: over many flights each document is taken as often as its probability says.
    small = np.array([3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0])
    mean = np.mean([mixing.fly(np.full(8, 0.4), small, np.random.default_rng(k)) for k in range(3000)], axis=0)
    assert np.abs(mean - 0.4).max() < 0.05


def test_kept_columns_may_clash(odd):
    found = mixing.mix(odd, keep=("size", "copies", "n"))
    assert found.columns == ["doc_id", "size", "source_size", "target", "copies", "taken", "size_in", "copies_in", "n"]
    assert Counter(map(repr, found.select("doc_id", "size_in", "copies_in", "n").collect())) == Counter(map(repr, odd.selectExpr("doc_id", "size AS size_in", "copies AS copies_in", "n").collect()))


def test_equal_rows_do_not_overfill_a_chunk(spark):
    rows = [(1, "same words here", "a")] * 3000 + [(None, None, None)] * 700 + [(i, "w " * (i % 40), "b") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    state = df.withColumn("__chunk", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(20))).withColumn("__row", F.monotonically_increasing_id())
    parted, most = mixing.chunked(state, 100)
    assert most >= 30 and parted.count() == 5700 and parted.groupBy("source", "__chunk", "__part").count().agg(F.max("count")).first()[0] <= 450
    sums, target, by_source = Counter(), {}, defaultdict(list)
    for r in mixing.mix(df, keep=("source",), chunk_rows=50).collect():
        sums[r.source] += r.taken
        target[r.source] = r.target
        by_source[r.source].append(r.size)
        assert 0 <= r.copies <= 2
    assert all(near(sums[s], target[s], by_source[s]) for s in target)


def test_mix_empty(none):
    assert mixing.mix(none).count() == 0


@pytest.mark.parametrize("n", [16, 5])
def test_repeated_rows_keep_the_law(spark, n):
    """2,000 equal rows among 4,000: each shard is within the tolerance and one document of its aim."""
    rows = [(i, "some text of its own %d" % i) for i in range(2000)] + [(None, "the same text over and over again")] * 1900 + [(None, None)] * 100
    found = shards.sharded_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), n).collect()
    sums = Counter()
    for r in found:
        sums[r.shard] += r.size
    mean, most = sum(sums.values()) / n, max(r.size for r in found)
    assert len(found) == 4000 and all(abs(sums[k] - mean) <= most + 2 * 0.0005 * mean for k in range(n))


def test_exchange_grows_with_the_bytes(documents, monkeypatch):
    """More bytes than the session's partitions should hold are exchanged into more partitions, still once and with the same result."""
    want = sorted(map(tuple, shards.histogram_shards(slim(documents), 4, keys=("doc_id", "text_crc32"), cell_rows=5).collect()))
    monkeypatch.setattr(shards, "TASK_BYTES", 10_000)
    found = shards.histogram_shards(slim(documents), 4, keys=("doc_id", "text_crc32"), cell_rows=5)
    assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan and plan[plan.find("Final Plan") : plan.find("Initial Plan")].count("REPARTITION_BY_NUM") == 1


def test_documents_are_sharded_with_their_texts(spark, sf, odd):
    found = shards.sharded_documents(odd)
    assert Counter((r.doc_id, r.text) for r in found.collect()) == Counter((r.doc_id, r.text) for r in odd.collect())
    plan = shards.op3_histogram_sort(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.find("crc32(cast(coalesce(text") < plan.find("row_number()")
