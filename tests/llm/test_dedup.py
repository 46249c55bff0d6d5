import hashlib
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest
import xxhash
from pyspark.sql import functions as F

from babelshelf.llm import exact, simhash
from babelshelf.llm.components import components

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def brute_print(text):
    words = [w for w in BLANK.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Root of each distinct fingerprint."""
    nodes = sorted(set(prints))
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_simhash(request, table):
    df = request.getfixturevalue(table)
    rows = [(r.doc_id, brute_print(r.text)) for r in df.collect()]
    root = brute_components([p for _, p in rows])
    least = defaultdict(list)
    for doc_id, p in rows:
        least[root[p]].append(doc_id)
    want = Counter((doc_id, p, min((x for x in least[root[p]] if x is not None), default=None)) for doc_id, p in rows)
    found = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect())
    assert found == want


def test_simhash_blocks(monkeypatch):
    text = " ".join(str(i % 97) for i in range(1000))
    whole = simhash.fingerprint_of(text)
    monkeypatch.setattr(simhash, "BLOCK", 100)
    assert simhash.fingerprint_of(text) == whole == (x if (x := brute_print(text)) < 1 << 63 else x - (1 << 64))


def test_simhash_empty(none):
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("long_list", [64, 3])
def test_links_connect_like_brute_force(spark, long_list):
    """Crowded fingerprints, so that both short and long lists occur."""
    dice = random.Random(long_list)
    centers = [dice.getrandbits(64) for _ in range(6)]
    prints = {c for c in centers} | {c ^ sum(1 << b for b in dice.sample(range(64), dice.randrange(7))) for c in centers for _ in range(90)} | {dice.getrandbits(64) for _ in range(50)}
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    rows = simhash.links(spark.createDataFrame([(x,) for x in signed.values()], "fp long"), long_list).collect()
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= 2 and r.a != r.b for r in rows)
    found = components(spark.createDataFrame(rows, "a long, b long") if rows else spark.createDataFrame([], "a long, b long")).collect()
    label = {r.node: r.label for r in found}
    groups, want = defaultdict(set), defaultdict(set)
    for p, root in brute_components(list(prints)).items():
        want[root].add(signed[p])
        groups[label.get(signed[p], signed[p])].add(signed[p])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_long_path_and_hub(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(1000, i) for i in range(1001, 1200)] + [(-5, -4)]
    label = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {label[i] for i in range(100, 181)} == {100} and {label[i] for i in range(1000, 1200)} == {1000} and label[-4] == label[-5] == -5
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[hashlib.sha256(BLANK.sub("", text or "").encode()).hexdigest()].append((-len(text or ""), doc_id is None, doc_id or 0))
    return {k: (None if (best := min(v))[1] else best[2], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_exact(request, spark, table):
    df = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    groups = brute_exact(rows)
    found = exact.deduplicate(df, exact.fresh_index(spark, 3)).collect()
    assert Counter((r.doc_id, r.text_sha256) for r in found) == Counter((i, hashlib.sha256(BLANK.sub("", t or "").encode()).hexdigest()) for i, t in rows)
    assert all((r.keep_id, r.group_size) == groups[r.text_sha256] for r in found)
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept) == set(groups) and set(kept.values()) == {1} and all(r.doc_id == r.keep_id for r in found if r.kept)


def test_exact_later_batches(spark):
    index = exact.fresh_index(spark, 3)
    schema = "doc_id long, text string"
    exact.deduplicate(spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], schema), index).collect()
    second = {r.doc_id: r for r in exact.deduplicate(spark.createDataFrame([(9, "a  b"), (8, "d"), (7, "d")], schema), index).collect()}
    assert (second[9].keep_id, second[9].kept) == (1, False) and second[7].kept and not second[8].kept and second[8].keep_id == 7
    again = exact.deduplicate(spark.createDataFrame([(9, "a  b"), (8, "d"), (7, "d")], schema), index).collect()
    assert not any(r.kept for r in again) and index.table().count() == 3
    opened = exact.DigestIndex(spark, "digest_index_reopened", index.path, 3)
    assert opened.table().count() == 3
    plan = opened.judged(exact.survivors(exact.digests(spark.createDataFrame([(1, "z")], schema)).withColumn("t", exact.F.lit(1)), "t"), "b")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan
    opened.drop()


def test_exact_batch_run_again(spark):
    """A batch whose result was lost, also between its steps, gives the same result again, and not a later one's."""
    index, schema = exact.fresh_index(spark, 3), "doc_id long, text string"
    exact.deduplicate(spark.createDataFrame([(1, "a"), (2, "b")], schema), index, "first").collect()
    batch = spark.createDataFrame([(5, "b"), (4, "c"), (3, "c"), (6, "d"), (None, None)], schema)
    # The first try breaks off when only some of its digests are in the index.
    index.append(exact.survivors(exact.digests(batch.where("doc_id = 6"))), "second")
    tries = [sorted(map(tuple, exact.deduplicate(batch, index, "second").collect()), key=repr) for _ in range(3)]
    assert tries[0] == tries[1] == tries[2] and sorted(r[0] for r in tries[0] if r[3] and r[0]) == [3, 6] and sum(r[3] for r in tries[0]) == 3
    assert index.table().count() == 5 and index.table().where("batch = 'second'").count() == 3
    later = exact.deduplicate(batch, index, "third").collect()
    assert not any(r.kept for r in later) and {r.doc_id: r.keep_id for r in later} == {5: 2, 4: 3, 3: 3, 6: 6, None: None}
    path = index.path
    index.drop(files=True)
    assert not list(Path(path.removeprefix("file://")).glob("*.parquet"))


def test_kept_columns_may_clash(spark):
    rows = spark.createDataFrame([(1, "x y z", "k", 7), (1, "x y z", "k", 7), (None, None, None, None)], "doc_id long, text string, kept string, fp int")
    found = exact.deduplicate(rows, exact.fresh_index(spark, 2), keep=("kept", "doc_id", "fp"))
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "kept_in", "doc_id_in", "fp"]
    assert sorted((r.doc_id_in or 0, r.kept_in, r.fp, r.kept) for r in found.collect()) == [(0, None, None, True), (1, "k", 7, False), (1, "k", 7, True)]
    near = simhash.near_duplicates(rows, keep=("fp", "kept"))
    assert near.columns == ["doc_id", "fp", "component_id", "__label", "fp_in", "kept"] and sorted((r.fp_in or 0, r.component_id or 0) for r in near.collect()) == [(0, 0), (7, 1), (7, 1)]


def test_tally_drops_met_pairs(spark):
    """Pairs with three equal lists' bytes or fewer meet but are not verified; those with six equal bytes reach the minimum exactly."""
    dice = random.Random(2)
    center = dice.getrandbits(64)
    # Of each, so many bytes differ in one bit.
    prints = [center] + [center ^ sum(1 << (8 * k) for k in dice.sample(range(8), n)) for n in (1, 2, 3, 4) for _ in range(3)]
    signed = [p - (1 << 64) if p >> 63 else p for p in dict.fromkeys(prints)]
    met = simhash.postings(spark.createDataFrame([(x,) for x in signed], "fp long"))
    tally = {(r.a, r.b): r.n for r in simhash.tallied(met).collect()}
    differ = {pair: sum(((pair[0] ^ pair[1]) >> 8 * k) & 255 != 0 for k in range(8)) for pair in tally}
    assert simhash.LEAST_LISTS == 3 and all(n == {1: 7, 2: 3, 3: 1, 4: 1}[differ[pair]] for pair, n in tally.items())
    retained = {(r.a, r.b) for r in simhash.tallied(met).where(F.col("n") >= simhash.LEAST_LISTS).collect()}
    assert 0 < len(retained) < len(tally) and retained == {p for p in tally if differ[p] <= 2}
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) % (1 << 64)).bit_count() <= 2}
    assert {(r.a, r.b) for r in simhash.verified(simhash.tallied(met)).collect()} == want


def test_exact_empty(spark, none):
    assert exact.deduplicate(none, exact.fresh_index(spark, 2)).count() == 0


def test_near_copies_are_tallied_over_lists(spark):
    """A pair that meets in one list only is no candidate; too few meetings of a pair at 0.8 are as rare as stated."""
    from math import comb

    from babelshelf.llm import similar

    met = spark.createDataFrame([(1, 10), (1, 20), (2, 10), (2, 30), (3, 10), (3, 30), (4, 30)], "key long, node long")
    assert [tuple(r) for r in similar.met_often(met).collect()] == [(10, 30)]
    for chance, n, least, stated in ((0.8**similar.ROWS, similar.BANDS, similar.LEAST_LISTS, 16), (0.8 + 0.2 / 256, similar.BANDS * similar.ROWS, similar.LEAST_BYTES, 34)):
        assert sum(comb(n, k) * chance**k * (1 - chance) ** (n - k) for k in range(least)) < 1 / (stated * 10**6)
