import random

from babelshelf.operators import quota as batch
from babelshelf.streaming import quota

SCHEMA = "kind string, at long, name string, stop boolean"
QUOTAS = {"language": (3, 10), "metadata": (0, 7)}


def brute(batches, quotas, aborts=True):
    """(kind, at, name, position), by a counter for each kind."""
    position, frozen, out = dict.fromkeys(quotas, 0), set(), []
    for rows in batches:
        for kind, at, name, stop in sorted(rows, key=lambda r: r[1]):
            if aborts and stop:
                frozen |= set(quotas) if kind is None else {kind}
            elif kind in quotas and kind not in frozen:
                start, amount = quotas[kind]
                if start <= position[kind] < start + amount:
                    out.append((kind, at, name, position[kind]))
                position[kind] += 1
    return sorted(out)


def arrive(spark, folder, rows, k):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder, abort="stop"):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    quota.run_to_end(quota.counted(stream, "kind", ["at"], QUOTAS, abort), f"{folder}/out", f"{folder}/checkpoint")
    return sorted((r.kind, r.at, r.name, r.position) for r in spark.read.parquet(f"{folder}/out").collect())


def batches(n, size, seed, stops=()):
    dice = random.Random(seed)
    out = [[(dice.choice(["language", "metadata", "other"]), b * 1000 + i, f"f{i}", False) for i in range(size)] for b in range(n)]
    for b, at, kind in stops:
        out[b].append((kind, b * 1000 + at, None, True))
    for rows in out:
        dice.shuffle(rows)
    return out


def test_state_survives_restarts_and_abort_freezes(spark, tmp_path):
    """Three runs over the same checkpoint; one kind is stopped in the second, all in the third."""
    arrived = batches(3, 9, seed=1, stops=[(1, 4.5 // 1, "metadata"), (2, 6, None)])
    arrived = [[(k, int(at), name, stop) for k, at, name, stop in rows] for rows in arrived]
    arrived = [[(k, 2 * at + (not stop), name, stop) for k, at, name, stop in rows] for rows in arrived]  # a stop comes before the request of its number
    arrived.append([("language", 9000 + i, "late", None) for i in range(20)])
    for k, rows in enumerate(arrived):
        arrive(spark, tmp_path, rows, k)
        assert run(spark, str(tmp_path)) == brute(arrived[: k + 1], QUOTAS)
    assert run(spark, str(tmp_path)) == brute(arrived, QUOTAS)


def test_equals_the_batch_form_without_an_abort(spark, tmp_path):
    rows, before = batches(1, 200, seed=5)[0], spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    arrive(spark, tmp_path, rows, 0)
    df = spark.createDataFrame(rows, SCHEMA)
    want = []
    for kind, (start, amount) in QUOTAS.items():
        want += [(r.kind, r.at, r.name, r.position) for r in batch.within_quota(df, "kind", ["at"], start, amount, df.at.isNotNull(), [kind]).collect()]
    assert run(spark, str(tmp_path), abort=None) == sorted(want)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
