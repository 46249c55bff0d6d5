import time

from pyspark.sql import functions as F

from babelshelf.operators import lookup, progress, summary


def test_dispatch_of_odd_texts(spark):
    series = '{"provider":"tmdb","data":{"metadata_type":"series","series_id":%s}}'
    rows = [None, "", "{", "[]", "3", '{"provider":"tmdb"}', '{"data":{"metadata_type":"series"}}', series % 7, series % '"8"', series % "1.5", series % "null", series % "99999999999", '{"provider":"tmdb","data":{"metadata_type":"skip","series_id":3}}', '{"provider":"tmdb","data":[1]}', '{"provider":7,"data":{}}']
    df = spark.createDataFrame([(k, x, "mine") for k, x in enumerate(rows)], "k int, metadata string, number string")
    found = {r.k: (r.kind, r.number, r.error) for r in lookup.dispatched(df).collect()}
    bad, no_provider, no_kind = (None, None, "bad JSON"), (None, None, "unknown provider"), (None, None, "unknown metadata_type")
    assert [found[k] for k in range(7)] == [(None, None, None), bad, bad, no_provider, no_provider, no_kind, no_provider]
    assert [found[k] for k in range(7, 15)] == [("series", 7, None), ("series", 8, None), *[("series", None, None)] * 3, ("skip", None, None), no_kind, no_provider]
    assert lookup.dispatched(df.limit(0)).count() == 0


def test_each_text_is_parsed_once(spark):
    df = spark.range(3).selectExpr("cast(id AS string) AS metadata")
    plan = lookup.dispatched(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") <= 1 and "get_json_object" not in plan


def test_schemas_of_unknown_tags(spark):
    rows = ['{"provider":"x","data":{"a":1}}', '{"provider":"x","data":{"a":2,"b":"t"}}', '{"provider":"tmdb","data":{"metadata_type":"film","id":1}}', "{", None]
    found = {(r.provider, r.kind): (r.n, r.shape) for r in lookup.unknown(spark.createDataFrame([(x,) for x in rows], "metadata string")).collect()}
    assert found == {("x", None): (2, "OBJECT<data: OBJECT<a: BIGINT, b: STRING>, provider: STRING>"), ("tmdb", "film"): (1, "OBJECT<data: OBJECT<id: BIGINT, metadata_type: STRING>, provider: STRING>")}


def test_counts_come_with_the_write(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def seen(parts):
        for part in parts:
            calls.add(part.num_rows)
            yield part

    rows = spark.range(1000, numPartitions=4).selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL ELSE id % 3 = 0 END AS ok").mapInArrow(seen, "id long, ok boolean")
    found = progress.written(rows, f"{tmp_path}/out", progress.outcome_counts())
    assert calls.value == 1000
    back = spark.read.parquet(f"{tmp_path}/out")
    want = {r.success: r.n for r in summary.outcomes(back).collect()}
    assert found == {"total": 1000, "good": want[True], "bad": want[False]}
    assert progress.written(rows.limit(0), f"{tmp_path}/none", progress.outcome_counts()) == {"total": 0, "good": 0, "bad": 0}


def test_counts_of_micro_batches(spark, tmp_path):
    for k in range(3):
        spark.range(10 * (k + 1)).selectExpr("id", "id % 2 = 0 AS ok").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    told = []
    listener = progress.Progress("scan", told.append)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long, ok boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = progress.watched(stream, "scan", {"n": F.count(F.lit(1)), "good": F.count_if("ok")}).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        until = time.time() + 20
        while len(told) < 3 and time.time() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert sorted(x["n"] for x in told) == [10, 20, 30] and all(2 * x["good"] == x["n"] for x in told)
