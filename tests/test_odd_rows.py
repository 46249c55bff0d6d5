"""Queries against their SQL on small tables with rows that the test tables lack."""

from datetime import datetime

import duckdb

from babelshelf import catalog


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over ``tables`` of (schema, rows)."""
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = con.sql(catalog.ORACLES[name])
    found = catalog.QUERIES[name](spark, str(folder)).select(*want.columns)
    return sorted(map(repr, map(tuple, found.collect()))), sorted(map(repr, want.fetchall()))


def test_empty_folders_are_no_files(spark, tmp_path):
    found, want = both(
        spark, tmp_path, "file_list_expand",
        nation=("n_nationkey int, n_regionkey int", [(1, 0), (2, 3)]),
        customer=("c_custkey long, c_nationkey int", [(10, 1), (11, 1), (12, 2)]),
        orders=("o_orderkey long, o_custkey long", [(1, 10), (3, 12), (50, 12)]),
    )
    assert found == want and len(want) == 2


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def events(*values):
    """One event a file for each of ``values``, and file 0 with all of them."""
    at = datetime(2024, 1, 2)
    return EVENTS, [(i, at, i, "view", x) for i, x in enumerate(values, 1)] + [(100 + i, at, 0, "view", x) for i, x in enumerate(values)]


def test_harmonic_mean_with_a_zero_is_zero(spark, tmp_path):
    found, want = both(spark, tmp_path, "mean_harmonic", events=events(0.0, 2.0, 5.5))
    assert found == want and sum(x.endswith(", 0.0)") for x in want) == 2


def test_shown_percentages_round_exact_values_half_to_even(spark, tmp_path):
    found, want = both(spark, tmp_path, "topk_choices", events=events(3.125, 9.375, 68.775))
    assert found == want and any("0.62%" in x for x in want)


def test_samples_are_summed_before_they_meet_fits(spark):
    from babelshelf.operators import calibration

    samples = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 8.0), ("a", None, 5.0), ("b", 2.0, 4.0)], "k string, x double, y double")
    fits = spark.createDataFrame([("a", 1, 1.0, 2.0, 0.0), ("a", 2, 1.0, 1.0, 0.5)], "k string, degree int, c double, b double, a double")
    found = calibration.residuals(samples, fits, "k")
    assert {r.degree: round(r.residual, 9) for r in found.collect()} == {1: round((-1 / 2 + 1 / 8) / 2, 9), 2: round((-0.5 / 2 - 0.5 / 8) / 2, 9)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")


def test_aliases_are_not_broadcast(spark):
    from babelshelf.operators import options

    names, pairs = (spark.createDataFrame(rows, schema) for rows, schema in (([("a",), ("b",), ("x",)], "name string"), ([("a", "b"), ("b", "k")], "alias string, target string")))
    found = options.resolved(names, pairs, spark.createDataFrame([("k",)], "name string"))
    assert sorted(map(tuple, found.collect()), key=str) == [("a", "k", None), ("b", "k", None), ("x", None, "unknown")]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
