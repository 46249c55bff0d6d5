"""Queries over durations, numbers and percentages: texts and values made from the orders, read by both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from babelshelf.catalog import query
from babelshelf.functions import duration, numeric
from babelshelf.plans.lenses import select_from, table

# Each is a query that both engines understand: o_orderkey and values or texts of many shapes, right ones, wrong ones, nulls.
SECONDS = "SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey * 7919 % 200003 AS INTEGER) END AS x FROM orders"
CLOCKS = """SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN h || ':' || m WHEN 2 THEN h || ':' || m || ':' || s || ':0' WHEN 3 THEN 'a' || h || ':' || m || ':' || s WHEN 4 THEN '0' || h || ':' || m || ':' || s
WHEN 5 THEN '-' || h || ':' || m || ':' || s WHEN 6 THEN lpad('' || h, 2, '0') || ':' || lpad('' || m, 2, '0') || ':' || lpad('' || s, 2, '0') ELSE h || ':' || m || ':' || s END AS x FROM (SELECT o_orderkey, o_orderkey * 31 % 27 AS h, o_orderkey * 17 % 66 AS m, o_orderkey * 13 % 63 AS s FROM orders) AS clock"""
INTS = """SELECT o_orderkey, CASE o_orderkey % 12 WHEN 0 THEN NULL WHEN 1 THEN '-' || k WHEN 2 THEN '+' || k WHEN 3 THEN '+-' || k WHEN 4 THEN k || '.5' WHEN 5 THEN k || 'x' WHEN 6 THEN 'x' || k WHEN 7 THEN k || '' || k || '' || k || '' || k WHEN 8 THEN '' WHEN 9 THEN k || ' ' || k WHEN 10 THEN '00' || k ELSE '' || k END AS x
FROM (SELECT o_orderkey, o_orderkey * 104729 % 1000003 AS k FROM orders) AS numbers"""
FLOATS = """SELECT o_orderkey, CASE o_orderkey % 15 WHEN 0 THEN NULL WHEN 1 THEN '-' || k || '.25' WHEN 2 THEN '+' || k WHEN 3 THEN '-+' || k WHEN 4 THEN k || '.' || k WHEN 5 THEN k || 'e' || k % 9 WHEN 6 THEN '-' || k || 'E-' || k % 7 WHEN 7 THEN k || '.5e+' || k % 5 WHEN 8 THEN '.' || k WHEN 9 THEN k || '.'
WHEN 10 THEN k || 'd' WHEN 11 THEN 'z' || k WHEN 12 THEN k || 'e' WHEN 13 THEN '' ELSE '' || k END AS x FROM (SELECT o_orderkey, o_orderkey * 104729 % 1000003 AS k FROM orders) AS numbers"""
PERCENTS = """SELECT o_orderkey, CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '' || k WHEN 2 THEN k || '.' || f || '%' WHEN 3 THEN k || '.0' || f || '%' WHEN 4 THEN '-' || k || '%' WHEN 5 THEN k || '.%' WHEN 6 THEN '1' || k || '00%' WHEN 7 THEN '%' WHEN 8 THEN k || ',5%' ELSE k || '%' END AS x
FROM (SELECT o_orderkey, o_orderkey * 31 % 101 AS k, o_orderkey * 17 % 997 AS f FROM orders) AS shares"""
SHARES = "SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey * 7919 % 1401 - 200 AS DOUBLE) / 1000 END AS x FROM orders"
PAIRS = "SELECT o_orderkey, o_orderkey * 7919 % 200003 - 50000 AS a, o_orderkey * 104729 % 401 * (o_orderkey % 3) AS b FROM orders"


def _read(spark, sf_dir, sql: str):
    return select_from(spark, sf_dir, sql, "orders")


@query("ts_from_seconds", f"SELECT o_orderkey, x, CAST(x AS DOUBLE) AS seconds, x = 0 AS is_zero FROM ({SECONDS})")
def ts_from_seconds(spark, sf_dir):
    d = duration.from_seconds(F.col("x"))
    return _read(spark, sf_dir, SECONDS).select("o_orderkey", "x", duration.to_seconds(d).cast("double").alias("seconds"), (d == F.expr("INTERVAL '0' SECOND")).alias("is_zero"))


@query("ts_minutes", f"SELECT o_orderkey, round(x / 60.0 + 0.25 / 60, 6) AS minutes, round(x / 60.0 + 0.5 / 60, 6) AS legacy_minutes FROM ({SECONDS})")
def ts_minutes(spark, sf_dir):
    d = duration.from_seconds(F.col("x") + F.lit(0.25))
    return _read(spark, sf_dir, SECONDS).select("o_orderkey", F.round(duration.to_minutes(d), 6).alias("minutes"), F.round(duration.to_minutes(d, legacy=True), 6).alias("legacy_minutes"))


@query("ts_parse", f"""SELECT o_orderkey, x, CASE WHEN regexp_full_match(x, '[0-9]{{1,2}}:[0-9]{{1,2}}:[0-9]{{1,2}}') AND CAST(split_part(x, ':', 1) AS INT) < 24 AND CAST(split_part(x, ':', 2) AS INT) < 60 AND CAST(split_part(x, ':', 3) AS INT) < 60
THEN CAST(CAST(split_part(x, ':', 1) AS INT) * 3600 + CAST(split_part(x, ':', 2) AS INT) * 60 + CAST(split_part(x, ':', 3) AS INT) AS DOUBLE) END AS seconds FROM ({CLOCKS})""")
def ts_parse(spark, sf_dir):
    return _read(spark, sf_dir, CLOCKS).select("o_orderkey", "x", duration.to_seconds(duration.parse(F.col("x"))).cast("double").alias("seconds"))


@query("ts_parse_int", f"SELECT o_orderkey, x, CAST(CASE WHEN x BETWEEN 1 AND 86400 THEN x END AS DOUBLE) AS seconds FROM ({SECONDS})")
def ts_parse_int(spark, sf_dir):
    return _read(spark, sf_dir, SECONDS).select("o_orderkey", "x", duration.to_seconds(duration.parse_seconds(F.col("x"))).cast("double").alias("seconds"))


_SPECS = ("d", "0", "1", "2", "3", "4", "5", "1n", "5n")
_MICROS = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey * 7919 % 300007 * 1000000 ELSE o_orderkey * 7919123457 % 300000000007 END AS us FROM orders"
_SPEC_SQL = f"""WITH v AS ({_MICROS}), s AS (SELECT * FROM (VALUES ('d', 0, false), ('0', 0, false), ('1', 1, false), ('2', 2, false), ('3', 3, false), ('4', 4, false), ('5', 5, false), ('1n', 1, true), ('5n', 5, true)) AS t(spec, n, skip)),
r AS (SELECT o_orderkey, spec, n, skip AND us % 1000000 = 0 AS bare, CASE WHEN n = 0 THEN us // 1000000 * 1000000 ELSE CAST(round_even(us / pow(10, 6 - n), 0) * pow(10, 6 - n) AS BIGINT) END AS us FROM v, s),
c AS (SELECT *, us // 86400000000 AS days, us // 1000000 % 86400 AS rest, us % 1000000 AS micros FROM r)
SELECT o_orderkey, spec, CASE WHEN days > 0 THEN days || CASE WHEN days = 1 THEN ' day, ' ELSE ' days, ' END ELSE '' END || printf('%d:%02d:%02d', rest // 3600, rest // 60 % 60, rest % 60) || CASE WHEN n = 0 OR bare THEN '' ELSE '.' || substr(lpad(CAST(micros AS VARCHAR), 6, '0'), 1, n) END AS shown FROM c"""


@query("ts_format", _SPEC_SQL)
def ts_format(spark, sf_dir):
    rows = _read(spark, sf_dir, _MICROS).select("o_orderkey", (F.col("us").cast("decimal(20,6)") / 1_000_000).alias("s"))
    shown = F.array(*(F.struct(F.lit(s).alias("spec"), duration.formatted(duration.from_seconds(F.col("s")), s).alias("shown")) for s in _SPECS))
    return rows.select("o_orderkey", F.explode(shown).alias("x")).select("o_orderkey", "x.spec", "x.shown")


@query("ts_compare", f"SELECT o_orderkey, a < b AS lt, a <= b AS le, a > b AS gt, a >= b AS ge, a = b AS eq, a <> b AS ne FROM ({PAIRS})")
def ts_compare(spark, sf_dir):
    a, b = duration.from_seconds(F.col("a")), duration.from_seconds(F.col("b"))
    tests = {"lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b, "eq": a == b, "ne": a != b}
    return _read(spark, sf_dir, PAIRS).select("o_orderkey", *(c.alias(k) for k, c in tests.items()))


@query("ts_arith", f"SELECT o_orderkey, CAST(a + b AS DOUBLE) AS plus, CAST(a - b AS DOUBLE) AS minus, CAST(a - 1 AS DOUBLE) AS minus_minutes, CAST(abs(a) AS DOUBLE) AS positive FROM ({PAIRS})")
def ts_arith(spark, sf_dir):
    a, b = duration.from_seconds(F.col("a")), duration.from_seconds(F.col("b"))
    parts = {"plus": a + b, "minus": a - b, "minus_minutes": duration.minus_minutes(a, F.lit(1) / 60), "positive": duration.absolute(a)}
    return _read(spark, sf_dir, PAIRS).select("o_orderkey", *(duration.to_seconds(c).cast("double").alias(k) for k, c in parts.items()))


@query("ts_ratio", f"SELECT o_orderkey, CAST(a AS DOUBLE) / nullif(b, 0) AS ratio FROM ({PAIRS})")
def ts_ratio(spark, sf_dir):
    a, b = duration.from_seconds(F.col("a")), duration.from_seconds(F.col("b"))
    return _read(spark, sf_dir, PAIRS).select("o_orderkey", duration.ratio(a, b).alias("ratio"))


@query("parse_int", f"SELECT o_orderkey, x, CASE WHEN regexp_full_match(x, '[+-]?[0-9]+') THEN CAST(CAST(x AS DECIMAL(38,0)) AS VARCHAR) END AS value FROM ({INTS})")
def parse_int(spark, sf_dir):
    return _read(spark, sf_dir, INTS).select("o_orderkey", "x", numeric.parse_int(F.col("x")).cast("string").alias("value"))


@query("parse_float", f"SELECT o_orderkey, x, CASE WHEN regexp_full_match(x, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(x AS DOUBLE) END AS value FROM ({FLOATS})")
def parse_float(spark, sf_dir):
    return _read(spark, sf_dir, FLOATS).select("o_orderkey", "x", numeric.parse_float(F.col("x")).alias("value"))


@query("pct_valid", f"SELECT o_orderkey, x BETWEEN 0 AND 1 AS valid FROM ({SHARES})")
def pct_valid(spark, sf_dir):
    return _read(spark, sf_dir, SHARES).select("o_orderkey", numeric.is_percentage(F.col("x")).alias("valid"))


_PCT = r"regexp_extract(x, '^([0-9]{{1,3}})(\.([0-9]+))?%$', {})"


@query("pct_parse", f"""SELECT o_orderkey, x, round((CAST(whole AS DOUBLE) + coalesce(CAST(nullif(frac, '') AS DOUBLE), 0) / pow(10, length(frac))) / 100, 9) AS value, round((CAST(whole AS DOUBLE) + coalesce(CAST(nullif(frac, '') AS DOUBLE), 0) / 100) / 100, 9) AS legacy
FROM (SELECT o_orderkey, x, nullif({_PCT.format(1)}, '') AS whole, {_PCT.format(3)} AS frac FROM ({PERCENTS}))""")
def pct_parse(spark, sf_dir):
    value, legacy = numeric.parse_percent(F.col("x")), numeric.parse_percent(F.col("x"), legacy=True)
    return _read(spark, sf_dir, PERCENTS).select("o_orderkey", "x", F.round(value, 9).alias("value"), F.round(legacy, 9).alias("legacy"))


@query("pct_format", f"SELECT o_orderkey, printf('%.2f%%', x * 100) AS shown FROM ({SHARES}) WHERE x IS NOT NULL")
def pct_format(spark, sf_dir):
    return _read(spark, sf_dir, SHARES).where("x IS NOT NULL").select("o_orderkey", numeric.format_percent(F.col("x")).alias("shown"))


@query("pct_compare", f"SELECT o_orderkey, x < 0.5 AS lt, x <= 0.5 AS le, x > 0.5 AS gt, x >= 0.5 AS ge, x = 0.5 AS eq FROM ({SHARES})")
def pct_compare(spark, sf_dir):
    x, half = F.col("x"), numeric.parse_percent(F.lit("50%"))
    return _read(spark, sf_dir, SHARES).select("o_orderkey", (x < half).alias("lt"), (x <= half).alias("le"), (x > half).alias("gt"), (x >= half).alias("ge"), (x == half).alias("eq"))
