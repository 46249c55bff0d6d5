"""Queries over device inventories, PCI addresses and the memory model."""

from __future__ import annotations

from pyspark.sql import functions as F

from babelshelf.catalog import query
from babelshelf.functions import names, numeric
from babelshelf.operators import calibration, devices
from babelshelf.plans.lenses import select_from, table

_DEVICES = """devices AS (SELECT p_partkey AS ord, p_name AS name, 'id' || p_partkey % 500 AS unique_id, CASE CAST(right(p_brand, 1) AS INTEGER) % 3 WHEN 0 THEN 'nvidia' WHEN 1 THEN 'amd' ELSE 'intel' END AS vendor,
CASE WHEN p_size % 4 = 0 THEN 'integrated' ELSE 'dedicated' END AS type, CASE WHEN p_partkey % 11 <> 0 THEN p_partkey END AS memory_amount, CASE WHEN p_partkey % 13 <> 0 THEN p_size END AS num_compute_units, CAST(p_partkey % 3 + 1 AS INTEGER) AS priority FROM part)"""


def _devices(spark, sf_dir):
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    vendor = F.element_at(F.array(F.lit("nvidia"), F.lit("amd"), F.lit("intel")), F.substring("p_brand", -1, 1).cast("int") % 3 + 1)
    return part.select(
        key.alias("ord"), F.col("p_name").alias("name"), F.concat(F.lit("id"), key % 500).alias("unique_id"), vendor.alias("vendor"), F.when(F.col("p_size") % 4 == 0, "integrated").otherwise("dedicated").alias("type"),
        F.when(key % 11 != 0, key).alias("memory_amount"), F.when(key % 13 != 0, F.col("p_size")).alias("num_compute_units"), (key % 3 + 1).cast("int").alias("priority"),
    )


@query("device_vendor", "SELECT p_partkey AS ord, CASE WHEN contains(lower(line), 'nvidia') THEN 'nvidia' WHEN contains(lower(line), 'amd') THEN 'amd' WHEN contains(lower(line), 'intel') THEN 'intel' END AS vendor FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '00:02.0 VGA: Intel ' WHEN 1 THEN 'VGA: AMD/Intel ' WHEN 2 THEN 'NVIDIA Corp ' WHEN 3 THEN '3D: AMD ' ELSE 'VGA: other ' END || p_name AS line FROM part)")
def device_vendor(spark, sf_dir):
    kinds = F.array(*(F.lit(x) for x in ("00:02.0 VGA: Intel ", "VGA: AMD/Intel ", "NVIDIA Corp ", "3D: AMD ", "VGA: other ")))
    line = F.concat(F.element_at(kinds, (F.col("p_partkey") % 5 + 1).cast("int")), "p_name")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), names.vendor(line).alias("vendor"))


@query("device_listing", """WITH l AS (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'VGA compatible controller [0300]: Intel ' WHEN 1 THEN '3D controller [0302]: NVIDIA Corporation ' WHEN 2 THEN 'VGA compatible controller [0300]: AMD/ATI APU ' WHEN 3 THEN 'Audio device [0403]: NVIDIA Corporation ' WHEN 4 THEN 'VGA compatible controller [0300]: other ' ELSE '3D controller [0302]: ATI ' END || p_name AS rest FROM part)
SELECT printf('%02x:%02x.0', k // 32, k % 32) AS unique_id, rest AS name, CASE WHEN contains(rest, 'NVIDIA') THEN 'nvidia' WHEN contains(rest, 'AMD') OR contains(rest, 'ATI') THEN 'amd' ELSE 'intel' END AS vendor, CASE WHEN contains(rest, 'APU') THEN 'integrated' ELSE 'dedicated' END AS type, 'lspci' AS origin
FROM l WHERE (contains(rest, 'VGA compatible controller') OR contains(rest, '3D controller')) AND (contains(rest, 'NVIDIA') OR contains(rest, 'AMD') OR contains(rest, 'ATI') OR contains(rest, 'Intel'))""")
def device_listing(spark, sf_dir):
    """The lines of a PCI listing, one a part."""
    key = F.col("p_partkey")
    kinds = ("VGA compatible controller [0300]: Intel ", "3D controller [0302]: NVIDIA Corporation ", "VGA compatible controller [0300]: AMD/ATI APU ", "Audio device [0403]: NVIDIA Corporation ", "VGA compatible controller [0300]: other ", "3D controller [0302]: ATI ")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (key % len(kinds) + 1).cast("int"))
    lines = table(spark, sf_dir, "part").select(F.concat(F.format_string("%02x:%02x.0 ", F.floor(key / 32), key % 32), kind, "p_name").alias("value"))
    return devices.listed(lines)


@query("device_union", f"WITH {_DEVICES} SELECT vendor, count(*) AS n, count(memory_amount) AS with_memory FROM devices GROUP BY vendor")
def device_union(spark, sf_dir):
    rows = _devices(spark, sf_dir)
    both = devices.united([rows.where(F.col("vendor") == v) for v in names.VENDORS])
    return both.groupBy("vendor").agg(F.count("*").alias("n"), F.count("memory_amount").alias("with_memory"))


@query("device_fallback", f"WITH {_DEVICES}, p AS (SELECT * FROM devices WHERE ord % 3 <> 0) SELECT ord, priority FROM p WHERE priority = (SELECT min(priority) FROM p)")
def device_fallback(spark, sf_dir):
    return devices.fallback(_devices(spark, sf_dir).where("ord % 3 <> 0")).select("ord", "priority")


@query("device_dedup", f"WITH {_DEVICES} SELECT ord, unique_id, name FROM (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ord) AS k FROM devices) WHERE k = 1")
def device_dedup(spark, sf_dir):
    return devices.deduplicated(_devices(spark, sf_dir)).select("ord", "unique_id", "name")


@query("device_best", f"WITH {_DEVICES} SELECT unique_id, num_compute_units, memory_amount FROM devices WHERE type <> 'integrated' ORDER BY coalesce(num_compute_units, 0) DESC, coalesce(memory_amount, 0) DESC, unique_id LIMIT 1")
def device_best(spark, sf_dir):
    return devices.best(_devices(spark, sf_dir)).select("unique_id", "num_compute_units", "memory_amount")


@query("device_match", f"WITH {_DEVICES}, r AS (SELECT 'id' || s_suppkey % 400 AS unique_id, min(s_suppkey) AS index, count(*) AS n FROM supplier GROUP BY 1) SELECT d.ord, r.index, coalesce(r.n, 0) AS n_matches FROM devices d LEFT JOIN r ON d.unique_id = r.unique_id")
def device_match(spark, sf_dir):
    runtime = table(spark, sf_dir, "supplier").select(F.concat(F.lit("id"), F.col("s_suppkey") % 400).alias("unique_id"), F.col("s_suppkey").alias("index"))
    return devices.matched(_devices(spark, sf_dir), runtime, ["unique_id"]).select("ord", "index", "n_matches")


@query("pci_unpack", "SELECT l_orderkey * 65536 + l_partkey AS bdf, (l_orderkey * 65536 + l_partkey) & 7 AS function, ((l_orderkey * 65536 + l_partkey) >> 3) & 31 AS device, ((l_orderkey * 65536 + l_partkey) >> 8) & 255 AS bus, (l_orderkey * 65536 + l_partkey) >> 16 AS domain FROM lineitem")
def pci_unpack(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 65536 + F.col("l_partkey")).alias("bdf"))
    return rows.select("bdf", *numeric.pci_fields(F.col("bdf")))


@query("pci_format", "SELECT p_partkey AS ord, lpad(lower(to_hex(p_partkey // 1000)), 4, '0') || ':' || lpad(lower(to_hex(p_partkey % 256)), 2, '0') || ':' || lpad(lower(to_hex(p_partkey % 32)), 2, '0') || '.' || lower(to_hex(p_partkey % 8)) AS topology FROM part")
def pci_format(spark, sf_dir):
    key = F.col("p_partkey")
    text = numeric.format_pci(F.floor(key / 1000).cast("long"), key % 256, key % 32, key % 8)
    return table(spark, sf_dir, "part").select(key.alias("ord"), text.alias("topology"))


_TOPOLOGIES = """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN a || ':' || b || ':' || c WHEN 2 THEN a || ':' || b WHEN 3 THEN upper(a || ':' || b || ':' || c || '.' || d) WHEN 4 THEN a || ':' || b || ':' || c || '.' WHEN 5 THEN 'g' || a || ':' || b || ':' || c WHEN 6 THEN a || ':' || b || ':' || c || ':' || d
WHEN 7 THEN '0000:' || b || ':' || c || '.' || d ELSE a || ':' || b || ':' || c || '.' || d END AS topology FROM (SELECT p_partkey, lower(hex(p_partkey * 31 % 4096)) AS a, lower(hex(p_partkey % 256)) AS b, lower(hex(p_partkey % 32)) AS c, lower(hex(p_partkey % 8)) AS d FROM part) AS parts"""
_HEX = "CAST(nullif('0x' || regexp_extract(topology, '^([0-9a-fA-F]+):([0-9a-fA-F]+):([0-9a-fA-F]+)(\\.([0-9a-fA-F]+))?$', {}), '0x') AS BIGINT)"


@query("pci_parse", f"SELECT p_partkey AS ord, {_HEX.format(1)} AS domain, {_HEX.format(2)} AS bus, {_HEX.format(3)} AS device, CASE WHEN {_HEX.format(1)} IS NOT NULL THEN coalesce({_HEX.format(5)}, 0) END AS function FROM ({_TOPOLOGIES})")
def pci_parse(spark, sf_dir):
    rows = select_from(spark, sf_dir, _TOPOLOGIES, "part")
    return rows.select(F.col("p_partkey").alias("ord"), *numeric.parse_pci(F.col("topology")))


_SAMPLES = "samples AS (SELECT l_returnflag AS k, l_quantity AS x, l_extendedprice AS y FROM lineitem)"


def _samples(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))


@query("calibrate_linear", f"WITH {_SAMPLES} SELECT k, round(regr_slope(y, x), 4) AS m, round(regr_intercept(y, x), 3) AS c FROM samples GROUP BY k")
def calibrate_linear(spark, sf_dir):
    return calibration.linear(_samples(spark, sf_dir), "k").select("k", F.round("m", 4).alias("m"), F.round("c", 3).alias("c"))


@query("calibrate_residual", f"""WITH {_SAMPLES}, m AS (SELECT k, avg(x) AS mx, avg(y) AS my FROM samples GROUP BY k), u AS (SELECT s.k, s.x, s.y, mx, my, x - mx AS u, y - my AS v FROM samples s JOIN m ON s.k = m.k),
s AS (SELECT k, mx, my, count(*) AS n, sum(u*u) AS s2, sum(u*u*u) AS s3, sum(u*u*u*u) AS s4, sum(u*v) AS t1, sum(u*u*v) AS t2 FROM u GROUP BY ALL),
q AS (SELECT *, (s2*t2 - s3*t1) / (s2*s4 - s3*s3 - s2*s2*s2/n) AS a, (t1*(s4 - s2*s2/n) - s3*t2) / (s2*s4 - s3*s3 - s2*s2*s2/n) AS b FROM s),
r AS (SELECT u.k, 1 AS degree, avg((y - (q.my + q.t1/q.s2 * u)) / y) AS residual FROM u JOIN q ON u.k = q.k GROUP BY u.k UNION ALL SELECT u.k, 2, avg((y - (q.my - q.a*q.s2/q.n + q.b*u + q.a*u*u)) / y) FROM u JOIN q ON u.k = q.k GROUP BY u.k)
SELECT k, CAST(degree AS INTEGER) AS degree, round(residual, 5) AS residual, abs(residual) <= 0.05 AS accepted, CAST(row_number() OVER (PARTITION BY k ORDER BY abs(round(residual, 9)), degree) AS INTEGER) AS place FROM r""")
def calibrate_residual(spark, sf_dir):
    rows = _samples(spark, sf_dir)
    one = calibration.linear(rows, "k").select("k", F.lit(1).alias("degree"), "c", F.col("m").alias("b"), F.lit(0.0).alias("a"))
    two = calibration.quadratic(rows, "k").select("k", F.lit(2).alias("degree"), "c", "b", "a")
    return calibration.residuals(rows, one.unionByName(two), "k").select("k", "degree", F.round("residual", 5).alias("residual"), "accepted", "place")


@query("mem_linear", "SELECT l_orderkey, l_linenumber, round(CASE WHEN (l_extendedprice - 5000) / 12.5 >= 0 THEN (l_extendedprice - 5000) / 12.5 END, 6) AS seconds FROM lineitem")
def mem_linear(spark, sf_dir):
    seconds = numeric.linear_seconds(F.col("l_extendedprice"), F.lit(5000.0), F.lit(12.5))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(seconds, 6).alias("seconds"))


@query("mem_quadratic", "SELECT l_orderkey, l_linenumber, round(CASE WHEN d >= 0 AND (-30 + sqrt(greatest(d, 0))) / 4 >= 0 THEN (-30 + sqrt(greatest(d, 0))) / 4 END, 6) AS seconds FROM (SELECT l_orderkey, l_linenumber, 900 - 8 * (5000 - l_extendedprice) AS d FROM lineitem)")
def mem_quadratic(spark, sf_dir):
    seconds = numeric.quadratic_seconds(F.col("l_extendedprice"), F.lit(5000.0), F.lit(30.0), F.lit(2.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(seconds, 6).alias("seconds"))


@query("segment_budget", "SELECT o_orderkey, round(CASE WHEN ours >= 0 AND (round_even(ours * 0.9, 0) - 1000) / 12.5 >= 0 THEN (round_even(ours * 0.9, 0) - 1000) / 12.5 END, 6) AS seconds FROM (SELECT o_orderkey, round_even(CAST(500000 AS DOUBLE) * 0.95, 0) - (500000 - o_totalprice) AS ours FROM orders)")
def segment_budget(spark, sf_dir):
    usable = numeric.usable_memory(F.lit(500000.0), F.col("o_totalprice"))
    seconds = numeric.linear_seconds(usable, F.lit(1000.0), F.lit(12.5))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(seconds, 6).alias("seconds"))


@query("batch_shrink", "SELECT p_partkey AS ord, round(p_size * pow(0.925, p_partkey % 11), 6) AS amount, round(least(0.1 * pow(1.075, p_partkey % 40), 1.0), 6) AS keep_free FROM part")
def batch_shrink(spark, sf_dir):
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.alias("ord"), F.round(numeric.shrunk(F.col("p_size"), key % 11), 6).alias("amount"), F.round(numeric.grown_reserve(F.lit(0.1), key % 40), 6).alias("keep_free"))
