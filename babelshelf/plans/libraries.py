"""Queries over hierarchies, snapshots, summaries, quotas and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from babelshelf.catalog import query
from babelshelf.operators import gaps, lookup, nesting, ordering, quota, rescan, retries, summary
from babelshelf.plans import lenses
from babelshelf.plans.lenses import FILES, HIERARCHY, SNAPSHOTS, table

_WITH = f"WITH {HIERARCHY} "


@query("summary_language", _WITH + "SELECT language, count(*) AS n FROM hierarchy GROUP BY language")
def summary_language(spark, sf_dir):
    return summary.by_language(lenses.hierarchy(spark, sf_dir))


@query("summary_rollup", _WITH + """SELECT collection, series, season, language, CASE WHEN grouping(collection) = 1 THEN 'total' WHEN grouping(series) = 1 THEN 'collection' WHEN grouping(season) = 1 THEN 'series' ELSE 'season' END AS level, count(*) AS n
FROM hierarchy GROUP BY GROUPING SETS ((collection, series, season, language), (collection, series, language), (collection, language), (language))""")
def summary_rollup(spark, sf_dir):
    return summary.rolled_up(lenses.hierarchy(spark, sf_dir))


@query("summary_total", _WITH + "SELECT count(*) AS episodes, count(DISTINCT language) AS languages, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'skipped') AS skipped FROM hierarchy")
def summary_total(spark, sf_dir):
    rows = lenses.hierarchy(spark, sf_dir).groupBy("language", "status").agg(F.count("*").alias("n"))
    return rows.agg(F.sum("n").alias("episodes"), F.countDistinct("language").alias("languages"), *(F.sum(F.when(F.col("status") == s, F.col("n")).otherwise(0)).alias(s) for s in summary.STATUSES))


@query("summary_metadata", f"WITH {HIERARCHY}" + """, e AS (SELECT *, CASE status WHEN 'missing' THEN 2 WHEN 'skipped' THEN 1 ELSE 0 END AS r FROM hierarchy),
s AS (SELECT collection, series, season, max(r) AS r FROM e GROUP BY ALL), t AS (SELECT collection, series, max(r) AS r FROM s GROUP BY ALL),
k AS (SELECT 'episode' AS kind, r FROM e UNION ALL SELECT 'season', r FROM s UNION ALL SELECT 'series', r FROM t)
SELECT kind, count(*) FILTER (r = 0) AS ok, count(*) FILTER (r = 2) AS missing, count(*) FILTER (r = 1) AS skipped FROM k GROUP BY kind""")
def summary_metadata(spark, sf_dir):
    return summary.metadata_counts(summary.entities(lenses.hierarchy(spark, sf_dir)))


@query("summary_descriptions", _WITH + "SELECT collection, series, season, count(*) AS n, min(episode) AS first_episode, max(episode) AS last_episode, string_agg(CAST(episode AS VARCHAR), ',' ORDER BY episode) AS episodes FROM hierarchy GROUP BY ALL")
def summary_descriptions(spark, sf_dir):
    found = F.sort_array(F.collect_list("episode"))
    rows = lenses.hierarchy(spark, sf_dir).groupBy("collection", "series", "season")
    return rows.agg(F.count("*").alias("n"), F.min("episode").alias("first_episode"), F.max("episode").alias("last_episode"), F.array_join(F.transform(found, lambda x: x.cast("string")), ",").alias("episodes"))


@query("scan_summary", _WITH + "SELECT true AS success, count(*) FILTER (status = 'ok') AS n FROM hierarchy UNION ALL SELECT false, count(*) FILTER (status <> 'ok') FROM hierarchy")
def scan_summary(spark, sf_dir):
    return summary.outcomes(lenses.hierarchy(spark, sf_dir).withColumn("ok", F.col("status") == "ok"))


@query("scan_summary_detailed", _WITH + "SELECT status = 'ok' AS success, CASE WHEN status = 'ok' THEN language ELSE status || ' (best: ' || language || ')' END AS key, count(*) AS n FROM hierarchy GROUP BY ALL")
def scan_summary_detailed(spark, sf_dir):
    reason = F.format_string("%s (best: %s)", "status", "language")
    return summary.detailed_outcomes(lenses.hierarchy(spark, sf_dir).withColumn("ok", F.col("status") == "ok").withColumn("reason", reason))


@query("hierarchy_levels", f"WITH {FILES} SELECT 'folder' AS kind, 1 AS depth, count(DISTINCT source) AS n FROM files UNION ALL SELECT 'file', 2, count(DISTINCT path) FROM files")
def hierarchy_levels(spark, sf_dir):
    return nesting.levels(lenses.files(spark, sf_dir)).groupBy("kind", "depth").agg(F.count("*").alias("n"))


@query("scan_counts", f"WITH {FILES} SELECT source AS folder, count(*) AS total, count(*) FILTER (lang IN ('en', 'de')) AS processing, count(*) FILTER (lang NOT IN ('en', 'de')) AS ignored FROM files GROUP BY source")
def scan_counts(spark, sf_dir):
    from babelshelf.functions import names

    ignored = names.is_ignored(names.base_name(F.col("path")), F.lit("file"), ["en", "de"], [])
    return lenses.files(spark, sf_dir).groupBy(F.col("source").alias("folder")).agg(F.count("*").alias("total"), F.count_if(~ignored).alias("processing"), F.count_if(ignored).alias("ignored"))


@query("file_checksum", f"WITH {FILES} SELECT path, checksum, mtime FROM files")
def file_checksum(spark, sf_dir):
    return lenses.files(spark, sf_dir).select("path", "checksum", "mtime")


@query("scanned_file", f"WITH {FILES} SELECT path, source AS parent, CAST(1 AS INTEGER) AS n_parents, 'file' AS type, CAST(NULL AS VARCHAR) AS checksum, mtime FROM files")
def scanned_file(spark, sf_dir):
    parents = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    rows = lenses.files(spark, sf_dir).withColumn("parents", parents)
    checked = rows.withColumn("parents", F.when(F.size("parents") <= nesting.MAX_PARENTS, F.col("parents")).otherwise(F.raise_error(F.concat(F.lit("more than 3 parents: "), "path"))))
    return checked.select("path", F.element_at("parents", -1).alias("parent"), F.size("parents").alias("n_parents"), F.lit("file").alias("type"), F.lit(None).cast("string").alias("checksum"), "mtime")


@query("rejects", f"WITH {FILES} SELECT path, 'unsupported extension: ' || lang AS reason FROM files WHERE lang NOT IN ('en', 'de', 'fr')")
def rejects(spark, sf_dir):
    from babelshelf.functions import names

    ext = names.suffix(names.base_name(F.col("path")))
    return lenses.files(spark, sf_dir).where(~ext.isin("en", "de", "fr")).select("path", F.concat(F.lit("unsupported extension: "), ext).alias("reason"))


@query("scan_order", f"WITH {FILES} SELECT path, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id || '.' || lang) - 1 AS INTEGER) AS position FROM files")
def scan_order(spark, sf_dir):
    rows = lenses.files(spark, sf_dir).select("path", "source", F.split("path", "/").alias("parts"))  # paths are ordered by their parts
    return ordering.numbered(rows, ["source"], ["parts"]).select("path", F.col("position").cast("int").alias("position"))


@query("rescan_matched", f"WITH {SNAPSHOTS} SELECT w.path, w.mtime, s.mtime AS old_mtime, s.path IS NOT NULL AS known FROM walked w LEFT JOIN snapshot s ON w.path = s.path")
def rescan_matched(spark, sf_dir):
    return rescan.matched(*lenses.snapshots(spark, sf_dir)).select("path", "mtime", "old_mtime", F.col("old_mtime").isNotNull().alias("known"))


@query("rescan_deleted", f"WITH {SNAPSHOTS} SELECT path, checksum FROM snapshot s WHERE NOT EXISTS (SELECT 1 FROM walked w WHERE w.path = s.path)")
def rescan_deleted(spark, sf_dir):
    return rescan.deleted(*lenses.snapshots(spark, sf_dir)).select("path", "checksum")


@query("rescan_inserted", f"WITH {SNAPSHOTS} SELECT path, checksum FROM walked w WHERE NOT EXISTS (SELECT 1 FROM snapshot s WHERE w.path = s.path)")
def rescan_inserted(spark, sf_dir):
    return rescan.inserted(*lenses.snapshots(spark, sf_dir)).select("path", "checksum")


@query("rescan_merged", f"WITH {SNAPSHOTS} SELECT w.path, w.checksum, w.mtime, CASE WHEN s.path IS NULL THEN 'new' ELSE 'kept' END AS origin FROM walked w LEFT JOIN snapshot s ON w.path = s.path")
def rescan_merged(spark, sf_dir):
    return rescan.merged(*lenses.snapshots(spark, sf_dir)).select("path", "checksum", "mtime", "origin")


@query("rescan_outdated", f"WITH {SNAPSHOTS} SELECT w.path, w.mtime > s.mtime AND w.checksum <> s.checksum AS outdated, greatest(w.mtime, s.mtime) AS mtime FROM walked w JOIN snapshot s ON w.path = s.path")
def rescan_outdated(spark, sf_dir):
    rows = rescan.matched(*lenses.snapshots(spark, sf_dir)).where("old_mtime IS NOT NULL")
    old = rescan.outdated(F.col("old_mtime"), F.col("mtime"), F.col("old_checksum"), F.col("checksum"))
    return rows.select("path", old.alias("outdated"), F.greatest("mtime", "old_mtime").alias("mtime"))


@query("rescan_plan", f"""WITH {SNAPSHOTS}, m AS (SELECT w.doc_id, w.path, w.mtime > s.mtime AND w.checksum <> s.checksum AS outdated FROM walked w JOIN snapshot s ON w.path = s.path)
SELECT m.path, outdated AS do_checksum, outdated OR m.doc_id % 7 = 0 AS do_language, l.doc_id IS NULL AS do_metadata FROM m LEFT JOIN labels l ON m.doc_id = l.doc_id""")
def rescan_plan(spark, sf_dir):
    rows = rescan.matched(*lenses.snapshots(spark, sf_dir)).where("old_mtime IS NOT NULL")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("has"))
    found = rows.withColumn("outdated", rescan.outdated(F.col("old_mtime"), F.col("mtime"), F.col("old_checksum"), F.col("checksum"))).join(labels, "doc_id", "left")
    return rescan.plan(found.withColumns({"language_default": F.col("doc_id") % 7 == 0, "metadata_missing": F.col("has").isNull()})).select("path", "do_checksum", "do_language", "do_metadata")


@query("quota_scan", """WITH e AS (SELECT conv_id, turn, role, length(text) % 2 = 0 AS eligible FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS position FROM e WHERE eligible AND role IN ('user', 'assistant'))
SELECT role, conv_id, turn, CAST(position AS INTEGER) AS position FROM n WHERE position BETWEEN 10 AND 109""")
def quota_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    found = quota.within_quota(rows, "role", ["conv_id", "turn"], 10, 100, F.length("text") % 2 == 0, ["user", "assistant"])
    return found.select("role", "conv_id", "turn", "position")


_NUMBERED = "numbered AS (SELECT c_custkey AS season, (o_orderkey * 7 + o_custkey) % 31 AS number FROM orders JOIN customer ON o_custkey = c_custkey)"


def _numbered(spark, sf_dir):
    """(season, number): orders as episodes of their customer's season, some with a number that others have, too."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("season"), ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 31).alias("number"))


@query("summary_gaps", f"""WITH {_NUMBERED}, known AS (SELECT DISTINCT season, number FROM numbered WHERE number >= 1), ends AS (SELECT season, max(number) AS last FROM known GROUP BY season),
lacks AS (SELECT season, number FROM (SELECT season, unnest(range(1, last)) AS number FROM ends) ANTI JOIN known USING (season, number)),
islands AS (SELECT season, number, number - row_number() OVER (PARTITION BY season ORDER BY number) AS island FROM lacks)
SELECT season, false AS complete, min(number) AS first_missing, max(number) AS last_missing, count(*) AS n FROM islands GROUP BY season, island
UNION ALL SELECT season, true, NULL, NULL, 0 FROM ends WHERE season NOT IN (SELECT season FROM lacks)""")
def summary_gaps(spark, sf_dir):
    return gaps.missing(_numbered(spark, sf_dir), ["season"], "number")


@query("summary_duplicates", f"WITH {_NUMBERED}, n AS (SELECT season, number, count(*) OVER (PARTITION BY season, number) AS copies FROM numbered WHERE number >= 1) SELECT DISTINCT season, number, copies FROM n WHERE copies > 1")
def summary_duplicates(spark, sf_dir):
    return gaps.duplicates(_numbered(spark, sf_dir), ["season"], "number")


@query("rescan_moved", f"""WITH {FILES}, walked AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'moved/' || path ELSE path END AS path, checksum FROM files WHERE doc_id % 10 <> 1), gone AS (SELECT path, checksum FROM files WHERE path NOT IN (SELECT path FROM walked)), came AS (SELECT path, checksum FROM walked WHERE path NOT IN (SELECT path FROM files)),
old AS (SELECT path AS old_path, checksum, (SELECT count(*) FROM gone h WHERE h.checksum = g.checksum AND h.path < g.path) AS k FROM gone g), new AS (SELECT path, checksum, (SELECT count(*) FROM came h WHERE h.checksum = g.checksum AND h.path < g.path) AS k FROM came g)
SELECT old_path, path, checksum FROM old JOIN new USING (checksum, k)""")
def rescan_moved(spark, sf_dir):
    """Every fourth file in another folder, one in ten deleted; copies have equal checksums."""
    saved = lenses.files(spark, sf_dir).select("doc_id", "path", "checksum", "mtime")
    path = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    return rescan.moved(saved, saved.where("doc_id % 10 <> 1").withColumn("path", path))


@query("quota_stream", """WITH n AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS position FROM conversations WHERE length(text) % 3 <> 0)
SELECT role, conv_id, turn, position FROM n WHERE role = 'user' AND position BETWEEN 5 AND 64 OR role = 'assistant' AND position < 40""")
def quota_stream(spark, sf_dir):
    """The quotas by a stream over the table's folder, run to its end."""
    from babelshelf.storage import shared_path
    from babelshelf.streaming import quota as arriving

    path = f"{sf_dir}/conversations.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]").where("length(text) % 3 <> 0")
    found = arriving.counted(rows.select("role", "conv_id", "turn"), "role", ["conv_id", "turn"], {"user": (5, 60), "assistant": (0, 40)})
    folder = shared_path(spark, "quota")
    arriving.run_to_end(found, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(found.schema).parquet(f"{folder}/out").select("role", "conv_id", "turn", "position")


_PROVIDED = "provided AS (SELECT d.doc_id, d.source, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN l.toxic = 1 THEN 'skipped' ELSE 'ok' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def _provided(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("found"), (F.col("toxic") == 1).alias("skipped"))
    rows = lookup.enriched(table(spark, sf_dir, "documents").select("doc_id", "source"), labels, ["doc_id"])
    return rows.select("doc_id", "source", lookup.status().alias("status"))


@query("metadata_needed", f"WITH {_PROVIDED} SELECT doc_id, doc_id % 2 = 0 OR status = 'missing' AS needed FROM provided")
def metadata_needed(spark, sf_dir):
    scan = F.when(F.col("doc_id") % 2 == 0, "first_scan").otherwise("rescan")
    return _provided(spark, sf_dir).select("doc_id", ((scan == "first_scan") | (F.col("status") == "missing")).alias("needed"))


_HITS = "hits AS (SELECT source, doc_id AS series_id, lang AS name, n_chars AS votes, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents), first AS (SELECT * FROM hits WHERE k = 1)"


def _series(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("series_id"), F.col("lang").alias("name"), F.col("n_chars").alias("votes"), (-F.col("n_chars")).alias("by"))
    return lookup.first_hit(hits, ["source"], ["by", "series_id"]).drop("by")


@query("metadata_series", f"WITH {_HITS} SELECT d.doc_id, f.series_id, f.name, f.votes FROM documents d LEFT JOIN first f ON d.source = f.source")
def metadata_series(spark, sf_dir):
    return lookup.enriched(table(spark, sf_dir, "documents").select("doc_id", "source"), _series(spark, sf_dir), ["source"]).select("doc_id", "series_id", "name", "votes")


@query("metadata_season", """SELECT l_orderkey AS series_id, l_linenumber AS season, CASE WHEN l_orderkey % 5 = 0 OR l_linenumber % 3 = 0 THEN l_linenumber ELSE l_linenumber % 3 END AS season_number FROM lineitem""")
def metadata_season(spark, sf_dir):
    requests = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("series_id"), F.col("l_linenumber").alias("season"))
    provider = requests.where("series_id % 5 != 0").distinct().withColumn("season_number", F.col("season") % 3)
    return lookup.seasons(requests, provider).select("series_id", "season", "season_number")


@query("metadata_episode", """SELECT l_orderkey AS series_id, l_linenumber AS episode, s_name AS name, s_acctbal AS vote FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND l_linenumber = s_suppkey % 7 + 1""")
def metadata_episode(spark, sf_dir):
    provider = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_suppkey") % 7 + 1).cast("int").alias("l_linenumber"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("vote"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    return lookup.enriched(rows, provider, ["l_suppkey", "l_linenumber"]).select(F.col("l_orderkey").alias("series_id"), F.col("l_linenumber").alias("episode"), "name", "vote")


@query("metadata_propagation", f"""WITH {HIERARCHY}, seasons AS (SELECT season, CASE WHEN season % 5 = 0 THEN 'missing' WHEN season % 7 = 0 THEN 'skipped' ELSE 'ok' END AS status FROM (SELECT DISTINCT c_custkey AS season FROM customer))
SELECT h.episode, CASE WHEN s.status <> 'ok' THEN s.status ELSE h.status END AS effective FROM hierarchy h JOIN seasons s ON h.season = s.season""")
def metadata_propagation(spark, sf_dir):
    season = F.col("c_custkey")
    seasons = table(spark, sf_dir, "customer").select(season.alias("season"), F.when(season % 5 == 0, "missing").when(season % 7 == 0, "skipped").otherwise("ok").alias("status"))
    return lookup.propagated(lenses.hierarchy(spark, sf_dir), seasons, "season").select("episode", "effective")


_TAGGED = """tagged AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"provider":"tmdb","data":{"metadata_type":"series","series_id":' || user_id || '}}' WHEN 1 THEN '{"provider":"tmdb","data":{"metadata_type":"season","season_number":' || user_id || '}}'
WHEN 2 THEN '{"provider":"tmdb","data":{"metadata_type":"episode","episode_number":' || user_id || '}}' WHEN 3 THEN '{"provider":"tmdb","data":{"metadata_type":"skip","reason":"x"}}' WHEN 4 THEN '{"provider":"other","data":{"metadata_type":"series"}}' ELSE '{"provider":"tmdb","data":{"metadata_type":"odd"}}' END AS metadata FROM events)"""


def _tagged(spark, sf_dir):
    return lenses.select_from(spark, sf_dir, f"WITH {_TAGGED} SELECT * FROM tagged", "events")


@query("metadata_dispatch", f"""WITH {_TAGGED} SELECT event_id, CASE WHEN event_id % 6 < 4 THEN json_extract_string(metadata, '$.data.metadata_type') END AS kind, CAST(CASE event_id % 6 WHEN 0 THEN json_extract_string(metadata, '$.data.series_id') WHEN 1 THEN json_extract_string(metadata, '$.data.season_number') WHEN 2 THEN json_extract_string(metadata, '$.data.episode_number') END AS INTEGER) AS number,
CASE event_id % 6 WHEN 4 THEN 'unknown provider' WHEN 5 THEN 'unknown metadata_type' END AS error FROM tagged""")
def metadata_dispatch(spark, sf_dir):
    return lookup.dispatched(_tagged(spark, sf_dir)).select("event_id", "kind", "number", "error")


@query("metadata_unknown", f"""WITH {_TAGGED} SELECT json_extract_string(metadata, '$.provider') AS provider, json_extract_string(metadata, '$.data.metadata_type') AS kind, count(*) AS n, 'OBJECT<data: OBJECT<metadata_type: STRING>, provider: STRING>' AS shape FROM tagged WHERE event_id % 6 > 3 GROUP BY ALL""")
def metadata_unknown(spark, sf_dir):
    return lookup.unknown(_tagged(spark, sf_dir))


@query("scan_observed", _WITH + "SELECT true AS success, count(*) FILTER (status = 'ok') AS n FROM hierarchy UNION ALL SELECT false, count(*) FILTER (status <> 'ok') FROM hierarchy")
def scan_observed(spark, sf_dir):
    """The counts of ``scan_summary``, taken while the rows are written."""
    from babelshelf.operators import progress
    from babelshelf.storage import shared_path

    rows = lenses.hierarchy(spark, sf_dir).withColumn("ok", F.col("status") == "ok")
    found = progress.written(rows, shared_path(spark, "observed"), {"good": F.count_if("ok"), "bad": F.count_if(~F.col("ok"))})
    return spark.createDataFrame([(True, found["good"]), (False, found["bad"])], "success boolean, n long")


@query("json_roundtrip", _WITH + "SELECT collection, series, season, episode, language, CASE status WHEN 'ok' THEN 'ok' ELSE 'missing' END AS status FROM hierarchy")
def json_roundtrip(spark, sf_dir):
    """The hierarchy as JSON documents, written and read again."""
    from babelshelf.sources import snapshot

    episodes = lenses.hierarchy(spark, sf_dir)
    return snapshot.flatten(snapshot.roundtrip(snapshot.nest(episodes)))


@query("snapshot_refresh", _WITH + """SELECT collection, series, season, episode, CASE WHEN episode % 50 = 0 THEN 'new ' || language ELSE language END AS language, CASE WHEN status = 'ok' OR episode % 50 = 0 THEN 'ok' ELSE 'missing' END AS status FROM hierarchy WHERE episode % 70 <> 1
UNION ALL SELECT DISTINCT collection, series, season, -1, 'added', 'missing' FROM hierarchy WHERE season % 40 = 3""")
def snapshot_refresh(spark, sf_dir):
    """A snapshot in folders by series, some of whose episodes are changed, added and deleted in place."""
    from babelshelf.sources import snapshot
    from babelshelf.storage import shared_path

    episodes, path = lenses.hierarchy(spark, sf_dir), shared_path(spark, "refreshed-snapshot")
    snapshot.write_parts(snapshot.nest(episodes), path, ("collection", "series"))
    changed = episodes.where("episode % 50 = 0 OR episode % 70 = 1").withColumns({"deleted": F.col("episode") % 70 == 1, "language": F.concat(F.lit("new "), "language"), "status": F.lit("ok")})
    added = episodes.where("season % 40 = 3").select("collection", "series", "season").distinct().selectExpr("*", "-1L AS episode", "'added' AS language", "'missing' AS status", "false AS deleted")
    snapshot.refresh(spark, path, changed.unionByName(added), ("collection", "series"))
    return snapshot.flatten(snapshot.read(spark, path))


@query("retry_log", """WITH a AS (SELECT user_id, event_id, value <= 60 AS ok FROM events), r AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM a),
c AS (SELECT *, CAST(count(*) FILTER (NOT ok) OVER (PARTITION BY user_id, run ORDER BY event_id) AS INTEGER) AS retries FROM r)
SELECT user_id, event_id, retries, CASE WHEN retries >= 5 THEN 'cpu' ELSE 'gpu' END AS device, round(pow(0.925, least(retries, 10)), 6) AS scale, bool_or(retries > 10) OVER (PARTITION BY user_id ORDER BY event_id) AS failed FROM c""")
def retry_log(spark, sf_dir):
    """Each event as an attempt of its user's file, which ran out of memory if its value is high."""
    attempts = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") <= 60).alias("ok"))
    return retries.tracked(attempts, "user_id", "event_id", "ok").select("user_id", "event_id", "retries", "device", F.round("scale", 6).alias("scale"), "failed")


@query("summary_lines", f"""WITH {HIERARCHY}, e AS (SELECT *, CASE status WHEN 'missing' THEN 2 WHEN 'skipped' THEN 1 ELSE 0 END AS r FROM hierarchy), s AS (SELECT collection, series, season, max(r) AS r FROM e GROUP BY ALL), t AS (SELECT collection, series, max(r) AS r FROM s GROUP BY ALL),
k AS (SELECT 'episode' AS kind, r FROM e UNION ALL SELECT 'season', r FROM s UNION ALL SELECT 'series', r FROM t), m AS (SELECT kind || ' ok=' || count(*) FILTER (r = 0) || ' missing=' || count(*) FILTER (r = 2) || ' skipped=' || count(*) FILTER (r = 1) AS x FROM k GROUP BY kind),
l AS (SELECT language || '=' || count(*) AS x FROM hierarchy GROUP BY language), o AS (SELECT CASE status WHEN 'ok' THEN 'ok ' || language ELSE 'failed ' || status END || '=' || count(*) AS x FROM hierarchy GROUP BY CASE status WHEN 'ok' THEN 'ok ' || language ELSE 'failed ' || status END)
SELECT 0 AS place, 'languages: ' || (SELECT string_agg(x, ', ' ORDER BY x) FROM l) AS line UNION ALL SELECT 1, 'metadata: ' || (SELECT string_agg(x, ', ' ORDER BY x) FROM m) UNION ALL SELECT 2, 'scans: ' || (SELECT string_agg(x, ', ' ORDER BY x) FROM o)""")
def summary_lines(spark, sf_dir):
    episodes = lenses.hierarchy(spark, sf_dir)
    found = summary.detailed_outcomes(episodes.withColumns({"ok": F.col("status") == "ok", "reason": F.col("status")}))
    return summary.log_lines(summary.by_language(episodes), summary.metadata_counts(summary.entities(episodes)), found)
