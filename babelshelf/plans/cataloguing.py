"""Queries over names, paths, probe results and options."""

from __future__ import annotations

from pyspark.sql import functions as F

from babelshelf.catalog import query
from babelshelf.functions import names, numeric
from babelshelf.operators import nesting, options
from babelshelf.plans.lenses import select_from, table
from babelshelf.sources import probe

_EPISODES = "named AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE 'Episode ' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') || ' - ' || p_name || ' [S' || lpad(CAST(p_size AS VARCHAR), 2, '0') || 'E' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') || '].mkv' END AS file_name FROM part)"
_EPISODE_RE = "'Episode ([0-9]{2}) - (.*) \\[S([0-9]{2})E([0-9]{2})\\]\\.(.*)'"


def _two(c):
    return F.lpad(c.cast("string"), 2, "0")


def _episodes(spark, sf_dir):
    key = F.col("p_partkey")
    name = F.concat(F.lit("Episode "), _two(key % 100), F.lit(" - "), "p_name", F.lit(" [S"), _two(F.col("p_size")), F.lit("E"), _two(key % 100), F.lit("].mkv"))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(key % 7 == 0, F.col("p_name")).otherwise(name).alias("file_name"))


@query("parse_episode", f"""WITH {_EPISODES} SELECT p_partkey, nullif(regexp_extract(file_name, {_EPISODE_RE}, 2), '') AS name, CAST(nullif(regexp_extract(file_name, {_EPISODE_RE}, 3), '') AS INTEGER) AS season, CAST(nullif(regexp_extract(file_name, {_EPISODE_RE}, 4), '') AS INTEGER) AS episode FROM named""")
def parse_episode(spark, sf_dir):
    return _episodes(spark, sf_dir).select("p_partkey", names.episode(F.col("file_name")).alias("e")).select("p_partkey", "e.name", "e.season", "e.episode")


@query("parse_season", """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 0 END ELSE CAST(lpad(CAST(p_size AS VARCHAR), 2, '0') AS INTEGER) END AS season FROM part""")
def parse_season(spark, sf_dir):
    key = F.col("p_partkey")
    name = F.when(key % 7 == 0, F.when(key % 2 == 0, "Extras").otherwise("Other")).otherwise(F.concat(F.lit("x Staffel "), _two(F.col("p_size"))))
    return table(spark, sf_dir, "part").select("p_partkey", names.season(name, ["Extras", "Specials"]).alias("season"))


@query("parse_series", """WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_name WHEN p_partkey % 7 = 1 THEN p_name || ' (2001) (2005)' ELSE p_name || ' (' || 1950 + p_size || ')' END AS folder FROM part)
SELECT p_partkey, nullif(regexp_extract(folder, '(.*) \\(([0-9]{4})\\)', 1), '') AS name, CAST(nullif(regexp_extract(folder, '(.*) \\(([0-9]{4})\\)', 2), '') AS INTEGER) AS year FROM n""")
def parse_series(spark, sf_dir):
    key = F.col("p_partkey")
    folder = F.when(key % 7 == 0, F.col("p_name")).when(key % 7 == 1, F.concat("p_name", F.lit(" (2001) (2005)"))).otherwise(F.concat("p_name", F.lit(" ("), 1950 + F.col("p_size"), F.lit(")")))
    return table(spark, sf_dir, "part").select("p_partkey", names.series(folder).alias("s")).select("p_partkey", "s.name", "s.year")


@query("ignore_filter", "SELECT source || '/' || doc_id || '.' || lang AS path FROM documents WHERE lang IN ('en', 'fr')")
def ignore_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "doc_id", F.lit("."), "lang").alias("path"))
    return rows.where(~names.is_ignored(names.base_name(F.col("path")), F.lit("file"), ["en", "fr"], ["tmp"]))


_NAMES = """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'trailer.mp4' WHEN 2 THEN 'Trailer.mkv' WHEN 3 THEN 'TRAILER.mp4' WHEN 4 THEN 'trailer' WHEN 5 THEN '.trailer' WHEN 6 THEN 'trailer.' || p_size || '.mp4' WHEN 7 THEN 'trailer.' ELSE p_name || '.mp4' END AS name FROM part"""


@query("trailer_filter", f"SELECT p_partkey, CASE WHEN regexp_full_match(name, '.+\\.[^.]+') THEN regexp_extract(name, '^(.+)\\.[^.]+$', 1) ELSE name END IN ('trailer', 'Trailer') AS trailer FROM ({_NAMES})")
def trailer_filter(spark, sf_dir):
    return select_from(spark, sf_dir, _NAMES, "part").select("p_partkey", names.is_trailer(F.col("name"), ["trailer", "Trailer"]).alias("trailer"))


# Paths of one to five parts, with names that fit their place and names that don't, and what stands there.
_PATHS = """SELECT p_partkey, CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE concat_ws('/', CASE WHEN p_partkey % 3 > 0 THEN collection END, CASE WHEN depth > 0 THEN series END, CASE WHEN depth > 1 THEN season END, CASE WHEN depth > 2 THEN episode END, CASE WHEN p_partkey % 23 = 0 THEN 'more.mp4' END) END AS path, CASE WHEN p_partkey % 13 = 5 THEN NULL WHEN p_partkey % 11 < 8 AND depth > 2 OR p_partkey % 11 = 9 THEN 'file' ELSE 'folder' END AS kind
FROM (SELECT *, CASE p_partkey % 3 WHEN 1 THEN 'Some Collection' ELSE p_name || ' (' || (1950 + p_size) || ')' END AS collection, CASE p_partkey % 7 WHEN 0 THEN 'Show' WHEN 1 THEN 'Show (20)' ELSE p_name || ' (2001) (2005)' END AS series, CASE p_partkey % 5 WHEN 0 THEN 'Extras' WHEN 1 THEN 'trailer.mp4' WHEN 2 THEN 'Other' ELSE 'Staffel ' || lpad('' || p_size, 2, '0') END AS season,
CASE p_partkey % 8 WHEN 0 THEN 'Episode 01 - x [S01E00].mp4' WHEN 1 THEN 'trailer.mp4' WHEN 2 THEN 'Episode 1 - x [S01E01].mp4' ELSE 'Episode 01 - ' || p_name || ' [S01E0' || p_partkey % 10 || '].mp4' END AS episode, p_partkey // 7 % 4 AS depth FROM part) AS parts"""
_NESTING_SQL = f"""WITH p AS ({_PATHS}), s AS (SELECT *, len(string_split(path, '/')) AS depth, string_split(path, '/')[-1] AS name, NOT regexp_matches(string_split(path, '/')[1], '(.*) \\([0-9]{{4}}\\)') AS within FROM p),
r AS (SELECT *, CASE depth WHEN 4 THEN 'episode' WHEN 3 THEN CASE WHEN within THEN 'season' ELSE 'episode' END WHEN 2 THEN CASE WHEN within THEN 'series' ELSE 'season' END WHEN 1 THEN CASE WHEN within AND kind = 'folder' THEN 'collection' ELSE 'series' END END AS role FROM s),
m AS (SELECT *, (kind = 'file') <> (role = 'episode') AS misplaced, CASE role WHEN 'collection' THEN true WHEN 'series' THEN regexp_matches(name, '(.*) \\([0-9]{{4}}\\)') WHEN 'season' THEN regexp_matches(name, 'Staffel [0-9]{{2}}') OR name = 'Extras'
WHEN 'episode' THEN coalesce(CAST(nullif(regexp_extract(name, 'Episode [0-9]{{2}} - .* \\[S[0-9]{{2}}E([0-9]{{2}})\\]\\..*', 1), '') AS INTEGER), 0) >= 1 END AS parsed, CASE WHEN regexp_full_match(name, '.+\\.[^.]+') THEN regexp_extract(name, '^(.+)\\.[^.]+$', 1) ELSE name END = 'trailer' AS trailer FROM r),
f AS (SELECT p_partkey, role, CASE WHEN role IS NULL THEN 'too_deep' WHEN misplaced AND role = 'season' AND trailer THEN 'trailer' WHEN misplaced THEN 'unexpected_kind' WHEN NOT coalesce(parsed, false) THEN 'unparsable_name' END AS problem FROM m)
SELECT p_partkey, CASE WHEN problem IS NULL THEN role END AS entity, problem FROM f"""


@query("classify_nesting", _NESTING_SQL)
def classify_nesting(spark, sf_dir):
    rows = select_from(spark, sf_dir, _PATHS.replace("p_partkey // 7", "p_partkey div 7"), "part")
    return nesting.classify(rows, ["Extras"], ["trailer"]).select("p_partkey", "entity", "problem")


@query("path_parts", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, split_part(split_part(url, '?', 1), '/', -1) AS name, length(regexp_replace(split_part(url, '?', 1), '[^/]', '', 'g')) - 2 AS depth FROM pages")
def path_parts(spark, sf_dir):
    path = F.element_at(F.split("url", r"\?"), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), names.base_name(path).alias("name"), (F.size(F.split(path, "/")) - 3).cast("long").alias("depth"))


@query("safe_index", "SELECT doc_id, CAST(nullif(list_position(string_split(text, ' '), CASE doc_id % 3 WHEN 0 THEN 'the' WHEN 1 THEN 'de' ELSE lang END), 0) - 1 AS INTEGER) AS position FROM documents")
def safe_index(spark, sf_dir):
    """Where among the words of a document a word stands first."""
    words, word = F.split("text", " "), F.when(F.col("doc_id") % 3 == 0, "the").when(F.col("doc_id") % 3 == 1, "de").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", numeric.first_index(words, word).alias("position"))


@query("language_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 0 THEN split_part(o_orderpriority, '-', 1) END AS short, CASE WHEN o_orderkey % 9 > 0 THEN split_part(o_orderpriority, '-', 2) END AS long FROM orders")
def language_parse(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 9 == 0, "a:b:c").otherwise(F.replace(F.col("o_orderpriority"), F.lit("-"), F.lit(" : ")))
    return table(spark, sf_dir, "orders").select("o_orderkey", names.language(text).alias("l")).select("o_orderkey", "l.short", "l.long")


_LANGUAGES = "SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'un: Unknown' WHEN 1 THEN ' un :Unknown ' WHEN 2 THEN 'UN: Unknown' WHEN 3 THEN 'un: unknown' WHEN 4 THEN 'un' WHEN 5 THEN 'un: Unknown: x' WHEN 6 THEN NULL ELSE o_orderpriority || ': ' || o_orderstatus END AS name FROM orders"


@query("language_default", f"SELECT o_orderkey, CASE WHEN len(string_split(name, ':')) = 2 THEN trim(split_part(name, ':', 1)) = 'un' AND trim(split_part(name, ':', 2)) = 'Unknown' END AS is_default FROM ({_LANGUAGES})")
def language_default(spark, sf_dir):
    rows = select_from(spark, sf_dir, _LANGUAGES, "orders").select("o_orderkey", names.language(F.col("name")).alias("l"))
    return rows.select("o_orderkey", names.is_default(F.col("l.short"), F.col("l.long")).alias("is_default"))


@query("describe_text", "SELECT c_custkey, '<Series name: ' || c_name || ' year: ' || (1900 + c_nationkey) || '>' AS series, '<Season season: ' || c_nationkey || '>' AS season, '<Episode season: ' || c_nationkey || ' episode: ' || c_custkey || ' name: ' || c_mktsegment || '>' AS episode FROM customer")
def describe_text(spark, sf_dir):
    n = F.col("c_nationkey")
    texts = names.series_text(F.col("c_name"), 1900 + n), names.season_text(n), names.episode_text(n, F.col("c_custkey"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", *(x.alias(k) for x, k in zip(texts, ("series", "season", "episode"), strict=True)))


def _stream(kind: str, name: str, duration: str | None = None) -> str:
    return '{"codec_type":"' + kind + '","codec_name":"' + name + '"' + (',"duration":"\' || d || \'"' if duration == "d" else "" if duration is None else f',"duration":"{duration}"') + "}"


# What a prober says of a file: streams of each kind, with and without durations, and texts that are none.
_PROBE_SHAPES = (
    f"""{{"streams":[{_stream("video", "h264", "d")},{_stream("audio", "aac", "d")}],"format":{{"duration":"11.0"}}}}""", f"""{{"streams":[{_stream("video", "h264")},{_stream("audio", "aac", "3")}],"format":{{"duration":"' || d || '"}}}}""",
    f"""{{"streams":[{_stream("video", "h264", "d")}],"format":{{}}}}""", f"""{{"streams":[{_stream("audio", "pcm_s16le", "d")},{_stream("subtitle", "ass")}],"format":{{}}}}""", f"""{{"streams":[{_stream("audio", "mp3", "N/A")}],"format":{{"duration":"' || d || '"}}}}""",
    f"""{{"streams":[{_stream("subtitle", "srt", "d")}],"format":{{"duration":"5"}}}}""", f"""{{"streams":[{_stream("video", "a")},{_stream("video", "b")}],"format":{{"duration":"1"}}}}""", f"""{{"streams":[{_stream("audio", "mp3")}],"format":{{}}}}""",
    f"""{{"streams":[{_stream("audio", "mp3", "d")},{_stream("audio", "aac", "d")}],"format":{{"duration":"2"}}}}""", """{"streams":[],"format":{"duration":"1"}}""", """{"format":{"duration":"1"}}""",
)
_PROBES = f"probes AS (SELECT event_id, CASE event_id % {len(_PROBE_SHAPES) + 1} {' '.join(f"WHEN {k} THEN '{shape}'" for k, shape in enumerate(_PROBE_SHAPES))} END AS raw FROM (SELECT event_id, event_id * 7919 % 10007 || '.' || event_id % 4 * 25 AS d FROM events) AS durations)"


def _probes(spark, sf_dir):
    return select_from(spark, sf_dir, f"WITH {_PROBES} SELECT * FROM probes", "events")


@query("probe_json", f"WITH {_PROBES} SELECT event_id, CAST(json_array_length(raw, '$.streams') AS INTEGER) AS n_streams, json_extract_string(raw, '$.streams[0].codec_type') AS first_type, json_extract_string(raw, '$.format.duration') AS duration FROM probes")
def probe_json(spark, sf_dir):
    rows = _probes(spark, sf_dir).select("event_id", probe.parsed(F.col("raw")).alias("p"))
    return rows.select("event_id", F.size("p.streams").alias("n_streams"), F.get("p.streams", F.lit(0))["codec_type"].alias("first_type"), F.col("p.format.duration").alias("duration"))


_STREAM_LIST = """'[{"codec_type":"VARCHAR","codec_name":"VARCHAR","duration":"VARCHAR"}]'"""
_NUMBER = "CASE WHEN regexp_full_match({0}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN CAST({0} AS DOUBLE) END"
_STATUS_SQL = f"""WITH {_PROBES}, s AS (SELECT event_id, coalesce(from_json(json_extract(raw, '$.streams'), {_STREAM_LIST}), []) AS streams, json_extract_string(raw, '$.format.duration') AS whole FROM probes),
k AS (SELECT event_id, whole, [x FOR x IN streams IF x.codec_type = 'video'] AS video, [x FOR x IN streams IF x.codec_type = 'audio'] AS audio FROM s), m AS (SELECT *, CASE WHEN len(video) > 0 THEN video[1] ELSE audio[1] END.duration AS own FROM k),
r AS (SELECT *, coalesce({_NUMBER.format('own')}, {_NUMBER.format('whole')}) AS runtime FROM m),
e AS (SELECT *, CASE WHEN len(video) = 0 AND len(audio) = 0 THEN 'neither video nor audio' WHEN len(video) > 1 THEN 'more than one video stream' WHEN runtime IS NULL THEN 'no duration' WHEN len(video) = 1 AND len(audio) = 0 THEN 'video without audio' WHEN len(audio) > 1 THEN 'more than one audio stream' END AS error FROM r)
SELECT event_id, CASE WHEN error IS NULL THEN CASE WHEN len(video) = 1 THEN 'video' WHEN audio[1].codec_name = 'pcm_s16le' THEN 'wav' ELSE 'audio' END END AS status, CASE WHEN error IS NULL THEN runtime END AS runtime, error FROM e"""


@query("probe_status", _STATUS_SQL)
def probe_status(spark, sf_dir):
    return probe.status(_probes(spark, sf_dir).select("event_id", probe.parsed(F.col("raw")).alias("probe"))).select("event_id", "status", "runtime", "error")


@query("file_list_expand", "SELECT DISTINCT 'o' || o_orderkey || '.mp4' AS path FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 2 OR o_orderkey % 50 = 0")
def file_list_expand(spark, sf_dir):
    """Lists name lists, folders and files: regions their nations, nations their customers' folders, and also each other. Lists and folders may be empty."""
    nation, customer, orders = (table(spark, sf_dir, x) for x in ("nation", "customer", "orders"))
    of = lambda letter, key, end="": F.concat(F.lit(letter), key, F.lit(end))
    file, folder = of("o", "o_orderkey", ".mp4"), of("c", "c_custkey")
    region_list, nation_list = of("r", "n_regionkey", ".txt"), of("n", "n_nationkey", ".txt")
    roots = spark.sql("SELECT * FROM VALUES ('r0.txt'), ('r1.txt'), ('more.txt') AS t(path)")
    entries = [
        nation.select(region_list, nation_list), nation.select(nation_list, region_list), customer.select(of("n", "c_nationkey", ".txt"), folder), orders.select(of("c", "o_custkey"), file),
        customer.select(folder, F.lit(None)), roots.select("path", F.lit(None)),
        orders.where("o_orderkey % 50 = 0").select(F.lit("more.txt"), file),
    ]
    rows = entries[0].toDF("parent", "child")
    for more in entries[1:]:
        rows = rows.unionAll(more)
    return options.expanded(rows, roots)


@query("enum_lookup", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 50 WHEN 1 THEN 40 WHEN 2 THEN 0 WHEN 3 THEN 30 END AS level FROM part")
def enum_lookup(spark, sf_dir):
    given = F.element_at(F.array(*(F.lit(x) for x in ("critical", "Error", "NOTSET", "warn", "sNOTSET"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", options.enum_value(given, options.LOG_LEVELS, options.LOG_ALIASES).alias("level"))


@query("alias_resolve", """WITH RECURSIVE walk AS (SELECT p_partkey AS name, p_partkey AS k, 0 AS hops FROM part UNION ALL SELECT name, k // 3, hops + 1 FROM walk WHERE k >= 10 AND k % 101 <> 0 AND k % 97 <> 0), ends AS (SELECT name, arg_max(k, hops) AS k FROM walk GROUP BY name)
SELECT 'n' || name AS name, CASE WHEN k < 10 THEN 'n' || k END AS target, CASE WHEN k < 10 THEN NULL WHEN k % 101 = 0 THEN 'unknown' ELSE 'cycle' END AS error FROM ends""")
def alias_resolve(spark, sf_dir):
    """A name stands for that of a third of its number, those of 97 for themselves, those of 101 for none; nine are known."""
    key = F.col("p_partkey")
    named = lambda number: F.concat(F.lit("n"), number)
    part = table(spark, sf_dir, "part").select("p_partkey")
    aliases = part.where("p_partkey >= 10 AND p_partkey % 101 != 0").select(named(key).alias("alias"), named(F.when(key % 97 == 0, key).otherwise(F.floor(key / 3))).alias("target"))
    return options.resolved(part.select(named(key).alias("name")), aliases, part.where("p_partkey < 10").select(named(key).alias("name")))


@query("config_coalesce", """WITH d AS (SELECT c_custkey AS owner, unnest(['nation', 'segment', 'balance']) AS key, unnest([CAST(c_nationkey AS VARCHAR), c_mktsegment, NULL]) AS value FROM customer),
t AS (SELECT o_custkey AS owner, 'segment' AS key, max(CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END) AS value FROM orders GROUP BY o_custkey UNION ALL SELECT DISTINCT o_custkey, 'seen', 'yes' FROM orders)
SELECT coalesce(d.owner, t.owner) AS owner, coalesce(d.key, t.key) AS key, coalesce(t.value, d.value) AS value FROM d FULL JOIN t ON d.owner = t.owner AND d.key = t.key""")
def config_coalesce(spark, sf_dir):
    """Each customer's defaults under what the orders set."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("nation", F.col("c_nationkey").cast("string")), ("segment", F.col("c_mktsegment")), ("balance", F.lit(None).cast("string")))))
    defaults = customer.select(F.col("c_custkey").alias("owner"), F.explode(pairs).alias("x")).select("owner", "x.key", "x.value")
    owner = F.col("o_custkey").alias("owner")
    segment = orders.groupBy(owner).agg(F.max(F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority"))).alias("value")).select("owner", F.lit("segment").alias("key"), "value")
    return options.layered(defaults, segment, orders.select(owner, F.lit("seen").alias("key"), F.lit("yes").alias("value")))
