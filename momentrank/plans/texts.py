"""Text and file-format queries over strings that the test tables give, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import boundary
from ..sources import readers, sinks
from ..tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


NAME = r"regexp_replace(element_at(string_split(replace(trim({0}), chr(92), '/'), '/'), -1), '(?i)\.({1})$', '')"


@query(f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url || '.MP4' WHEN page_id % 3 = 1 THEN replace(url, '/', chr(92)) || '.webm' ELSE url END AS u FROM pages)
SELECT page_id, nullif({NAME.format("u", "mp4").replace("element_at(", "list_extract(")}, '') AS upstream, nullif({NAME.format("u", "mp4|avi|mkv|webm").replace("element_at(", "list_extract(")}, '') AS client FROM p""")
def video_id_norm(spark: SparkSession, sf: str) -> DataFrame:
    i, u = F.col("page_id"), F.col("url")
    path = F.when(i % 3 == 0, F.concat(u, F.lit(".MP4"))).when(i % 3 == 1, F.concat(F.translate(u, "/", "\\"), F.lit(".webm"))).otherwise(u)
    rows = table(spark, sf, "pages").select("page_id", path.alias("u"))
    return rows.select("page_id", text.video_id(F.col("u")).alias("upstream"), text.video_id(F.col("u"), "client").alias("client"))


# times like 7:3, 65:20 or 1:75:10 from document ids and lengths
TIMES_SQL = """t AS (SELECT doc_id, n_chars, CASE doc_id % 5 WHEN 0 THEN (n_chars % 100)::VARCHAR WHEN 1 THEN (n_chars % 80) || ':' || (doc_id % 70) WHEN 2 THEN (doc_id % 3) || ':' || (n_chars % 70) || ':' || (doc_id % 65)
  WHEN 3 THEN 'x' || n_chars ELSE (doc_id % 9) || ':' || (n_chars % 60) || '.5' END AS s FROM documents)"""


def times(spark: SparkSession, sf: str) -> DataFrame:
    d, n = F.col("doc_id"), F.col("n_chars")
    s = lambda c: c.cast("string")
    t = (
        F.when(d % 5 == 0, s(n % 100)).when(d % 5 == 1, F.concat_ws(":", s(n % 80), s(d % 70))).when(d % 5 == 2, F.concat_ws(":", s(d % 3), s(n % 70), s(d % 65)))
        .when(d % 5 == 3, F.concat(F.lit("x"), s(n))).otherwise(F.concat(s(d % 9), F.lit(":"), s(n % 60), F.lit(".5")))
    )
    return table(spark, sf, "documents").select("doc_id", "n_chars", t.alias("s"))


@query(f"""WITH {TIMES_SQL}, p AS (SELECT *, [try_cast(x AS DOUBLE) for x in string_split(s, ':')] AS a FROM t),
v AS (SELECT doc_id, len(a) AS n, CASE WHEN list_contains([x IS NULL for x in a], true) THEN NULL WHEN len(a) = 1 THEN a[1] WHEN len(a) = 2 AND a[2] < 60 THEN a[1] * 60 + a[2]
  WHEN len(a) = 3 AND a[2] < 60 AND a[3] < 60 THEN a[1] * 3600 + a[2] * 60 + a[3] END AS lenient FROM p)
SELECT doc_id, lenient, CASE WHEN n >= 2 THEN lenient END AS strict FROM v""")
def timestamp_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = times(spark, sf)
    return rows.select("doc_id", text.timestamp_seconds(F.col("s")).alias("lenient"), text.timestamp_seconds(F.col("s"), True).alias("strict"))


@query("""WITH s AS (SELECT doc_id, n_chars, round_even(n_chars / 2.0, 0)::BIGINT AS r, n_chars // 2 AS w, CASE WHEN n_chars % 2 = 1 THEN '50' ELSE '00' END AS h FROM documents)
SELECT doc_id, CASE WHEN r >= 3600 THEN (r // 3600) || ':' || lpad((r % 3600 // 60)::VARCHAR, 2, '0') ELSE (r // 60)::VARCHAR END || ':' || lpad((r % 60)::VARCHAR, 2, '0') AS display,
(w // 60) || ':' || lpad((w % 60)::VARCHAR, 2, '0') || '.' || h AS clock FROM s""")
def timestamp_format(spark: SparkSession, sf: str) -> DataFrame:
    half = F.col("n_chars") / 2
    return table(spark, sf, "documents").select("doc_id", text.display_time(half).alias("display"), text.clock(half).alias("clock"))


@query("SELECT event_id, 'candidate_upstream_' || sha256('s' || chr(31) || event_type || chr(31) || user_id || chr(31) || event_id || chr(31) || (event_id % 100 + 1))[1:20] AS id FROM events")
def candidate_id(spark: SparkSession, sf: str) -> DataFrame:
    key = text.candidate_id(F.lit("s"), F.col("event_type"), F.col("user_id"), F.col("event_id"), F.col("event_id") % 100 + 1)
    return table(spark, sf, "events").select("event_id", key.alias("id"))


@query(r"""WITH w AS (SELECT doc_id, lang, [x for x in regexp_split_to_array(text, '\s+') if x <> ''] AS w FROM documents),
s AS (SELECT doc_id, lang, CASE WHEN len(w) > 0 THEN len([x for x in w if regexp_matches(x, '[éèàçñóüöäß]')]) / len(w) ELSE 0.0 END AS share FROM w)
SELECT lang, count(*) AS docs, count(*) FILTER (share > 0.5) AS flagged, round(avg(share), 6) + 0.0 AS share FROM s GROUP BY lang""")
def text_signature(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("lang", text.marked_share(F.col("text"), "éèàçñóüöäß").alias("share"))
    return rows.groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(F.col("share") > 0.5).alias("flagged"), (F.round(F.avg("share"), 6) + 0.0).alias("share"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'tion the')")
def substring_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(text.contains_ignoring_case(F.col("text"), "TION the")).select("doc_id")


# a query file a conversation: its turns are events, with times that follow from the turn

def files(spark: SparkSession, sf: str) -> DataFrame:
    """``path, value`` of files made of ``conversations``: the system turn is context, each other turn an event."""
    c = table(spark, sf, "conversations").where("conv_id is not null")
    line = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    event = F.concat(F.lit("E"), (F.col("turn") + 1).cast("string"))
    rows = c.select("conv_id", "turn", F.concat(event, F.lit(": "), line).alias("ask"), F.concat(F.lower(event), F.lit(":  "), text.display_time(F.col("turn") * 45), F.lit(" - "), text.display_time(F.col("turn") * 45 + 30)).alias("tell"))
    both = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "ask", "tell"))).alias("x"))
    part = lambda f: F.array_join(F.transform("x", f), "\n")
    value = F.concat_ws("\n", F.lit("  Some context"), part(lambda e: e.ask), F.lit("** answer"), F.concat(F.lit("video_path: '/v/"), F.col("conv_id").cast("string"), F.lit(".MKV'")), part(lambda e: e.tell))
    return both.select(F.col("conv_id").cast("string").alias("path"), value.alias("value"))


PARSED_SQL = """g AS (SELECT conv_id::VARCHAR AS path, conv_id::VARCHAR AS video, 'Some context' AS context, row_number() OVER (PARTITION BY conv_id ORDER BY turn, trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) - 1 AS pos, 'E' || (turn + 1) AS event,
  trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text, turn * 45.0 AS a, turn * 45.0 + 30 AS z FROM conversations WHERE conv_id IS NOT NULL)"""


@query(f"WITH {PARSED_SQL} SELECT path, video, context, pos, event, text, a::DOUBLE AS start_seconds, z::DOUBLE AS end_seconds FROM g")
def parse_query_text(spark: SparkSession, sf: str) -> DataFrame:
    return readers.query_groups(files(spark, sf))


@query(f"""WITH {PARSED_SQL} SELECT 'event' AS mode, video || ':' || event AS query_id, text AS query_text FROM g UNION ALL SELECT 'event_with_context', video || ':' || event, context || ' ' || text FROM g
UNION ALL SELECT 'file', video || ':all', context || ' ' || string_agg(text, ' ' ORDER BY pos) FROM g GROUP BY path, video, context""")
def query_modes(spark: SparkSession, sf: str) -> DataFrame:
    groups = readers.query_groups(files(spark, sf))
    parts = [readers.queries_of(groups, m).select(F.lit(m).alias("mode"), "query_id", "query_text") for m in ("event", "event_with_context", "file")]
    return parts[0].union(parts[1]).union(parts[2])


def moment_sql(kind: str, intro: str, wrap: str) -> str:
    show = lambda c: f"(({c})::BIGINT // 60) || ':' || lpad((({c})::BIGINT % 60)::VARCHAR, 2, '0')"
    return f"""SELECT video, '{kind}' AS moment, any_value(context) || chr(10) || '{intro}' || chr(10) || string_agg(event || ': ' || '{wrap}'.replace('%s', text), chr(10) ORDER BY pos) || chr(10) || '**Answer' || chr(10) ||
'video_path: "' || video || '.mp4"' || chr(10) || string_agg(event || ': ' || {show("a")} || ' - ' || {show("z")}, chr(10) ORDER BY pos) || chr(10) AS value FROM g GROUP BY path, video"""


@query(f"WITH {PARSED_SQL} {' UNION ALL '.join(moment_sql(k, sinks.INTRO[k], sinks.WRAP[k]) for k in ('first', 'last'))}")
def augmented_queries(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.rendered(readers.query_groups(files(spark, sf)))


@query("""WITH v AS (SELECT 'broken' AS x) SELECT 'no_answer' AS rule, conv_id::VARCHAR AS path FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 4 = 1)
UNION ALL SELECT 'no_video', conv_id::VARCHAR FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 4 = 2)
UNION ALL SELECT 'duplicate_event', conv_id::VARCHAR FROM (SELECT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY conv_id
UNION ALL SELECT 'no_events', conv_id::VARCHAR FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 4 = 3)""")
def query_file_violations(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("path").cast("long") % 4
    v = F.when(k == 1, F.regexp_replace("value", r"(?m)^e\d+:  .*$", "-")).when(k == 2, F.regexp_replace("value", "video_path", "path")).when(k == 3, F.regexp_replace("value", r"(?m)^E(\d+): ", "F$1: ")).otherwise(F.col("value"))
    rows = files(spark, sf).withColumn("value", v)
    found = readers.query_file_violations(rows, readers.query_groups(rows))
    return found.where(~((F.col("rule") == "duplicate_event") & (F.col("path").cast("long") % 4 == 3)))


# responses: a customer's orders are the hits of one query
@query("""WITH h AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders)
SELECT o_custkey::VARCHAR AS event_id, 'clip' || o_orderkey AS video_id, o_orderkey AS frame_id, (rank * 61)::DOUBLE AS timestamp_seconds, round(o_totalprice, 2) AS score, rank FROM h WHERE o_orderkey % 6 <> 0 AND o_orderkey % 7 <> 0""")
def response_hits(spark: SparkSession, sf: str) -> DataFrame:
    return readers.hits_of(responses(spark, sf))[0].select("event_id", "video_id", "frame_id", "timestamp_seconds", F.round("raw_relevance_score", 2).alias("score"), "rank")


@query("""WITH h AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders)
SELECT o_custkey::VARCHAR AS event_id, rank, CASE WHEN o_orderkey % 6 = 0 THEN 'bad_frame' ELSE 'bad_score' END AS why FROM h WHERE o_orderkey % 6 = 0 OR o_orderkey % 7 = 0""")
def response_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    return readers.hits_of(responses(spark, sf))[1].select("event_id", "rank", "why")


def responses(spark: SparkSession, sf: str) -> DataFrame:
    o = F.col("o_orderkey")
    hit = F.struct(
        o.alias("key"), F.concat(F.lit("/data/clip"), o.cast("string"), F.lit(".mp4")).alias("video_name"), F.when(o % 6 == 0, -1).otherwise(o).alias("frame_index"),
        F.when(o % 7 != 0, F.col("o_totalprice")).alias("score"),
    )
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(hit)).alias("x"))
    full = F.transform("x", lambda h, i: F.struct(h.video_name.alias("video_name"), h.frame_index.alias("frame_index"), text.display_time((i + 1) * 61.0).alias("timestamp"),
                                                  F.lit(None).cast("double").alias("timestamp_seconds"), h.score.alias("score"), F.lit(None).cast("string").alias("watch_url")))
    return rows.select(F.lit("s").alias("session_id"), F.col("o_custkey").cast("string").alias("event_id"), F.array(F.lit("q")).alias("query"), full.alias("results"))


@query("""SELECT p_partkey::VARCHAR AS query_id, p_name AS query_text, p_partkey::VARCHAR AS video, CASE WHEN p_partkey % 2 = 0 THEN 'validation' ELSE 'training' END AS subset, 1.5 AS start_seconds, p_size::DOUBLE AS end_seconds FROM part WHERE p_partkey % 2 = 0""".replace("p_partkey::VARCHAR AS query_id", "p_partkey || ':7' AS query_id"))
def annotation_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    one = F.struct(F.when(k % 2 == 0, "validation").otherwise("training").alias("subset"), F.lit("r").alias("recipe_type"),
                   F.array(F.struct(F.lit(7).cast("long").alias("id"), F.col("p_name").alias("sentence"), F.array(F.lit(1.5), F.col("p_size").cast("double")).alias("segment"))).alias("annotations"))
    return readers.annotations_of(table(spark, sf, "part").select(F.create_map(k.cast("string"), one).alias("database")), ["Validation"])


@query("SELECT item_id::VARCHAR AS path, k::BIGINT AS pos, CASE k WHEN 0 THEN 'plain' ELSE 'q' || item_id END AS query_text, CASE k WHEN 0 THEN NULL ELSE 'v' || item_id END AS video FROM benchmark, (SELECT unnest([0, 1]) AS k)")
def lenient_manifest(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id").cast("string")
    items = F.concat(F.lit('["plain", {"query": "q'), i, F.lit('", "video": "dir/v'), i, F.lit('.mp4"}]'))
    value = F.when(F.col("item_id") % 2 == 0, items).otherwise(F.concat(F.lit('{"queries": '), items, F.lit("}")))
    return readers.lenient_manifest(table(spark, sf, "benchmark").select(i.alias("path"), value.alias("value")))


@query("""SELECT DISTINCT regexp_replace(list_extract(string_split(rtrim(url, '/'), '/'), -1), '(?i)\\.(mp4|webm|mkv|avi|mov|m4v)$', '') AS video FROM pages""")
def expected_videos(spark: SparkSession, sf: str) -> DataFrame:
    return readers.expected_videos(table(spark, sf, "pages").select(F.col("url").alias("value")))


@query("""WITH s AS (SELECT event_id, value / 10 AS anchor, 24 + event_id % 7 AS fps FROM events),
x AS (SELECT event_id, greatest(0, round_even((round_even(anchor * fps, 0) + i * 2) / fps * 1000, 0))::BIGINT AS ms FROM s, (SELECT unnest(range(-3, 4)) AS i)),
y AS (SELECT DISTINCT event_id, least(ms, 40000) AS ms FROM x)
SELECT event_id, string_agg(ms::VARCHAR, ',' ORDER BY ms) AS ms, round(4.0 / (24 + event_id % 7), 6) + 0.0 AS shortest FROM y GROUP BY event_id""")
def sample_times(spark: SparkSession, sf: str) -> DataFrame:
    fps = (24 + F.col("event_id") % 7).cast("double")
    ms = boundary.sample_times(F.col("value") / 10, fps, 3, 2, F.lit(40000).cast("long"))
    return table(spark, sf, "events").select("event_id", F.array_join(F.transform(ms, lambda x: x.cast("string")), ",").alias("ms"), (F.round(boundary.native_windows(fps, 2)[0], 6) + 0.0).alias("shortest"))
