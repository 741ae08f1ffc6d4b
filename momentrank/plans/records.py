"""File formats as strings that the test tables give, filters and audits of records, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import constraints, evaluate, regions
from ..sources import readers
from ..tables import CANDIDATES_SQL, candidates, table
from .ranking import calibrated_sql, r6

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# a part is a query: an even one a line of its own, an odd one in a document with another; field names differ
@query("""SELECT 'q' || p_partkey AS query_id, p_name AS query_text, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'clip' || p_size END AS video, p_size / 2 AS start_seconds, p_size::DOUBLE AS end_seconds FROM part
UNION ALL SELECT 'r' || p_partkey, 'again', NULL, NULL, NULL FROM part WHERE p_partkey % 2 = 1""")
def manifest_rows(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    video = F.when(k % 3 == 1, text(', "ground_truth_video": "/v/clip', size, '.MP4"')).when(k % 3 == 2, text(', "video": "clip', size, '"')).otherwise("")
    name = F.when(k % 4 == 0, "query").when(k % 4 == 1, "text").otherwise("query_text")
    one = text('{"', F.when(k % 5 == 0, "id").otherwise("query_id"), '": "q', k, '", "', name, '": "', F.col("p_name"), '"', video, ', "start": ', size / 2, ', "end_seconds": ', size, "}")
    other = text('{"id": "r', k, '", "text": "again"}')
    document = F.when(k % 4 == 1, text("[", one, ", ", other, "]")).otherwise(text('{"queries": [', one, ", ", other, "]}"))
    rows = table(spark, sf, "part")
    return readers.manifest_lines(rows.where("p_partkey % 2 = 0").select(one.alias("value"))).union(readers.manifest_documents(rows.where("p_partkey % 2 = 1").select(document.alias("value"))))


@query("""SELECT 'v' || p_size AS video, p_partkey::INT AS n, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'Tree,Road' END AS entities, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE round(p_size / 64, 6) END AS best,
p_partkey % 5 <> 0 AND p_size / 64 >= 0.5 AS satisfied FROM part""")
def detection_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Detections of keyframes; every fifth document is cut short."""
    from ..operators.sequence import contains_objects

    k, size = F.col("p_partkey"), F.col("p_size")
    value = text('{"detection_class_entities": ["Tree", "Road"], "detection_scores": ["', size / 64, '", "0.25"')
    rows = table(spark, sf, "part").select(text("/d/v", size, "/", k, ".json").alias("path"), F.when(k % 5 == 0, value).otherwise(F.concat(value, F.lit("]}"))).alias("value"))
    found = readers.detections_of(rows)
    return found.select("video", "n", F.array_join("entities", ",").alias("entities"), F.round(F.try_element_at("scores", F.lit(1)), 6).alias("best"), contains_objects("entities", "scores", ["TREE"], 0.5).alias("satisfied"))


@query("""SELECT 'v' || p_partkey AS video, t::DOUBLE AS t, 'f' || t || '.jpg' AS file, seq::BIGINT AS seq FROM part, (SELECT unnest([1.5, 3.0]) AS t, unnest([0, 2]) AS seq) WHERE p_partkey % 7 <> 0""")
def keyframe_manifest_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Keyframes of manifests; the second entry of each has no file, and every seventh manifest is broken."""
    k = F.col("p_partkey")
    value = F.lit('{"keyframes": [{"index": 0, "timestamp": 1.5, "file": "f1.5.jpg"}, {"index": 1, "timestamp": 2.0}, {"index": 2, "timestamp": 3.0, "file": "f3.0.jpg"}]}')
    rows = table(spark, sf, "part").select(text("/k/v", k, "_keyframes.json").alias("path"), F.when(k % 7 == 0, F.substring(value, 1, 60)).otherwise(value).alias("value"))
    return readers.keyframes_of(rows)


@query("SELECT o_orderkey AS query_id, o_orderpriority AS answer FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 9 <> 0")
def cached_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a cache without those with an error; every ninth line is broken."""
    k = F.col("o_orderkey")
    value = F.to_json(F.struct(k.alias("query_id"), F.col("o_orderpriority").alias("answer"), F.when(k % 4 == 0, "timeout").alias("error")))
    lines = table(spark, sf, "orders").select(F.when(k % 9 == 0, F.substring(value, 1, 12)).otherwise(value).alias("value"))
    return readers.cache_lines(lines, "query_id bigint, answer string")


@query(f"WITH {CANDIDATES_SQL}, {calibrated_sql()} SELECT rid AS id, round(t, 6) AS start_seconds, {r6('score')} FROM r WHERE event_id = 'click' AND video_id = 7")
def region_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = regions.listed(regions.atomic_regions(candidates(spark, sf)), "click", 7)
    return rows.select("id", F.round("start_seconds", 6).alias("start_seconds"), (F.round("normalized_coarse_score", 6) + 0.0).alias("score"))


@query("SELECT o_orderkey, o_custkey % 150 AS rank FROM orders WHERE o_orderkey % 5 <> 0 AND o_custkey % 150 <= 100")
def work_skip(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey") % 150).alias("rank"))
    return evaluate.worth_refining(rows)


@query(f"WITH {CANDIDATES_SQL}, {calibrated_sql()} SELECT rid AS id, round(CASE WHEN seq % 10 = 3 THEN 0.75 ELSE score END, 6) + 0.0 AS score FROM r")
def supplied_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A supplied normalised score stays, and its row counts in the population all the same."""
    c = candidates(spark, sf).withColumn("normalized_relevance_score", F.when(F.col("seq") % 10 == 3, 0.75))
    return regions.atomic_regions(c).select("id", (F.round("normalized_coarse_score", 6) + 0.0).alias("score"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'new_catches' ELSE 'new_accepts' END AS direction FROM labels WHERE (quality = 1) <> (toxic = 1)")
def validator_disagreements(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.disagreements(table(spark, sf, "labels"), "quality", "toxic").select("doc_id", "direction")


@query("""SELECT l_shipmode AS mode, count(s) AS calls, min(s) AS min, max(s) AS max, round(avg(s), 6) AS avg, round(sum(s), 4) AS total FROM (SELECT l_returnflag AS l_shipmode, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity::DOUBLE END AS s FROM lineitem) GROUP BY 1""")
def call_times(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("mode"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity").cast("double")).alias("s"))
    return evaluate.call_times(rows, "s", ["mode"]).select("mode", "calls", "min", "max", F.round("avg", 6).alias("avg"), F.round("total", 4).alias("total"))


@query("""SELECT o_orderkey AS video, l_linenumber AS event_id, l_quantity::DOUBLE AS anchor_seconds, round(l_quantity + l_discount, 6) AS refined_seconds, round(l_quantity + l_discount - l_quantity, 6) + 0.0 AS delta
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 6 <> 0""")
def refined_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Refined minus anchor times of nested events; every sixth item has none."""
    event = F.struct(F.col("l_linenumber").alias("event_id"), F.col("l_quantity").cast("double").alias("anchor_seconds"), (F.col("l_quantity") + F.col("l_discount")).alias("refined_seconds"))
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("video")).agg(F.collect_list(event).alias("events"))
    rows = rows.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("video")), "video").withColumn("events", F.when(F.col("video") % 6 != 0, F.col("events")))
    out = evaluate.refined_deltas(rows, ["video"], "events")
    return out.select("video", "event_id", "anchor_seconds", F.round("refined_seconds", 6).alias("refined_seconds"), (F.round("delta", 6) + 0.0).alias("delta"))


AUDIT_SQL = "e AS (SELECT DISTINCT l_orderkey AS video FROM lineitem WHERE l_quantity > 40)"


@query(f"WITH {AUDIT_SQL} SELECT o_orderkey AS video, 'skip' AS mode, true AS expected FROM orders JOIN e ON o_orderkey = video UNION ALL SELECT o_orderkey, 'keep', video IS NOT NULL FROM orders LEFT JOIN e ON o_orderkey = video")
def expected_video_modes(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("video"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("video"))
    skip = evaluate.audited(rows, names, "skip").select("video", F.lit("skip").alias("mode"), F.lit(True).alias("expected"))
    return skip.union(evaluate.audited(rows, names, "keep").select("video", F.lit("keep"), "expected"))


# every tenth hit sets a pin on its user, and every error rejects its user
@query("""WITH p AS (SELECT user_id, event_id FROM events WHERE event_id % 10 = 0), j AS (SELECT user_id, max(event_id) AS at FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT p.event_id::VARCHAR AS event_id, p.user_id AS fixed_video_id FROM p LEFT JOIN j USING (user_id) WHERE j.at IS NULL OR p.event_id > j.at""")
def standing_pins(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    pins = e.where("event_id % 10 = 0").select(F.lit("s").alias("session_id"), F.col("event_id").cast("string").alias("event_id"), F.col("user_id").alias("fixed_video_id"), F.col("event_id").alias("seq"))
    edits = e.select(F.lit("s").alias("session_id"), F.col("user_id").alias("video_id"), F.when(F.col("event_type") == "error", "reject").otherwise("allow").alias("action"), F.col("event_id").alias("seq"))
    return constraints.standing_pins(pins, edits).select("event_id", "fixed_video_id")


@query("""WITH e AS (SELECT * FROM (VALUES (0, 'view'), (1, 'click')) t(pos, event)) SELECT event_id, event, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 50) * 60 + event_id % 60 END::DOUBLE AS seconds FROM events JOIN e ON event_id % 4 = pos""")
def mapped_times(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of a result mapped to events, with their display times parsed; every third time can't be."""
    i = F.col("event_id")
    shown = F.when(i % 3 == 0, "x:1").otherwise(text(i % 50, ":", i % 60))
    hits = table(spark, sf, "events").select("event_id", (i % 4).cast("int").alias("query"), shown.alias("timestamp"))
    return evaluate.map_frames(hits, spark.createDataFrame([(0, "view"), (1, "click")], "pos int, event string")).select("event_id", "event", "seconds")
