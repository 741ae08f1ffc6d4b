"""Sequence match, retrieval and nearest-time queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieve, sequence
from ..tables import ORIGIN, table
from .ranking import r6, rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


#: Frames are whole hours here, so that the default distance weight keeps its meaning.
HITS_SQL = f"""h AS (SELECT user_id AS video, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 9 END AS query,
  (epoch_us(ts) - {ORIGIN}) // 3600000000 AS frame, value AS score, event_id AS seq FROM events)"""


def hits(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("event_type")
    q = F.when(t == "view", 0).when(t == "click", 1).when(t == "purchase", 2).otherwise(9)
    frame = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - ORIGIN) / 3600000000)
    return table(spark, sf, "events").select(F.col("user_id").alias("video"), q.alias("query"), frame.alias("frame"), F.col("value").alias("score"))


def match_sql(ordered: bool, k: int, objects: str = "") -> str:
    order = "AND a.frame <= b.frame AND b.frame <= c.frame" if ordered else ""
    frames = "a.frame || ':0,' || b.frame || ':1,' || c.frame || ':2'" if ordered else "array_to_string([x.f || ':' || x.q for x in list_sort([{'f': a.frame, 'q': 0}, {'f': b.frame, 'q': 1}, {'f': c.frame, 'q': 2}])], ',')"
    key = "[{'f': a.frame, 'q': 0}, {'f': b.frame, 'q': 1}, {'f': c.frame, 'q': 2}]"
    key = key if ordered else f"list_sort({key})"
    return f"""WITH {HITS_SQL}{objects},
m AS (SELECT a.video, abs(b.frame - a.frame) + abs(c.frame - b.frame) + abs(c.frame - a.frame) AS distance,
  (a.score + b.score + c.score) / 3 / (1 + (abs(b.frame - a.frame) + abs(c.frame - b.frame) + abs(c.frame - a.frame)) * 0.05) AS score, {frames} AS hits, {key} AS k
  FROM {"ho" if objects else "h"} a JOIN {"ho" if objects else "h"} b ON a.video = b.video JOIN {"ho" if objects else "h"} c ON a.video = c.video
  WHERE a.query = 0 AND b.query = 1 AND c.query = 2 {order} {"AND (a.ok OR b.ok OR c.ok)" if objects else ""})
SELECT video, distance::BIGINT AS distance, {r6("score")}, hits FROM m ORDER BY round(m.score, 9) DESC, video, k LIMIT {k}"""


def shown(top: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("hits", lambda x: F.concat_ws(":", x.frame.cast("string"), x.query.cast("string"))), ",")
    return top.select("video", F.col("distance").cast("long").alias("distance"), *rounded("score"), text.alias("hits"))


@query(match_sql(True, 100))
def ordered_sequence_topk(spark: SparkSession, sf: str) -> DataFrame:
    return shown(sequence.top_matches(hits(spark, sf), 3, 100))


@query(match_sql(False, 100))
def unordered_sequence_topk(spark: SparkSession, sf: str) -> DataFrame:
    return shown(sequence.top_matches(hits(spark, sf), 3, 100, ordered=False))


# detections follow from the hits: a keyframe's number is its hit's, and shows a lantern where the value is high
OBJECTS_SQL = """,
kf AS (SELECT video, frame, n FROM (SELECT video, frame, (seq % 2000)::INT AS n, row_number() OVER (PARTITION BY video, frame ORDER BY seq) AS k FROM h) WHERE k = 1),
de AS (SELECT user_id AS video, (event_id % 2000)::INT AS n, max(CASE WHEN value > 20 THEN 1 ELSE 0 END) AS lit FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2),
ho AS (SELECT h.*, coalesce(de.lit = 1, false) AS ok FROM h LEFT JOIN kf USING (video, frame) LEFT JOIN de ON de.video = h.video AND de.n = kf.n)"""


@query(match_sql(True, 50, OBJECTS_SQL))
def sequence_object_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events")
    base = hits(spark, sf)
    frame = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - ORIGIN) / 3600000000)
    n = F.pmod("event_id", F.lit(2000)).cast("int")
    keyframes = rows.select(F.col("user_id").alias("video"), frame.alias("frame"), n.alias("n"), F.col("event_id").alias("seq"))
    seen = rows.where("event_id % 3 = 0").groupBy(F.col("user_id").alias("video"), n.alias("n")).agg(F.max("value").alias("v"))
    lit = F.array(F.when(F.col("v") > 20, "Lantern").otherwise("Road"), F.lit("Tree"))
    detections = seen.select("video", "n", lit.alias("entities"), F.array(F.lit(0.8), F.lit(0.9), F.lit(0.1)).alias("scores"))
    return shown(sequence.top_matches(sequence.satisfied(base, keyframes, detections, ["lantern", "TREE"]), 3, 50, objects=True))


@query(f"""WITH {HITS_SQL} SELECT video, array_to_string([x.f || ':' || x.q || ':' || round(x.s * 100)::BIGINT for x in list_sort(list({{'f': frame, 'q': query, 's': score}}))], ',') AS hits FROM h GROUP BY video""")
def grouped_hits(spark: SparkSession, sf: str) -> DataFrame:
    rows = sequence.grouped(hits(spark, sf))
    text = F.array_join(F.transform("hits", lambda x: F.concat_ws(":", x.frame.cast("string"), x["query"].cast("string"), F.round(x.score * 100).cast("long").cast("string"))), ",")
    return rows.select("video", text.alias("hits"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
f AS (SELECT vec_id AS frame_id, label AS video, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 <> 0),
s AS (SELECT query_id, frame_id, video, list_dot_product(q.v, f.v) AS score FROM q, f),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) AS rank FROM s)
SELECT query_id, frame_id, video::BIGINT AS video, round(score, 6) + 0.0 AS score, rank FROM r WHERE rank <= 25""")
def topk_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    f = e.where("vec_id % 20 <> 0").select(F.col("vec_id").alias("frame_id"), F.col("label").cast("long").alias("video"), F.col("embedding").alias("vector"))
    return retrieve.top_k(q, f, 25).select("query_id", "frame_id", "video", *rounded("score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH t AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
b AS (SELECT vec_id, v, list_transform(v[1:16], lambda x: x / sqrt(list_dot_product(v[1:16], v[1:16]))) AS w FROM t)
SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) + 0.0 AS anchor, round((v[1] + v[2]) / sqrt(2 * list_dot_product(v, v)), 6) + 0.0 AS pre, round(w[1], 6) + 0.0 AS cut_first, round(w[16], 6) + 0.0 AS cut_last FROM b""")
def embedding_curves(spark: SparkSession, sf: str) -> DataFrame:
    axis = lambda *on: [1.0 if i in on else 0.0 for i in range(64)]
    rows = retrieve.curves(table(spark, sf, "embeddings"), "embedding", {"anchor": axis(0), "pre": axis(0, 1)})
    w = retrieve.truncated(F.col("embedding"), 16)
    rows = rows.withColumns({"cut_first": F.element_at(w, 1), "cut_last": F.element_at(w, 16)})
    return rows.select("vec_id", *rounded("anchor", "pre", "cut_first", "cut_last"))


# every event type is queried in four variants: by quarter of the id, so that one user's hour may stand in several
@query(f"""WITH v AS (SELECT event_type AS event_id, (event_id % 4)::VARCHAR AS variant, user_id AS video_id, (epoch_us(ts) - {ORIGIN}) // 21600000000 AS frame_id, (epoch_us(ts) - {ORIGIN}) / 1e6 AS t, value AS raw FROM events),
a AS (SELECT *, row_number() OVER (PARTITION BY event_id, variant, video_id, frame_id ORDER BY raw DESC, t) AS k FROM v),
b AS (SELECT *, row_number() OVER (PARTITION BY event_id, variant ORDER BY raw DESC, video_id, frame_id) AS rank FROM a WHERE k = 1),
s AS (SELECT event_id, video_id, frame_id, sum(1 / (60 + rank)) AS score, arg_max(t, (raw, variant)) AS t, string_agg(variant, ',' ORDER BY variant) AS variants FROM b WHERE rank <= 50 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(score, 9) DESC, video_id, frame_id) AS rank FROM s)
SELECT event_id, video_id, frame_id, {r6("score")}, round(t, 3) AS t, variants, rank FROM r WHERE rank <= 100""")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - ORIGIN
    rows = table(spark, sf, "events").select(
        F.lit("s").alias("session_id"), F.col("event_type").alias("event_id"), F.pmod("event_id", F.lit(4)).cast("string").alias("variant"),
        F.col("user_id").alias("video_id"), F.floor(micros / 21600000000).alias("frame_id"), (micros / 1e6).alias("timestamp_seconds"), F.col("value").alias("raw"),
    )
    out = retrieve.fused(rows)
    return out.select("event_id", "video_id", "frame_id", *rounded("score"), F.round("timestamp_seconds", 3).alias("t"), F.array_join("variants", ",").alias("variants"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH k AS (SELECT user_id AS video, (epoch_us(ts) - {ORIGIN}) // 1000000 AS t, event_id AS seq FROM events WHERE event_type = 'view'),
p AS (SELECT event_id AS probe_id, user_id AS video, (epoch_us(ts) - {ORIGIN}) // 1000000 AS t FROM events WHERE event_type <> 'view'),
d AS (SELECT p.*, k.seq, abs(k.t - p.t) AS distance, row_number() OVER (PARTITION BY probe_id ORDER BY abs(k.t - p.t) NULLS LAST, k.seq) AS n FROM p LEFT JOIN k ON p.video = k.video)
SELECT probe_id, video, seq::VARCHAR AS file, distance::BIGINT AS distance FROM d WHERE n = 1""")
def nearest_keyframe(spark: SparkSession, sf: str) -> DataFrame:
    t = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - ORIGIN) / 1000000)
    rows = table(spark, sf, "events").select(F.col("user_id").alias("video"), t.alias("t"), "event_id", "event_type")
    k = rows.where("event_type = 'view'").select("video", "t", F.col("event_id").cast("string").alias("file"), F.col("event_id").alias("seq"))
    p = rows.where("event_type <> 'view'").select(F.col("event_id").alias("probe_id"), "video", "t")
    return retrieve.nearest(p, k).select("probe_id", "video", "file", F.col("distance").cast("long").alias("distance"))
