"""Small look-ups, listings and joins, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import first_anchor
from ..operators import evaluate, rank, regions, runs
from ..sources import readers, sinks
from ..tables import CANDIDATES_SQL, ORIGIN, candidates, table
from .ranking import r6, rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {CANDIDATES_SQL} SELECT video_id, count(*) AS regions, round(max(raw), 6) + 0.0 AS best FROM c GROUP BY video_id")
def video_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Regions and best raw score of each video."""
    rows = regions.atomic_regions(candidates(spark, sf)).groupBy("video_id").agg(F.count("*").alias("regions"), F.max("raw_coarse_score").alias("best"))
    return rows.orderBy(F.desc("best"), "video_id").select("video_id", "regions", *rounded("best"))


@query("SELECT user_id AS video_id, arg_min('u' || event_id, event_id) AS watch_url FROM events WHERE event_id % 3 = 0 GROUP BY user_id")
def watch_url_first(spark: SparkSession, sf: str) -> DataFrame:
    url = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("u"), "id"))
    return rank.watch_urls(candidates(spark, sf).withColumn("watch_url", url)).select("video_id", "watch_url")


@query(f"WITH {CANDIDATES_SQL} SELECT id, video_id, {r6('raw')} FROM c WHERE video_id NOT IN (SELECT user_id FROM events WHERE value > 250) ORDER BY c.raw DESC, seq LIMIT 40")
def overfetch_topk(spark: SparkSession, sf: str) -> DataFrame:
    c = candidates(spark, sf)
    bad = c.where("raw_relevance_score > 250").select("video_id")
    rows = rank.overfetch(c, bad, [F.desc("raw_relevance_score"), F.asc("seq")], 40)
    return rows.select("id", "video_id", (F.round("raw_relevance_score", 6) + 0.0).alias("raw"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) ORDER BY o_orderkey LIMIT 50")
def first_subset(spark: SparkSession, sf: str) -> DataFrame:
    """The first 50 queries, by key, that the manifest doesn't name."""
    named = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(named, "o_orderkey", "left_anti").orderBy("o_orderkey").limit(50)


@query("SELECT c_custkey, round(coalesce(CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END, c_custkey::DOUBLE), 6) + 0.0 AS score FROM customer ORDER BY 2 DESC, 1 LIMIT 30")
def sorted_by_score(spark: SparkSession, sf: str) -> DataFrame:
    """Top rows by a chosen column, a second one where it is null."""
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(k, F.coalesce(F.when(k % 4 != 0, F.col("c_acctbal")), k.cast("double")).alias("score"))
    return rows.orderBy(F.desc("score"), "c_custkey").limit(30).select("c_custkey", *rounded("score"))


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey % 30 END AS rank FROM orders)
SELECT o_orderkey, rank, (coalesce(rank <= 1, false))::INT AS hit_at_1, (coalesce(rank <= 5, false))::INT AS hit_at_5, (coalesce(rank <= 20, false))::INT AS hit_at_20 FROM r""")
def hit_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey") % 30).alias("rank"))
    return sinks.with_hits(rows, (1, 5, 20))


@query("""WITH l AS (SELECT l_orderkey AS video, l_linenumber AS pos, min(l_returnflag) AS rel FROM lineitem GROUP BY ALL), n AS (SELECT video, count(*) AS n FROM l GROUP BY 1)
SELECT l.video, l.pos, CASE WHEN n.n % 2 = 0 THEN l.rel END AS rel FROM l JOIN n USING (video)""")
def attached_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Cached relations by position: the cache has a row too many for orders with an odd number of lines."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("video"), F.col("l_linenumber").alias("pos")).agg(F.min("l_returnflag").alias("rel"))
    odd = lines.groupBy("video").agg(F.count("*").alias("n")).where("n % 2 = 1").select("video", F.lit(99).alias("pos"), F.lit("x").alias("rel"))
    return evaluate.attach_relations(lines.select("video", "pos"), lines.union(odd)).select("video", "pos", "rel")


@query("""WITH e AS (SELECT * FROM (VALUES (0, 'view'), (1, 'click')) t(pos, event))
SELECT event_id, event FROM events JOIN e ON event_id % 4 = pos""")
def mapped_frames(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "events").select("event_id", (F.col("event_id") % 4).cast("int").alias("query"))
    return evaluate.map_frames(hits, spark.createDataFrame([(0, "view"), (1, "click")], "pos int, event string")).select("event_id", "event")


@query(f"SELECT user_id AS video, (epoch_us(ts) - {ORIGIN}) // 21600000000 AS frame, arg_min(event_id, event_id) AS n FROM events GROUP BY ALL")
def keyframe_first_row(spark: SparkSession, sf: str) -> DataFrame:
    """The first row of each frame of a keyframe map counts."""
    frame = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - ORIGIN) / 21600000000)
    rows = table(spark, sf, "events").select(F.col("user_id").alias("video"), frame.alias("frame"), F.col("event_id").alias("n"), F.col("event_id").alias("seq"))
    return readers.first_rows(rows, ["video", "frame"], "seq").drop("seq")


@query("""WITH f AS (SELECT 'v' || p_size AS video, p_partkey AS frame, '/k/v' || p_size || '/v' || p_size || '_f' || lpad(p_partkey::VARCHAR, 6, '0') || '.jpg' AS path FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame, path) AS k FROM f) SELECT video, frame, path FROM r WHERE k <= 3""")
def keyframe_listing(spark: SparkSession, sf: str) -> DataFrame:
    video = F.concat(F.lit("v"), F.col("p_size").cast("string"))
    path = F.concat(F.lit("/k/"), video, F.lit("/"), video, F.lit("_f"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit(".jpg"))
    return readers.keyframe_files(table(spark, sf, "part").select(path.alias("path")), 3)


@query("""SELECT n_nationkey, sha256('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}|v1') AS digest FROM nation""")
def row_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", runs.row_fingerprint(["n_nationkey", "n_name"], "v1").alias("digest"))


@query(f"""WITH {CANDIDATES_SQL}, s AS (SELECT video_id, event_id, list(t ORDER BY raw DESC, seq) AS seeds FROM c GROUP BY ALL)
SELECT video_id, event_id, round(seeds[1], 6) AS anchor, len(seeds) AS seeds FROM s""")
def first_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """A list of seeds stands for its first."""
    first = F.min_by("timestamp_seconds", F.struct(-F.col("raw_relevance_score"), "seq"))
    rows = candidates(spark, sf).groupBy("video_id", "event_id").agg(first.alias("anchor"), F.count("*").alias("seeds"))
    return rows.select("video_id", "event_id", F.round("anchor", 6).alias("anchor"), "seeds")


@query(f"""WITH {CANDIDATES_SQL}, s AS (SELECT video_id, event_id, list(t ORDER BY raw DESC, seq) AS seeds FROM c GROUP BY ALL)
SELECT video_id, event_id, seeds[1] AS anchor, seeds[1] AS from_text FROM s""")
def primary_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Anchors of seed lists, and of the same as JSON text, where a single seed stands as a number."""
    seeds = F.array_sort(F.collect_list(F.struct((-F.col("raw_relevance_score")).alias("r"), "seq", F.col("timestamp_seconds").alias("t"))))
    rows = candidates(spark, sf).groupBy("video_id", "event_id").agg(F.transform(seeds, lambda x: x.t).alias("seeds"))
    text = F.when(F.size("seeds") == 1, F.col("seeds")[0].cast("string")).otherwise(F.to_json("seeds"))
    rows = rows.withColumn("text", text)
    return rows.select("video_id", "event_id", first_anchor(rows, "seeds").alias("anchor"), first_anchor(rows, "text").alias("from_text"))


@query("""SELECT o_orderkey, to_json(list(l_linenumber ORDER BY l_linenumber))::VARCHAR AS lines, '{"status":"' || any_value(o_orderstatus) || '","customer":' || any_value(o_custkey) || '}' AS about
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def export_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The CSV form of rows with nested columns."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("lines"))
    orders = table(spark, sf, "orders").select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer")).alias("about"))
    return sinks.flat(orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "lines", "about"))
