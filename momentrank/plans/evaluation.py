"""Evaluation and run queries, and their SQL.

Retrieval results come from ``embeddings``: every twentieth vector asks, the rest are frames, a label is a video, and the truth
is the asker's own label shifted by its id, so that ranks differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import constraints, evaluate, retrieve, runs
from ..operators.tuples import Params, ranked_videos, swept
from ..tables import CANDIDATES_SQL, table, written
from . import ranking
from .ranking import EVENTS, HOUR, calibrated_sql, pool_sql, r6, rounded, tuples_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


HITS_SQL = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, (label + vec_id // 20) % 10 AS truth FROM embeddings WHERE vec_id % 20 = 0),
f AS (SELECT vec_id AS frame_id, label AS video, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 <> 0),
h AS (SELECT query_id, video, score FROM (SELECT query_id, frame_id, video, list_dot_product(q.v, f.v) AS score,
      row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(q.v, f.v) DESC, frame_id) AS k FROM q, f) WHERE k <= 40)"""


def hits(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    f = e.where("vec_id % 20 <> 0").select(F.col("vec_id").alias("frame_id"), F.col("label").cast("long").alias("video"), F.col("embedding").alias("vector"))
    return retrieve.top_k(q, f, 40).select("query_id", "video", "score")


def truth(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(
        F.col("vec_id").alias("query_id"), F.pmod(F.col("label") + F.floor(F.col("vec_id") / 20), F.lit(10)).alias("video")
    )


SCORES_SQL = {
    "max": "max(score)",
    "topm": "list_avg(list_reverse_sort(list(score))[1:3])",
    "logsumexp": "max(score) + 0.2 * ln(list_sum([exp((x - list_max(list(score))) / 0.2) for x in list(score)]))",
    "rrf": "list_sum([1 / (60.0 + i) for i in range(1, count(*) + 1)])",
}


def scores_sql(method: str) -> str:
    if method == "logsumexp":
        return f"WITH {HITS_SQL}, m AS (SELECT query_id, video, max(score) AS best, count(*) AS hit_count FROM h GROUP BY ALL), s AS (SELECT query_id, video, best + 0.2 * ln(sum(exp((score - best) / 0.2))) AS score, hit_count, best FROM h JOIN m USING (query_id, video) GROUP BY query_id, video, best, hit_count)"
    return f"WITH {HITS_SQL}, s AS (SELECT query_id, video, {SCORES_SQL[method]} AS score, count(*) AS hit_count, max(score) AS best FROM h GROUP BY ALL)"


def _aggregated(name: str, method: str, **options) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = evaluate.video_scores(hits(spark, sf), method, **options)
        return rows.select("query_id", "video", *rounded("score"), "hit_count", *rounded("best"))

    QUERIES[f"video_agg_{name}"] = run
    ORACLES[f"video_agg_{name}"] = f"{scores_sql(name)} SELECT query_id, video::BIGINT AS video, {r6('score')}, hit_count, {r6('best')} FROM s"


_aggregated("max", "max")
_aggregated("topm", "top_m_mean", top_m=3)
_aggregated("logsumexp", "logsumexp", temperature=0.2)
_aggregated("rrf", "rrf")

RANKS_SQL = f"""{scores_sql("max")},
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, video) AS rank FROM s),
u AS (SELECT query_id, count(*) AS unique_videos FROM s GROUP BY query_id),
t AS (SELECT q.query_id, k.rank, coalesce(u.unique_videos, 0) AS unique_videos FROM q LEFT JOIN k ON k.query_id = q.query_id AND k.video = q.truth LEFT JOIN u ON u.query_id = q.query_id)"""


@query(f"{RANKS_SQL} SELECT query_id, rank, unique_videos FROM t")
def rank_of_truth(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.truth_ranks(evaluate.video_scores(hits(spark, sf)), truth(spark, sf))


#: Every seventh request failed, and latencies follow from the id.
RESULTS_SQL = f"""{RANKS_SQL},
r AS (SELECT query_id, CASE WHEN query_id % 140 = 20 THEN 'error' ELSE 'ok' END AS status, CASE WHEN query_id % 140 = 20 OR query_id % 60 = 0 THEN NULL ELSE rank END AS rank,
      CASE WHEN query_id % 100 = 40 THEN 0 ELSE unique_videos END AS unique_videos, (query_id % 97) * 1.5 AS latency_ms FROM t)"""


def results(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("query_id")
    rows = rank_of_truth(spark, sf)
    failed = i % 140 == 20
    return rows.select(
        i, F.when(failed, "error").otherwise("ok").alias("status"), F.when(~(failed | (i % 60 == 0)), F.col("rank")).alias("rank"),
        F.when(i % 100 == 40, 0).otherwise(F.col("unique_videos")).alias("unique_videos"), ((i % 97) * 1.5).alias("latency_ms"),
    )


def metrics_sql(ks: tuple[int, ...]) -> str:
    parts = [f"round(avg(CASE WHEN status = 'ok' AND rank <= {k} THEN 1.0 ELSE 0 END), 6) AS recall_at_{k}, round(avg(CASE WHEN status = 'ok' THEN CASE WHEN rank <= {k} THEN 1.0 ELSE 0 END END), 6) AS ok_recall_at_{k}" for k in ks]
    ok = "CASE WHEN status = 'ok' THEN {} END".format
    return f"""count(*) AS query_count, count(*) FILTER (status = 'ok') AS evaluated_count, count(*) FILTER (status <> 'ok') AS error_count, {", ".join(parts)},
round(avg(coalesce({ok("1 / rank")}, 0)), 6) AS mrr, round(avg({ok("coalesce(1 / rank, 0)")}), 6) AS ok_mrr, median({ok("coalesce(rank, unique_videos + 1)")})::DOUBLE AS median_rank,
median({ok("rank")})::DOUBLE AS median_rank_found, count({ok("rank")}) AS found, count(*) FILTER (status = 'ok' AND rank IS NULL) AS missed, min({ok("unique_videos")}) AS videos_min,
median({ok("unique_videos")})::DOUBLE AS videos_median, round(avg({ok("unique_videos")}), 6) AS videos_mean, max({ok("unique_videos")}) AS videos_max, round(avg({ok("latency_ms")}), 6)::DOUBLE AS mean_latency_ms"""


def _rounded_all(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"{RESULTS_SQL} SELECT {metrics_sql((1, 5, 10))} FROM r")
def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_all(evaluate.retrieval_metrics(results(spark, sf), (1, 5, 10)))


@query(f"""{RESULTS_SQL} SELECT count(*) AS queries_total, count(rank) AS queries_with_truth, {", ".join(f"round(coalesce(avg(CASE WHEN rank IS NOT NULL THEN CASE WHEN rank <= {k} THEN 1.0 ELSE 0 END END), 0), 6)::DOUBLE AS recall_at_{k}" for k in (1, 5, 10))},
round(coalesce(avg(1 / rank), 0), 6) AS mrr, median(rank)::DOUBLE AS median_rank FROM r""")
def retrieval_metrics_found(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_all(evaluate.found_metrics(results(spark, sf)))


@query(f"{RESULTS_SQL} SELECT CASE WHEN status <> 'ok' THEN 'error' WHEN unique_videos = 0 THEN 'empty' ELSE 'other' END AS bucket, count(*) AS queries FROM r WHERE status <> 'ok' OR rank IS NULL GROUP BY 1")
def failure_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.failure_buckets(results(spark, sf))


EFFECT_SQL = f"""WITH {HITS_SQL}, s AS (SELECT query_id, video, max(score) AS a, avg(score) AS b FROM h GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(a, 9) DESC, video) AS rank_a, row_number() OVER (PARTITION BY query_id ORDER BY round(b, 9) DESC, video) AS rank_b FROM s)"""


@query(f"{EFFECT_SQL} SELECT q.query_id, rank_a, rank_b, rank_a IS DISTINCT FROM rank_b AS moved FROM q LEFT JOIN k ON k.query_id = q.query_id AND k.video = q.truth")
def sort_key_effect(spark: SparkSession, sf: str) -> DataFrame:
    items = hits(spark, sf).groupBy("query_id", "video").agg(F.max("score").alias("a"), F.avg("score").alias("b"))
    return evaluate.sort_key_effect(items, truth(spark, sf), "a", "b")


# anchors are a user's best hits of a type; answers are a day around the median one
INTERVAL_SQL = f"""WITH {CANDIDATES_SQL}, a AS (SELECT video_id AS video, event_id AS event, arg_max(t, (raw, -seq)) AS anchor, median(t) AS mid FROM c GROUP BY ALL),
w AS (SELECT video, sum(CASE WHEN anchor BETWEEN mid - 345600 AND mid + 345600 THEN 1 ELSE 0 END)::BIGINT AS hits FROM a WHERE event <> 'error' GROUP BY video)"""


def video_hits(spark: SparkSession, sf: str) -> DataFrame:
    c = ranking.candidates(spark, sf)
    a = c.groupBy(F.col("video_id").alias("video"), F.col("event_id").alias("event")).agg(F.max_by("timestamp_seconds", F.struct("raw_relevance_score", -F.col("seq"))).alias("anchor"), F.median("timestamp_seconds").alias("mid"))
    answers = a.where("event <> 'error'").select("video", "event", (F.col("mid") - 345600).alias("start_seconds"), (F.col("mid") + 345600).alias("end_seconds"))
    return evaluate.interval_hits(a.select("video", "event", "anchor"), answers)


@query(f"{INTERVAL_SQL} SELECT video, hits FROM w")
def hits_in_interval(spark: SparkSession, sf: str) -> DataFrame:
    return video_hits(spark, sf)


def at_k(k: int) -> str:
    return f"CASE WHEN rank <= {k} THEN hits ELSE 0 END"


HIT_RECALLS = ", ".join(f"round(avg({at_k(k)}), 6) AS hit_recall_at_{k}" for k in evaluate.KS)
FINAL = f"round(avg(({' + '.join(at_k(k) for k in evaluate.KS)}) / 5), 6) AS final_score"


@query(f"{INTERVAL_SQL}, x AS (SELECT video, hits, CASE WHEN video % 9 = 0 THEN NULL ELSE video % 120 + 1 END AS rank FROM w) SELECT {HIT_RECALLS}, {FINAL} FROM x")
def hit_weighted_recall(spark: SparkSession, sf: str) -> DataFrame:
    rows = video_hits(spark, sf).withColumn("rank", F.when(F.col("video") % 9 != 0, F.col("video") % 120 + 1))
    return _rounded_all(rows.agg(*evaluate.hit_recalls()))


#: Configurations of the sweep: the pool's width and the order weight. Every video asks once; its rank is its place.
CONFIGS = [("narrow_0", 0.1, 0.0), ("narrow_1", 0.1, 1.2), ("wide_0", 0.3, 0.0), ("wide_1", 0.3, 1.2)]


def sweep_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Long rows (config, video, rank, hits), from one pass over the regions for all configurations."""
    configs = {name: Params(delta=delta, order_weight=weight, gap_tau=25 * HOUR, gap_weight=0.05 / HOUR) for name, delta, weight in CONFIGS}
    videos = ranked_videos(swept(ranking.atomic(spark, sf), EVENTS, configs))
    ranked = evaluate.places(videos.select("config", F.col("video_id").alias("video"), F.round("priority_score", 9).alias("p")), ["config"], "p")
    hits_ = video_hits(spark, sf)
    return ranked.hint("merge").join(hits_.hint("merge"), "video", "left").select("config", "video", "rank", F.coalesce("hits", F.lit(0)).alias("hits"))


def sweep_sql() -> str:
    parts = []
    for i, (name, delta, weight) in enumerate(CONFIGS):
        p = Params(delta=delta, order_weight=weight, gap_tau=25 * HOUR, gap_weight=0.05 / HOUR)
        inner = f"{pool_sql(delta=delta)}, {tuples_sql(EVENTS, p)}, {ranking.videos_sql()}"
        parts.append(f"""c{i} AS (WITH {inner} SELECT '{name}' AS config, video_id AS video, rank() OVER (ORDER BY round(priority_score, 9) DESC) AS rank FROM v2)""")
    union = " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(len(CONFIGS)))
    recalls = ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0 END), 6) AS recall_at_{k}" for k in evaluate.KS)
    return f"""{INTERVAL_SQL}, {calibrated_sql()}, {", ".join(parts)}, x AS (SELECT u.config, u.video, u.rank, coalesce(w.hits, 0) AS hits FROM ({union}) u LEFT JOIN w USING (video))
SELECT config, count(*) AS query_count, {recalls}, round(avg(1 / rank), 6) AS mrr, count(rank) AS found, median(rank)::DOUBLE AS median_rank_found, round(avg(hits), 6) AS mean_hits, {FINAL} FROM x GROUP BY config"""


@query(sweep_sql())
def sweep_report(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_all(evaluate.sweep_report(sweep_rows(spark, sf)))


@query("""SELECT count(*) AS entries, count(*) FILTER (quality = 1) AS old_flagged, count(*) FILTER (toxic = 1) AS new_flagged, count(*) FILTER ((quality = 1) = (toxic = 1)) AS agreements,
count(*) FILTER (toxic = 1 AND quality <> 1) AS new_catches, count(*) FILTER (quality = 1 AND toxic <> 1) AS new_accepts FROM labels""")
def validator_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.agreement(table(spark, sf, "labels"), "quality", "toxic")


@query("SELECT o_orderpriority AS label, l_linestatus || l_returnflag AS status, count(*) AS items FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.concat("l_linestatus", "l_returnflag").alias("status"))).alias("items"))
    rows = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return evaluate.status_counts(rows.withColumnRenamed("o_orderpriority", "label"), "label", "items")


@query("""SELECT round(avg(CASE WHEN abs(l_quantity - 25) <= 1 THEN 1.0 ELSE 0 END), 6) AS within_1s, round(avg(CASE WHEN abs(l_quantity - 25) <= 2 THEN 1.0 ELSE 0 END), 6) AS within_2s,
round(avg(abs(l_quantity - 25)), 6) AS mean_error, median(abs(l_quantity - 25)) AS median_error, round(quantile_cont(l_extendedprice, 0.5), 6) AS latency_p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS latency_p95 FROM lineitem""")
def boundary_errors(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select((F.col("l_quantity") - 25).alias("error_seconds"), F.col("l_extendedprice").alias("latency_ms"))
    return _rounded_all(evaluate.boundary_errors(rows))


@query("""WITH g AS (SELECT l_orderkey AS k, sum(l_quantity) AS s, count(l_quantity) AS n FROM lineitem GROUP BY 1),
u AS (SELECT s, n, draw, (('0x' || md5(k || ':' || draw || ':7')[1:7])::BIGINT + 0.5::DOUBLE) / 268435456 AS u FROM g, (SELECT unnest(range(1, 101)) AS draw)),
w AS (SELECT draw, s, n, (u > 0.36787944117144233)::INT + (u > 0.73575888234288467)::INT + (u > 0.91969860292860584)::INT + (u > 0.98101184312384615)::INT + (u > 0.99634015317265626)::INT
  + (u > 0.99940581518241834)::INT + (u > 0.99991675885071205)::INT + (u > 0.99998975080332543)::INT AS w FROM u),
m AS (SELECT draw, sum(s * w) / sum(n * w) AS mean FROM w GROUP BY draw)
SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m""")
def bootstrap_interval(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_all(evaluate.bootstrap(table(spark, sf, "lineitem"), "l_quantity", "l_orderkey"))


# the log of attempts: each line of an order is an attempt at it
LOG_SQL = "l AS (SELECT l_orderkey AS query_id, l_linenumber AS attempt, CASE l_returnflag WHEN 'R' THEN 'retry' WHEN 'A' THEN 'error' ELSE 'ok' END AS status, l_extendedprice AS cost, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS k FROM lineitem)"


def log(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", "retry").when(F.col("l_returnflag") == "A", "error").otherwise("ok")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), order.alias("attempt"), status.alias("status"), F.col("l_extendedprice").alias("cost"))


@query(f"WITH {LOG_SQL} SELECT query_id, attempt, status, cost FROM l WHERE k = 1")
def latest_attempt(spark: SparkSession, sf: str) -> DataFrame:
    return runs.latest(log(spark, sf), ["query_id"], "attempt").select("query_id", F.col("attempt.l_linenumber").alias("attempt"), "status", "cost")


@query(f"WITH {LOG_SQL} SELECT o_orderkey AS query_id FROM orders WHERE o_orderkey NOT IN (SELECT query_id FROM l WHERE k = 1 AND status IN ('ok', 'error'))")
def pending_work(spark: SparkSession, sf: str) -> DataFrame:
    return runs.pending(table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id")), log(spark, sf))


@query("""WITH e AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 10)
SELECT CASE WHEN l_orderkey IS NULL THEN 'missing' ELSE 'expected' END AS state, count(*) AS queries FROM orders LEFT JOIN e ON o_orderkey = l_orderkey GROUP BY 1""")
def manifest_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Queries whose video the manifest names, and those it misses."""
    names = table(spark, sf, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    rows = table(spark, sf, "orders").select("o_orderkey")
    one = lambda state, df: df.agg(F.count("*").alias("queries")).select(F.lit(state).alias("state"), "queries").where("queries > 0")
    return one("missing", rows.join(names, "o_orderkey", "left_anti")).union(one("expected", rows.join(names, "o_orderkey", "left_semi")))


@query(f"""WITH {CANDIDATES_SQL} SELECT event_id, count(*) AS hits, round(sum(raw), 4) AS total FROM (
  SELECT event_id, raw FROM c WHERE event_id NOT IN ('view', 'click') UNION ALL SELECT event_id, raw * 2 FROM c WHERE event_id = 'view' AND video_id % 2 = 0) GROUP BY event_id""")
def replace_by_event(spark: SparkSession, sf: str) -> DataFrame:
    old = ranking.candidates(spark, sf)
    new = old.where("event_id = 'view' and video_id % 2 = 0").withColumn("raw_relevance_score", F.col("raw_relevance_score") * 2)
    names = spark.createDataFrame([("s", "view"), ("s", "click")], "session_id string, event_id string")
    return runs.replace_events(old, new, names).groupBy("event_id").agg(F.count("*").alias("hits"), F.round(F.sum("raw_relevance_score"), 4).alias("total"))


# a customer's settings are two snapshots, both with the balance cut to whole thousands (DuckDB's // leaves doubles uncut, and the sign of
# -0.0 would be a change): as they are, and with some balances raised or gone and some segments renamed; a repeated key is a session each time
DIFF_SQL = """p AS (SELECT c_custkey::VARCHAR AS session_id, 'tuple_ranking.weight' AS path, floor(c_acctbal / 1000)::BIGINT::VARCHAR AS before, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE (floor(c_acctbal / 1000)::BIGINT + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END)::VARCHAR END AS after FROM customer
UNION ALL SELECT c_custkey::VARCHAR, 'event.anchor_query', c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE c_mktsegment END FROM customer),
d AS (SELECT * FROM p WHERE before IS DISTINCT FROM after)"""


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    c = c.withColumn("nth", F.row_number().over(W.partitionBy("c_custkey").orderBy("c_acctbal", "c_mktsegment")))
    k = F.col("c_custkey")
    weight = F.floor(F.col("c_acctbal") / 1000).cast("double").cast("string")
    after = F.when(k % 7 != 0, (F.floor(F.col("c_acctbal") / 1000) + F.when(k % 5 == 0, 1).otherwise(0)).cast("double").cast("string"))
    one = lambda path, value: c.select(k.cast("string").alias("session_id"), "nth", F.lit(path).alias("path"), value.alias("value"))
    a = one("tuple_ranking.weight", weight).union(one("event.anchor_query", F.col("c_mktsegment")))
    b = one("tuple_ranking.weight", after).where("value is not null").union(one("event.anchor_query", F.when(k % 3 == 0, "x").otherwise(F.col("c_mktsegment"))))
    return runs.config_diff(a, b, "session_id", "nth")


@query(f"WITH {DIFF_SQL} SELECT session_id, path, before IS NULL AS added, after IS NULL AS removed FROM d")
def config_diff(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots(spark, sf).select("session_id", "path", F.col("before").isNull().alias("added"), F.col("after").isNull().alias("removed"))


@query(f"""WITH {DIFF_SQL}, s AS (SELECT session_id, min(CASE path WHEN 'event.anchor_query' THEN 0 ELSE 3 END) AS first FROM d GROUP BY 1)
SELECT session_id, n::INT AS stage_no, ['retrieval', 'region', 'refinement', 'tuple'][n + 1] AS stage FROM s, LATERAL (SELECT unnest(range(first, 4)) AS n)""")
def stale_stages(spark: SparkSession, sf: str) -> DataFrame:
    return runs.stale(snapshots(spark, sf))


@query("""WITH h AS (SELECT sha256(concat_ws(chr(31), coalesce(l_orderkey::VARCHAR, chr(0)), coalesce(l_linenumber::VARCHAR, chr(0)), coalesce(l_returnflag, chr(0)))) AS x FROM lineitem)
SELECT count(*) AS rows, printf('%08x%08x%08x%08x', (sum(('0x' || x[1:8])::BIGINT) % 4294967296)::BIGINT, (sum(('0x' || x[9:16])::BIGINT) % 4294967296)::BIGINT, (sum(('0x' || x[17:24])::BIGINT) % 4294967296)::BIGINT, (sum(('0x' || x[25:32])::BIGINT) % 4294967296)::BIGINT) AS digest FROM h""")
def dataset_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return runs.fingerprint(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag"])


@query(f"""WITH {CANDIDATES_SQL}, a AS (SELECT event_id AS session_id, count(*) AS candidates FROM c GROUP BY 1), b AS (SELECT event_id AS session_id, count(DISTINCT video_id) AS regions FROM c WHERE raw > 20 GROUP BY 1),
d AS (SELECT event_id AS session_id, count(*) AS runs FROM c WHERE raw > 200 GROUP BY 1)
SELECT session_id, candidates, coalesce(regions, 0) AS regions, coalesce(runs, 0) AS runs FROM a LEFT JOIN b USING (session_id) LEFT JOIN d USING (session_id)""")
def run_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = ranking.candidates(spark, sf).withColumn("session_id", F.col("event_id"))
    return runs.run_counts(c, c.where("raw_relevance_score > 20").select("session_id", "video_id").distinct(), c.where("raw_relevance_score > 200"))


@query("SELECT o_orderkey AS run_id, o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def run_metrics_wide(spark: SparkSession, sf: str) -> DataFrame:
    metrics = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    return runs.wide_metrics(table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), metrics.alias("metrics")), ["status", "priority"])


@query("""WITH r AS (SELECT doc_id % 900 AS k, CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE lang END AS txt, CASE WHEN doc_id % 17 = 0 THEN -1.0 WHEN doc_id % 19 = 0 THEN 'nan'::DOUBLE ELSE n_chars::DOUBLE END AS a, n_chars + CASE WHEN doc_id % 13 = 0 THEN -5 ELSE 5 END AS z FROM documents)
SELECT 'blank_text' AS rule, k::VARCHAR AS key FROM r WHERE length(trim(txt)) = 0 UNION ALL SELECT 'bad_range', k::VARCHAR FROM r WHERE isnan(a) OR a < 0
UNION ALL SELECT 'backward_range', k::VARCHAR FROM r WHERE NOT isnan(a) AND z < a UNION ALL SELECT 'duplicate_key', k::VARCHAR FROM r GROUP BY k HAVING count(*) > 1""")
def record_violations(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    start = F.when(d % 17 == 0, -1.0).when(d % 19 == 0, float("nan")).otherwise(F.col("n_chars").cast("double"))
    end = (F.col("n_chars") + F.when(d % 13 == 0, -5).otherwise(5)).cast("double")
    rows = table(spark, sf, "documents").select((d % 900).alias("k"), F.when(d % 10 == 0, " ").otherwise(F.col("lang")).alias("txt"), start.alias("a"), end.alias("z"))
    return constraints.record_violations(rows, "k", "txt", "a", "z")
