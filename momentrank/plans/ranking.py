"""Ranking queries over ``events``, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import constraints as rules
from ..operators import rank, regions, relations
from ..operators.tuples import Gap, Params, ranked_videos, tuples
from ..functions.scoring import min_max, robust_sigmoid
from ..tables import CANDIDATES_SQL, ORDER_CANDIDATES_SQL, candidates, order_candidates

EVENTS = ["view", "click", "purchase"]
ALL_EVENTS = ["view", "click", "purchase", "signup", "error"]
HOUR = 3600.0
#: The test data spans 30 days: a gap of 25 hours for one of 25 seconds, with the same weight an hour.
BASE = Params(gap_tau=25 * HOUR, gap_weight=0.05 / HOUR)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: str) -> str:
    return f"round({c}, 6) + 0.0 AS {c.split('.')[-1]}"


def rounded(*names: str):
    return [(F.round(n, 6) + 0.0).alias(n) for n in names]


def joined(column, digits: int | None = None):
    """An array as text, nulls as ``?``; numbers rounded."""
    if digits is None:
        return F.array_join(F.transform(column, lambda x: F.coalesce(x.cast("string"), F.lit("?"))), ",")
    cast = lambda x: F.coalesce(F.round(x * 10**digits, 0).cast("long").cast("string"), F.lit("?"))
    return F.array_join(F.transform(column, cast), ",")


# --- SQL building blocks

SIGMOID = "CASE WHEN {z} >= 0 THEN 1 / (1 + exp(-({z}))) ELSE exp({z}) / (1 + exp({z})) END"


def calibrated_sql(by: str = "session_id, event_id", source: str = "c") -> str:
    """CTEs that end in r: candidates with ``score``."""
    z = "greatest(-8, least(8, (raw - med) / (1.4826 * mad)))"
    return f"""m1 AS (SELECT {by}, median(raw) AS med FROM {source} GROUP BY ALL),
m2 AS (SELECT {by}, med, median(abs(raw - med)) AS mad FROM {source} JOIN m1 USING ({by}) GROUP BY ALL),
r AS (SELECT {source}.*, 'atomic_' || id AS rid, CASE WHEN 1.4826 * mad <= 1e-12 THEN
        CASE WHEN abs(raw - med) <= greatest(1e-12, 1e-9 * greatest(abs(raw), abs(med))) THEN 0.5 WHEN raw > med THEN {SIGMOID.format(z="8.0")} ELSE {SIGMOID.format(z="-8.0")} END
        ELSE {SIGMOID.format(z=z)} END AS score FROM {source} JOIN m2 USING ({by}))"""


def pool_sql(source: str = "r", absolute: float = 0.0, delta: float = 0.15, most: int = 100000) -> str:
    return f"""p0 AS (SELECT *, max(score) OVER (PARTITION BY session_id, video_id, event_id) AS best FROM {source}),
p1 AS (SELECT *, row_number() OVER (PARTITION BY session_id, video_id, event_id ORDER BY score DESC, seq) AS rn FROM p0 WHERE score >= {absolute} AND score >= best - {delta}),
p AS (SELECT *, CASE WHEN rn = 1 THEN coalesce(score - lead(score) OVER w, score) ELSE score - first_value(score) OVER w END AS margin
      FROM p1 WHERE rn <= {most} WINDOW w AS (PARTITION BY session_id, video_id, event_id ORDER BY score DESC, seq))"""


def tuples_sql(events: list[str], p: Params, pairs: list[tuple[int, int]] | None = None) -> str:
    """CTEs over p that end in t: kept tuples of each video."""
    n = len(events)
    joins = "\n".join(
        f"LEFT JOIN (SELECT * FROM p WHERE event_id = '{e}') x{i} ON x{i}.session_id = v.session_id AND x{i}.video_id = v.video_id" for i, e in enumerate(events)
    )
    s = [f"coalesce(x{i}.score, 0)" for i in range(n)]
    m = [f"coalesce(x{i}.margin, 0)" for i in range(n)]
    pairs = [(i, i + 1) for i in range(n - 1)] if pairs is None else pairs
    checked = " + ".join(f"(CASE WHEN t{i} IS NOT NULL AND t{j} IS NOT NULL THEN 1 ELSE 0 END)" for i, j in pairs) or "0"
    kept = " + ".join(f"(CASE WHEN t{j} > t{i} THEN 1 ELSE 0 END)" for i, j in pairs) or "0"
    bad, costs, counts = ["false"], ["0.0"], ["0"]
    for i in range(n - 1):
        both, gap = f"(t{i} IS NOT NULL AND t{i + 1} IS NOT NULL)", f"(t{i + 1} - t{i})"
        g = p.gaps.get(i)
        if g:
            off = f"{gap} < {g.least}" + (f" OR {gap} > {g.most}" if g.most is not None else "")
            bad.append(f"({both} AND ({off}))")
            if g.weight is None:
                continue
            cost = f"{g.weight} * greatest(0.0, {gap} - {g.tau or 0.0})"
        elif p.gap_weight > 0:
            cost = f"{p.gap_weight!r} * greatest(0.0, abs({gap}) - {p.gap_tau})"
        else:
            continue
        costs.append(f"(CASE WHEN {both} THEN {cost} ELSE 0.0 END)")
        counts.append(f"(CASE WHEN {both} THEN 1 ELSE 0 END)")
    times = ", ".join(f"t{i}" for i in range(n))
    if p.span is not None:
        bad.append(f"coalesce(greatest({times}) - least({times}) > {p.span}, false)")
    conf = "margin_score" if p.gate == "margin" else "region_mean_score"
    weight = {"none": f"{p.order_weight}", "linear": f"{p.order_weight} * {conf}"}.get(p.gate, f"CASE WHEN {conf} >= {p.gate_threshold} THEN {p.order_weight} ELSE 0.0 END")
    ids = ", ".join(f"coalesce(id{i}, '')" for i in range(n))
    return f"""v AS (SELECT DISTINCT session_id, video_id FROM p WHERE event_id IN ({", ".join(f"'{e}'" for e in events)})),
k0 AS (SELECT v.session_id, v.video_id, {", ".join(f"x{i}.rid AS id{i}, x{i}.t AS t{i}, {s[i]} AS s{i}" for i in range(n))},
       ({" + ".join(s)}) / {n} AS region_mean_score, ({" + ".join(m)}) / {n} AS margin_score FROM v
{joins}),
k1 AS (SELECT *, CASE WHEN ({checked}) > 0 THEN (2 * ({kept}) - ({checked})) / ({checked}) ELSE 0.0 END AS order_score,
       CASE WHEN ({" + ".join(counts)}) > 0 THEN ({" + ".join(costs)}) / ({" + ".join(counts)}) ELSE 0.0 END AS penalty FROM k0 WHERE NOT ({" OR ".join(bad)})),
k2 AS (SELECT *, region_mean_score + ({weight}) * order_score - penalty AS score FROM k1),
t AS (SELECT *, [{", ".join(f"id{i}" for i in range(n))}] AS region_ids, [{times}] AS timestamps, [{", ".join(f"s{i}" for i in range(n))}] AS region_scores
      FROM (SELECT *, row_number() OVER (PARTITION BY session_id, video_id ORDER BY round(score, 9) DESC, {ids}) AS rank_in_video FROM k2)
      WHERE rank_in_video <= {p.most_tuples})"""


IDS_SQL = "array_to_string([coalesce(x, '?') for x in region_ids], ',') AS region_ids"
TIMES_SQL = "array_to_string([coalesce(round(x * 1000)::BIGINT::VARCHAR, '?') for x in timestamps], ',') AS timestamps"


def videos_sql(pooling: str = "max") -> str:
    """CTEs over t that end in v2: ranked videos."""
    raw = "max(CASE WHEN rank_in_video = 1 THEN score END)" if pooling == "max" else "avg(score)"
    first = ", ".join(f"max(CASE WHEN rank_in_video = 1 THEN {c} END) AS {c}" for c in ("region_mean_score", "order_score", "region_ids", "timestamps", "region_scores"))
    return f"""v1 AS (SELECT session_id, video_id, {raw} AS raw_score, count(*) AS tuples, {first} FROM t GROUP BY ALL),
v2 AS (SELECT *, CASE WHEN max(raw_score) OVER w - min(raw_score) OVER w <= 1e-12 THEN 0.5
       ELSE (raw_score - min(raw_score) OVER w) / (max(raw_score) OVER w - min(raw_score) OVER w) END AS priority_score FROM v1 WINDOW w AS (PARTITION BY session_id))"""


def winners_sql(events: list[str], p: Params, pairs=None, source: str = CANDIDATES_SQL) -> str:
    return f"""WITH {source},
{calibrated_sql()},
{pool_sql(absolute=p.absolute, delta=p.delta, most=p.most_regions)},
{tuples_sql(events, p, pairs)},
{videos_sql(p.pooling)}
SELECT session_id, video_id, {r6("raw_score")}, {r6("priority_score")}, {r6("region_mean_score")}, {r6("order_score")}, tuples, {IDS_SQL}, {TIMES_SQL} FROM v2"""


def winners(regions_: DataFrame, events: list[str], p: Params, pairs=None) -> DataFrame:
    rows = ranked_videos(tuples(regions_, events, p, pairs), p.pooling)
    out = rows.orderBy(*[F.round("priority_score", 9).desc(), "video_id"])
    return out.select(
        "session_id", "video_id", *rounded("raw_score", "priority_score", "region_mean_score", "order_score"), "tuples",
        joined("region_ids").alias("region_ids"), joined("timestamps", 3).alias("timestamps"),
    )


def atomic(spark: SparkSession, sf: str) -> DataFrame:
    return regions.atomic_regions(candidates(spark, sf))


# --- queries


@query(winners_sql(EVENTS, BASE))
def tuple_rank_videos(spark: SparkSession, sf: str) -> DataFrame:
    return winners(atomic(spark, sf), EVENTS, BASE)


@query(winners_sql(ALL_EVENTS, BASE))
def tuple_rank_five_events(spark: SparkSession, sf: str) -> DataFrame:
    return winners(atomic(spark, sf), ALL_EVENTS, BASE)


ORDER_EVENTS = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
ORDERS = Params(gap_tau=90 * 24 * HOUR, gap_weight=0.05 / (24 * HOUR), delta=0.3)


@query(winners_sql(ORDER_EVENTS, ORDERS, source=ORDER_CANDIDATES_SQL))
def tuple_rank_orders(spark: SparkSession, sf: str) -> DataFrame:
    return winners(regions.atomic_regions(order_candidates(spark, sf)), ORDER_EVENTS, ORDERS)


WIDE = Params(gap_tau=25 * HOUR, gap_weight=0.05 / HOUR, delta=0.3, most_tuples=5)


@query(f"""WITH {CANDIDATES_SQL}, {calibrated_sql()}, {pool_sql(delta=WIDE.delta)}, {tuples_sql(EVENTS, WIDE)}
SELECT session_id, video_id, rank_in_video::BIGINT AS rank_in_video, {r6("score")}, {r6("margin_score")}, {IDS_SQL} FROM t""")
def tuple_topk_per_video(spark: SparkSession, sf: str) -> DataFrame:
    rows = tuples(atomic(spark, sf), EVENTS, WIDE)
    return rows.select("session_id", "video_id", F.col("rank_in_video").cast("long").alias("rank_in_video"), *rounded("score", "margin_score"), joined("region_ids").alias("region_ids"))


def _variant(name: str, p: Params, pairs=None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return winners(atomic(spark, sf), EVENTS, p, pairs)

    QUERIES[name], ORACLES[name] = run, winners_sql(EVENTS, p, pairs)


GAP = {"gap_tau": 25 * HOUR, "gap_weight": 0.05 / HOUR}
_variant("tuple_rank_mean_pool", Params(pooling="mean", delta=0.3, most_tuples=5, **GAP))
for gate in ("none", "linear", "margin"):
    _variant(f"tuple_rank_gate_{gate}", Params(gate=gate, gate_threshold=0.05 if gate == "margin" else 0.5, **GAP))
_variant("tuple_rank_gap_span", Params(gaps={0: Gap(least=HOUR, most=300 * HOUR, tau=24 * HOUR, weight=0.01 / HOUR), 1: Gap()}, span=400 * HOUR, delta=0.4, **GAP))
_variant("tuple_rank_no_direction", Params(**GAP), [])

RELATIONS = [("s", 0, "view", "unknown", None), ("s", 1, "click", "after", "view"), ("s", 2, "purchase", "after", "click"),
             ("s", 3, "signup", "before", "view"), ("s", 4, "error", "during", "click")]
RELATION_SCHEMA = "session_id string, event_pos int, event_id string, temporal_relation string, reference_event_id string"
RELATION_PAIRS = [(0, 1), (0, 2), (1, 2), (3, 0), (3, 1), (3, 2)]


@query(winners_sql(ALL_EVENTS, BASE, RELATION_PAIRS))
def tuple_rank_relations(spark: SparkSession, sf: str) -> DataFrame:
    closed = relations.order_constraints(spark.createDataFrame(RELATIONS, RELATION_SCHEMA))
    return winners(atomic(spark, sf), ALL_EVENTS, BASE, relations.pairs(closed, "s"))


# every order of a customer is an event of its session; each comes after the one before it by id, in pairs of the same status
CHAINS_SQL = """o AS (SELECT o_custkey::VARCHAR AS session_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS event_pos, o_orderkey::VARCHAR AS event_id,
  CASE o_orderstatus WHEN 'F' THEN 'after' WHEN 'O' THEN 'before' ELSE 'during' END AS rel, lag(o_orderkey::VARCHAR) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ref FROM orders)"""


def chains(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    by = W.partitionBy("o_custkey").orderBy("o_orderkey")
    rel = F.when(F.col("o_orderstatus") == "F", "after").when(F.col("o_orderstatus") == "O", "before").otherwise("during")
    return spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_custkey").cast("string").alias("session_id"), (F.row_number().over(by) - 1).alias("event_pos"), F.col("o_orderkey").cast("string").alias("event_id"),
        rel.alias("temporal_relation"), F.lag(F.col("o_orderkey").cast("string")).over(by).alias("reference_event_id"),
    )


@query(f"""WITH RECURSIVE {CHAINS_SQL},
e AS (SELECT a.session_id, CASE a.rel WHEN 'after' THEN b.event_pos ELSE a.event_pos END AS i, CASE a.rel WHEN 'after' THEN a.event_pos ELSE b.event_pos END AS j
      FROM o a JOIN o b ON a.session_id = b.session_id AND a.ref = b.event_id WHERE a.rel IN ('after', 'before')),
x AS (SELECT * FROM e UNION SELECT x.session_id, x.i, e.j FROM x JOIN e ON x.session_id = e.session_id AND x.j = e.i)
SELECT DISTINCT session_id, i, j FROM x""")
def order_constraints(spark: SparkSession, sf: str) -> DataFrame:
    return relations.order_constraints(chains(spark, sf))


@query(f"""WITH RECURSIVE {CHAINS_SQL},
q AS (SELECT session_id, event_pos, event_id, rel, CASE WHEN event_pos % 7 = 6 THEN 'gone' WHEN event_pos = 1 THEN event_id ELSE ref END AS ref FROM o),
e AS (SELECT a.session_id, CASE a.rel WHEN 'after' THEN b.event_pos ELSE a.event_pos END AS i, CASE a.rel WHEN 'after' THEN a.event_pos ELSE b.event_pos END AS j
      FROM q a JOIN q b ON a.session_id = b.session_id AND a.ref = b.event_id WHERE a.rel IN ('after', 'before')),
x AS (SELECT * FROM e UNION SELECT x.session_id, x.i, e.j FROM x JOIN e ON x.session_id = e.session_id AND x.j = e.i)
SELECT 'dangling_reference' AS rule, session_id, event_id FROM q WHERE ref = 'gone'
UNION ALL SELECT 'cycle', q.session_id, q.event_id FROM q WHERE EXISTS (SELECT 1 FROM x WHERE x.session_id = q.session_id AND x.i = x.j AND x.i = q.event_pos)""")
def relation_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = chains(spark, sf)
    ref = F.when(F.col("event_pos") % 7 == 6, "gone").when(F.col("event_pos") == 1, F.col("event_id")).otherwise(F.col("reference_event_id"))
    return relations.relation_violations(rows.withColumn("reference_event_id", ref))


# rules that follow from the data, so that they grow with it: every 11th user is rejected, every 5th prioritised, every 13th pinned
RULES_SQL = "u AS (SELECT DISTINCT user_id FROM events)"


def users(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("video_id")).distinct()


def video_rules(spark: SparkSession, sf: str) -> DataFrame:
    u = users(spark, sf)
    one = lambda k, r, rule: u.where(f"video_id % {k} = {r}").select(F.lit("s").alias("session_id"), "video_id", F.lit(rule).alias("rule"), F.col("video_id").alias("pos"))
    return one(11, 3, "reject").union(one(5, 0, "prioritize")).union(u.where("video_id % 2 = 0 or video_id % 3 = 0").select(F.lit("s"), "video_id", F.lit("allow"), F.lit(0).cast("long")))


PIN_SCHEMA = "session_id string, event_id string, fixed_video_id long, fixed_region_id string, fixed_frame_id long, fixed_timestamp_seconds double, rejected_region_ids array<string>"


def pins(spark: SparkSession, sf: str) -> DataFrame:
    """One pin an event: on the first user with an odd id, at a time no hit has; and the best clicks rejected."""
    rows = [("s", "view", 1, None, 77, 12345.5, None), ("s", "click", None, None, None, None, ["atomic_1", "atomic_5"]), ("s", "purchase", 7, None, None, 1000000.25, None)]
    return spark.createDataFrame(rows, PIN_SCHEMA)


RULED_SQL = f"""WITH {CANDIDATES_SQL}, {calibrated_sql()},
pin(event_id, vid, ts, frame) AS (VALUES ('view', 1, 12345.5, 77), ('purchase', 7, 1000000.25, NULL)),
g AS (SELECT session_id, event_id, video_id, frame_id, t, raw, id, seq, rid, score, false AS pinned FROM r
      UNION ALL SELECT 's', event_id, vid, NULL, ts, 1.0, NULL, -1, 'fixed:' || event_id || ':' || vid, 1.0, true FROM pin),
a AS (SELECT g.* FROM g LEFT JOIN pin ON pin.event_id = g.event_id AND pin.vid = g.video_id
      WHERE g.video_id % 11 <> 3 AND NOT (g.event_id = 'click' AND g.rid IN ('atomic_1', 'atomic_5'))
        AND (pin.vid IS NULL OR g.pinned) AND (g.video_id % 2 = 0 OR g.video_id % 3 = 0 OR pin.vid IS NOT NULL)),
{pool_sql("a")}, {tuples_sql(EVENTS, BASE)}, {videos_sql()}"""


def ruled(spark: SparkSession, sf: str) -> DataFrame:
    rows, p = atomic(spark, sf), pins(spark, sf)
    return rules.allowed(rows.unionByName(rules.pinned_regions(rows, p)), video_rules(spark, sf), p)


@query(f"""{RULED_SQL}
SELECT session_id, video_id, {r6("raw_score")}, {r6("priority_score")}, {r6("region_mean_score")}, {r6("order_score")}, tuples, {IDS_SQL}, {TIMES_SQL} FROM v2""")
def tuple_rank_ruled(spark: SparkSession, sf: str) -> DataFrame:
    return winners(ruled(spark, sf), EVENTS, BASE)


@query(f"""WITH {CANDIDATES_SQL}, {calibrated_sql()},
pin AS (SELECT event_id, min(video_id) AS vid, min_by(t, (video_id, seq)) AS ts FROM c GROUP BY event_id),
a AS (SELECT r.* FROM r LEFT JOIN pin ON pin.event_id = r.event_id AND pin.vid = r.video_id WHERE pin.vid IS NULL OR r.t = pin.ts),
{pool_sql("a")}, {tuples_sql(EVENTS, BASE)}, {videos_sql()}
SELECT session_id, video_id, {r6("raw_score")}, {r6("priority_score")}, {r6("region_mean_score")}, {r6("order_score")}, tuples, {IDS_SQL}, {TIMES_SQL} FROM v2""")
def tuple_rank_pinned(spark: SparkSession, sf: str) -> DataFrame:
    c = candidates(spark, sf)
    first = c.groupBy("session_id", "event_id").agg(F.min("video_id").alias("fixed_video_id"), F.min_by("timestamp_seconds", F.struct("video_id", "seq")).alias("fixed_timestamp_seconds"))
    p = first.select("session_id", "event_id", "fixed_video_id", F.lit(None).cast("string").alias("fixed_region_id"), F.lit(None).cast("long").alias("fixed_frame_id"),
                     "fixed_timestamp_seconds", F.lit(None).cast("array<string>").alias("rejected_region_ids"))
    rows = regions.atomic_regions(c)
    none = spark.createDataFrame([], "session_id string, video_id long, rule string, pos long")
    return winners(rules.allowed(rows.unionByName(rules.pinned_regions(rows, p)), none, p), EVENTS, BASE)


PRIORITY_SQL = f"""{RULED_SQL},
f AS (SELECT v2.*, ids.pos, ids.eid, coalesce(pin.frame::VARCHAR, c.frame_id::VARCHAR, '?') AS frame, CASE WHEN pin.frame IS NOT NULL THEN pin.ts ELSE c.t END AS tm
      FROM v2, LATERAL (SELECT unnest([0, 1, 2]) AS pos, unnest(['view', 'click', 'purchase']) AS eid, unnest(region_ids) AS rid) ids
      LEFT JOIN c ON ids.rid = 'atomic_' || c.id LEFT JOIN pin ON pin.event_id = ids.eid AND pin.vid = v2.video_id AND pin.frame IS NOT NULL),
d AS (SELECT session_id, video_id, any_value(raw_score) AS raw_score, any_value(priority_score) AS priority_score, any_value(region_mean_score) AS mean_best_event_score,
        any_value(order_score) AS order_score, list_min(any_value(region_scores)) AS min_best_event_score, list_max(any_value(region_scores)) AS max_best_event_score, len([x for x in any_value(region_ids) if x IS NOT NULL]) AS event_coverage,
        string_agg(frame, ',' ORDER BY pos) AS matched_frame_ids, string_agg(coalesce(round(tm * 1000)::BIGINT::VARCHAR, '?'), ',' ORDER BY pos) AS matched_timestamps,
        list_sort([x for x in any_value(timestamps) if x IS NOT NULL]) AS ts FROM f GROUP BY session_id, video_id),
e AS (SELECT *, CASE WHEN len(ts) < 2 THEN 1.0 WHEN len(ts) = 2 THEN least(1.0, (ts[2] - ts[1]) / 3) ELSE least(1.0, least(ts[2] - ts[1], ts[3] - ts[2]) / 3) END AS distinctness FROM d)"""


def priority_rows(spark: SparkSession, sf: str) -> DataFrame:
    found = ranked_videos(tuples(ruled(spark, sf), EVENTS, BASE))
    return rank.priorities(found, EVENTS, candidates(spark, sf), pins(spark, sf))


@query(f"""{PRIORITY_SQL}
SELECT session_id, video_id, event_coverage, event_coverage || '/3' AS coverage_label, {r6("mean_best_event_score")}, {r6("min_best_event_score")}, {r6("max_best_event_score")}, {r6("distinctness")}, {r6("order_score")},
       {r6("raw_score")}, {r6("priority_score")}, matched_frame_ids, matched_timestamps FROM e""")
def matched_frames(spark: SparkSession, sf: str) -> DataFrame:
    rows = priority_rows(spark, sf)
    return rows.select(
        "session_id", "video_id", F.col("event_coverage").cast("long").alias("event_coverage"), "coverage_label",
        *rounded("mean_best_event_score", "min_best_event_score", "max_best_event_score", "distinctness", "order_score", "raw_score", "priority_score"),
        joined("matched_frame_ids").alias("matched_frame_ids"), joined("matched_timestamps", 3).alias("matched_timestamps"),
    )


@query(f"""{PRIORITY_SQL}
SELECT video_id, {r6("priority_score")}, (SELECT count(*) FROM e) AS total FROM e
ORDER BY CASE WHEN video_id % 5 = 0 THEN video_id END NULLS LAST, round(e.priority_score, 9) DESC, round(raw_score, 9) DESC, event_coverage DESC, video_id LIMIT 10 OFFSET 5""")
def video_priorities_page(spark: SparkSession, sf: str) -> DataFrame:
    listed = rank.listed_first(priority_rows(spark, sf), video_rules(spark, sf))
    out = rank.page(listed, rank.final_order(listed, listed), 5, 10)
    return out.select("video_id", *rounded("priority_score"), "total")


def independent_sql(weights: tuple[float, float, float, float]) -> str:
    blend = " + ".join(f"{w} * {c}" for w, c in zip(weights, ("normalized_coverage", "mean_score", "min_score", "distinctness")))
    return f"""WITH {CANDIDATES_SQL}, {calibrated_sql()},
b0 AS (SELECT *, row_number() OVER (PARTITION BY session_id, video_id, event_id ORDER BY score DESC, seq DESC) AS k FROM r WHERE event_id IN ('view', 'click', 'purchase')),
b1 AS (SELECT session_id, video_id, count(*) AS event_coverage, sum(score) / 3 AS mean_score, CASE WHEN count(*) < 3 THEN 0.0 ELSE min(score) END AS min_score,
       count(*) / 3 AS normalized_coverage, list_sort(list(t)) AS ts FROM b0 WHERE k = 1 GROUP BY ALL),
b2 AS (SELECT *, CASE WHEN len(ts) < 2 THEN 1.0 WHEN len(ts) = 2 THEN least(1.0, (ts[2] - ts[1]) / 3) ELSE least(1.0, least(ts[2] - ts[1], ts[3] - ts[2]) / 3) END AS distinctness FROM b1),
b3 AS (SELECT *, ({blend}) / {sum(weights)} AS priority_score FROM b2)
SELECT session_id, video_id, event_coverage, {r6("normalized_coverage")}, {r6("mean_score")}, {r6("min_score")}, {r6("distinctness")}, {r6("priority_score")} FROM b3"""


def _independent(spark: SparkSession, sf: str, weights: tuple[float, float, float, float]) -> DataFrame:
    rows = rank.independent(atomic(spark, sf), EVENTS, weights)
    rows = rows.orderBy(F.round("priority_score", 9).desc(), F.desc("event_coverage"), "video_id")
    return rows.select("session_id", "video_id", "event_coverage", *rounded("normalized_coverage", "mean_score", "min_score", "distinctness", "priority_score"))


@query(independent_sql((0.0, 1.0, 0.0, 0.0)))
def independent_rank(spark: SparkSession, sf: str) -> DataFrame:
    return _independent(spark, sf, (0.0, 1.0, 0.0, 0.0))


@query(independent_sql((0.5, 0.3, 0.2, 0.1)))
def independent_rank_blend(spark: SparkSession, sf: str) -> DataFrame:
    return _independent(spark, sf, (0.5, 0.3, 0.2, 0.1))


@query(f"WITH {CANDIDATES_SQL}, {calibrated_sql()} SELECT frame_id, event_id, {r6('score')} FROM r")
def robust_sigmoid_per_event(spark: SparkSession, sf: str) -> DataFrame:
    rows = regions.calibrated(candidates(spark, sf))
    return rows.select("frame_id", "event_id", (F.round("normalized_relevance_score", 6) + 0.0).alias("score"))


@query(f"WITH {CANDIDATES_SQL}, {calibrated_sql('session_id')} SELECT frame_id, {r6('score')} FROM r")
def robust_sigmoid_all_regions(spark: SparkSession, sf: str) -> DataFrame:
    rows = robust_sigmoid(candidates(spark, sf), ["session_id"], "raw_relevance_score", "score")
    return rows.select("frame_id", *rounded("score"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN max(l_extendedprice) OVER w - min(l_extendedprice) OVER w <= 1e-12 THEN 0.5
 ELSE (l_extendedprice - min(l_extendedprice) OVER w) / (max(l_extendedprice) OVER w - min(l_extendedprice) OVER w) END, 6) + 0.0 AS score
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)""")
def min_max_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return min_max(rows, ["l_returnflag"], "l_extendedprice", "score").select("l_orderkey", "l_linenumber", *rounded("score"))


@query(f"WITH {CANDIDATES_SQL}, {calibrated_sql()}, {pool_sql(absolute=0.4, delta=0.2, most=3)} SELECT rid AS id, video_id, event_id, rn::BIGINT AS rn, {r6('score')}, {r6('margin')} FROM p")
def region_pool(spark: SparkSession, sf: str) -> DataFrame:
    rows = regions.pooled(atomic(spark, sf), 0.4, 0.2, 3)
    return rows.select("id", "video_id", "event_id", F.col("rn").cast("long").alias("rn"), *rounded("score", "margin"))


@query(f"""WITH {CANDIDATES_SQL}, {calibrated_sql()}
SELECT rid AS id, video_id, event_id, round(greatest(0.0, t - 1800), 6) AS start_seconds, round(t + 1800, 6) AS end_seconds, round(t + 1800 - greatest(0.0, t - 1800), 3) AS duration, {r6('score')} FROM r""")
def atomic_regions(spark: SparkSession, sf: str) -> DataFrame:
    rows = regions.atomic_regions(candidates(spark, sf), 1800.0)
    return rows.select(
        "id", "video_id", "event_id", F.round("start_seconds", 6).alias("start_seconds"), F.round("end_seconds", 6).alias("end_seconds"),
        regions.duration().alias("duration"), (F.round("normalized_coarse_score", 6) + 0.0).alias("score"),
    )


CLUSTER = (6 * HOUR, HOUR, 48 * HOUR)
CLUSTER_SQL = f"""n AS (SELECT *, row_number() OVER (PARTITION BY session_id, event_id, video_id ORDER BY t, frame_id, id) AS k FROM r),
w AS (SELECT session_id, event_id, video_id, k, t, t AS first, 1 AS cluster FROM n WHERE k = 1
      UNION ALL SELECT n.session_id, n.event_id, n.video_id, n.k, n.t,
        CASE WHEN n.t - w.t > {CLUSTER[0]} OR n.t - w.first > {CLUSTER[2] - 2 * CLUSTER[1]} THEN n.t ELSE w.first END,
        CASE WHEN n.t - w.t > {CLUSTER[0]} OR n.t - w.first > {CLUSTER[2] - 2 * CLUSTER[1]} THEN w.cluster + 1 ELSE w.cluster END
      FROM w JOIN n ON n.session_id = w.session_id AND n.event_id = w.event_id AND n.video_id = w.video_id AND n.k = w.k + 1),
g AS (SELECT w.session_id, w.event_id, w.video_id, cluster, greatest(0.0, min(w.t) - {CLUSTER[1]}) AS a, max(w.t) + {CLUSTER[1]} AS z, string_agg(n.id, ',' ORDER BY n.k) AS ids, max(raw) AS raw, max(score) AS score
      FROM w JOIN n USING (session_id, event_id, video_id, k) GROUP BY ALL)"""


def region_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "video_id", "event_id", F.round("start_seconds", 6).alias("start_seconds"), F.round("end_seconds", 6).alias("end_seconds"),
        F.array_join("candidate_ids", ",").alias("candidate_ids"), (F.round("raw_coarse_score", 6) + 0.0).alias("raw"), (F.round("normalized_coarse_score", 6) + 0.0).alias("score"),
    )


@query(f"""WITH RECURSIVE {CANDIDATES_SQL}, {calibrated_sql()}, {CLUSTER_SQL}
SELECT video_id, event_id, round(a, 6) AS start_seconds, round(z, 6) AS end_seconds, ids AS candidate_ids, {r6('raw')}, {r6('score')} FROM g""")
def cluster_regions(spark: SparkSession, sf: str) -> DataFrame:
    return region_rows(regions.clusters(candidates(spark, sf), *CLUSTER))


@query(f"""WITH RECURSIVE {CANDIDATES_SQL}, {calibrated_sql()}, {CLUSTER_SQL},
h AS (SELECT *, row_number() OVER (PARTITION BY session_id, event_id, video_id ORDER BY a, z) AS k FROM g),
x AS (SELECT session_id, event_id, video_id, k, a, z, 1 AS island FROM h WHERE k = 1
      UNION ALL SELECT h.session_id, h.event_id, h.video_id, h.k,
        CASE WHEN h.a > x.z OR greatest(h.z, x.z) - least(h.a, x.a) > {CLUSTER[2]} THEN h.a ELSE least(h.a, x.a) END,
        CASE WHEN h.a > x.z OR greatest(h.z, x.z) - least(h.a, x.a) > {CLUSTER[2]} THEN h.z ELSE greatest(h.z, x.z) END,
        CASE WHEN h.a > x.z OR greatest(h.z, x.z) - least(h.a, x.a) > {CLUSTER[2]} THEN x.island + 1 ELSE x.island END
      FROM x JOIN h ON h.session_id = x.session_id AND h.event_id = x.event_id AND h.video_id = x.video_id AND h.k = x.k + 1),
y AS (SELECT video_id, event_id, island, min(h.a) AS a, max(h.z) AS z, string_agg(ids, ',' ORDER BY h.k) AS ids, max(raw) AS raw, max(score) AS score
      FROM x JOIN h USING (session_id, event_id, video_id, k) GROUP BY ALL)
SELECT video_id, event_id, round(a, 6) AS start_seconds, round(z, 6) AS end_seconds, ids AS candidate_ids, {r6('raw')}, {r6('score')} FROM y""")
def merge_regions(spark: SparkSession, sf: str) -> DataFrame:
    return region_rows(regions.merged(regions.clusters(candidates(spark, sf), *CLUSTER), CLUSTER[2]))


@query(f"""WITH {CANDIDATES_SQL}, {calibrated_sql()},
a AS (SELECT *, greatest(0.0, t - 7200) AS s, t + 7200 AS e FROM r),
b AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY event_id, video_id ORDER BY s, e, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM a),
i AS (SELECT *, sum(new) OVER (PARTITION BY event_id, video_id ORDER BY s, e, rid) AS island FROM b)
SELECT video_id, event_id, round(min(s), 6) AS start_seconds, round(max(e), 6) AS end_seconds, count(*) AS regions, round(max(raw), 6) + 0.0 AS raw FROM i GROUP BY video_id, event_id, island""")
def region_islands(spark: SparkSession, sf: str) -> DataFrame:
    rows = regions.islands(regions.atomic_regions(candidates(spark, sf), 7200.0))
    return rows.select("video_id", "event_id", F.round("start_seconds", 6).alias("start_seconds"), F.round("end_seconds", 6).alias("end_seconds"), "regions", (F.round("raw_coarse_score", 6) + 0.0).alias("raw"))


@query(f"""WITH RECURSIVE {CANDIDATES_SQL}, {calibrated_sql()}, {CLUSTER_SQL},
l AS (SELECT *, max(raw) OVER (PARTITION BY event_id, video_id) AS best FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id, video_id ORDER BY raw DESC, a, ids) AS rn FROM l WHERE raw >= best * (1 - 0.1)),
q AS (SELECT k.event_id, k.video_id, k.rn, n.id, n.t, n.raw, n.k AS pos FROM k JOIN n ON n.event_id = k.event_id AND n.video_id = k.video_id AND list_contains(string_split(k.ids, ','), n.id) WHERE k.rn <= 2),
z AS (SELECT *, row_number() OVER (PARTITION BY event_id, video_id ORDER BY raw DESC, rn, pos) AS seed FROM q)
SELECT video_id, event_id, seed, id, round(t, 6) AS t, {r6('raw')} FROM z WHERE seed <= 6""")
def seed_selection(spark: SparkSession, sf: str) -> DataFrame:
    c = candidates(spark, sf)
    rows = regions.seeds(regions.clusters(c, *CLUSTER), c)
    return rows.select("video_id", "event_id", F.col("seed").cast("long").alias("seed"), "id", F.round("timestamp_seconds", 6).alias("t"), (F.round("raw_relevance_score", 6) + 0.0).alias("raw"))


@query(f"""WITH RECURSIVE {CANDIDATES_SQL}, {calibrated_sql()}, {CLUSTER_SQL},
q AS (SELECT g.event_id, g.video_id, g.a, n.t, row_number() OVER (PARTITION BY g.event_id, g.video_id, g.cluster ORDER BY n.raw DESC, n.k) AS b
      FROM g JOIN n ON n.event_id = g.event_id AND n.video_id = g.video_id AND list_contains(string_split(g.ids, ','), n.id))
SELECT video_id, event_id, round(a, 6) AS start_seconds, round(t, 6) AS best_seconds FROM q WHERE b = 1""")
def region_representative(spark: SparkSession, sf: str) -> DataFrame:
    c = candidates(spark, sf)
    rows = regions.representative(regions.clusters(c, *CLUSTER), c)
    return rows.select("video_id", "event_id", F.round("start_seconds", 6).alias("start_seconds"), F.round("best_seconds", 6).alias("best_seconds"))


# m: a video's last edits; p1: the first priority after its last rejection, from when it may be allowed again
@query("""WITH e AS (SELECT user_id AS v, event_id AS seq, CASE event_type WHEN 'view' THEN 'allow' WHEN 'click' THEN 'prioritize' WHEN 'error' THEN 'reject' ELSE 'clear' END AS action FROM events),
m AS (SELECT v, coalesce(max(seq) FILTER (action = 'allow'), -1) AS a, coalesce(max(seq) FILTER (action = 'prioritize'), -1) AS p,
             coalesce(max(seq) FILTER (action = 'reject'), -1) AS r, coalesce(max(seq) FILTER (action = 'clear'), -1) AS c FROM e GROUP BY v),
n AS (SELECT m.*, (SELECT min(seq) FROM e WHERE e.v = m.v AND action = 'prioritize' AND seq > m.r) AS p1 FROM m),
o AS (SELECT v, 'reject' AS rule, NULL::BIGINT AS at FROM n WHERE r > greatest(p, c)
UNION ALL SELECT v, 'prioritize', p FROM n WHERE p > greatest(r, c)
UNION ALL SELECT v, 'allow', NULL FROM n WHERE a > greatest(r, c) AND (r < 0 OR c > r OR a > p1))
SELECT 's' AS session_id, v AS video_id, rule, CASE WHEN rule = 'prioritize' THEN row_number() OVER (PARTITION BY rule ORDER BY "at" DESC, v) - 1 END AS pos FROM o""")
def rule_state(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "allow").when(F.col("event_type") == "click", "prioritize").when(F.col("event_type") == "error", "reject").otherwise("clear")
    edits = spark.read.parquet(f"{sf}/events.parquet").select(F.lit("s").alias("session_id"), F.col("user_id").alias("video_id"), kind.alias("action"), F.col("event_id").alias("seq"))
    return rules.rule_state(edits)


@query(f"""WITH {CHAINS_SQL}, g AS (SELECT session_id, event_id AS b, lead(event_id, CASE WHEN event_pos % 3 = 0 THEN 1 ELSE 2 END) OVER (PARTITION BY session_id ORDER BY event_pos) AS a FROM o),
q AS (SELECT g.session_id, g.b, g.a, x.event_pos AS i, y.event_pos AS j FROM g LEFT JOIN o x ON x.session_id = g.session_id AND x.event_id = g.b LEFT JOIN o y ON y.session_id = g.session_id AND y.event_id = g.a)
SELECT 'unknown_gap_event' AS rule, concat_ws('/', session_id, b, a) AS key FROM q WHERE i IS NULL OR j IS NULL
UNION ALL SELECT 'gap_not_adjacent', concat_ws('/', session_id, b, a) FROM q WHERE j <> i + 1
UNION ALL SELECT 'unknown_event', session_id || '/none' FROM o WHERE event_pos = 2
UNION ALL SELECT 'allow_and_reject', session_id || '/' || session_id FROM o WHERE event_pos = 3
UNION ALL SELECT 'fixed_and_reject', session_id || '/' || session_id FROM o WHERE event_pos = 3""")
def constraint_violations(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = chains(spark, sf)
    by = W.partitionBy("session_id").orderBy("event_pos")
    after = F.when(F.col("event_pos") % 3 == 0, F.lead("event_id", 1).over(by)).otherwise(F.lead("event_id", 2).over(by))
    gaps = e.select("session_id", F.col("event_id").alias("before_event_id"), after.alias("after_event_id"))
    none = lambda kind: F.lit(None).cast(kind)
    third = e.where("event_pos = 3")
    one = lambda rule: third.select("session_id", F.col("session_id").cast("long").alias("video_id"), F.lit(rule).alias("rule"), none("long").alias("pos"))
    bad = e.where("event_pos = 2").select("session_id", F.lit("none").alias("event_id"), none("long").alias("fixed_video_id"))
    bad = bad.union(third.select("session_id", "event_id", F.col("session_id").cast("long")))
    p = bad.select("*", none("string").alias("fixed_region_id"), none("long").alias("fixed_frame_id"), none("double").alias("fixed_timestamp_seconds"), none("array<string>").alias("rejected_region_ids"))
    return rules.constraint_violations(e, one("allow").union(one("reject")), p, gaps)
