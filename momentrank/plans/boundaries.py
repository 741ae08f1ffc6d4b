"""Boundary queries, made from documentation. A minute stands for a millisecond here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import pair_softmax
from ..operators import boundary, runs
from ..tables import CANDIDATES_SQL, ORIGIN, candidates, table
from .ranking import calibrated_sql, r6, rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


SAMPLES_SQL = f"""s AS (SELECT event_id, user_id AS g, (epoch_us(ts) - {ORIGIN}) // 60000000 AS t, value / 97 AS anchor, 1 / (1 + exp((value / 97 - (event_id % 10) / 10) / 1.0)) AS p_post,
  1 - 1 / (1 + exp((value / 97 - (event_id % 10) / 10) / 1.0)) AS p_pre, (event_id % 7) / 7 AS motion FROM events)"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    post = pair_softmax(F.col("value") / 97, i % 10 / 10)
    return table(spark, sf, "events").select(
        i, F.col("user_id").alias("g"), F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - ORIGIN) / 60000000).alias("t_ms"),
        (F.col("value") / 97).alias("anchor"), post.alias("p_post"), (1 - post).alias("p_pre"), (i % 7 / 7).alias("motion"),
    )


def side(f: str, c: str, w: int, left: bool) -> str:
    frame = f"{w} PRECEDING AND 1 PRECEDING" if left else f"1 FOLLOWING AND {w} FOLLOWING"
    return f"{f}({c}) OVER (PARTITION BY g ORDER BY t RANGE BETWEEN {frame})"


def transition_sql() -> str:
    cols = ", ".join(f"{side('avg', c, w, left)} AS {c}_{'l' if left else 'r'}{w}" for c in ("p_pre", "p_post") for w in boundary.WINDOWS_MS for left in (True, False))
    cols += ", " + ", ".join(f"{side('count', 'p_pre', w, left)} AS n_{'l' if left else 'r'}{w}" for w in boundary.WINDOWS_MS for left in (True, False))
    parts = []
    for a in boundary.WINDOWS_MS:
        for b in boundary.WINDOWS_MS:
            cost = 0.01 * (a + b) / 6000 + 0.01 * abs(a - b) / 3000
            parts.append(f"CASE WHEN n_l{a} >= 2 AND n_r{b} >= 2 THEN 0.5 * (p_post_r{b} - p_post_l{a}) + 0.5 * (p_pre_l{a} - p_pre_r{b}) + 0.1 * motion - {cost!r} END")
    return f"WITH {SAMPLES_SQL}, w AS (SELECT *, {cols} FROM s) SELECT event_id, round(greatest({', '.join(parts)}), 6) + 0.0 AS boundary FROM w"


@query(transition_sql())
def boundary_transition(spark: SparkSession, sf: str) -> DataFrame:
    return boundary.transition(samples(spark, sf), ["g"]).select("event_id", *rounded("boundary"))


@query(f"WITH {SAMPLES_SQL} SELECT event_id, round(avg(anchor) OVER (PARTITION BY g ORDER BY t RANGE BETWEEN 3000 PRECEDING AND 3000 FOLLOWING), 6) + 0.0 AS persistence FROM s")
def state_persistence(spark: SparkSession, sf: str) -> DataFrame:
    return boundary.persistence(samples(spark, sf), ["g"], "anchor").select("event_id", *rounded("persistence"))


def prominence_sql(w: int) -> str:
    a, n, b, m = (side(f, "anchor", w, left) for left in (True, False) for f in ("avg", "count"))
    return f"CASE WHEN {n} >= 2 AND {m} >= 2 THEN anchor - ({a} + {b}) / 2 END"


@query(f"WITH {SAMPLES_SQL} SELECT event_id, round(greatest({', '.join(map(prominence_sql, boundary.WINDOWS_MS))}), 6) + 0.0 AS prominence FROM s")
def symmetric_peak(spark: SparkSession, sf: str) -> DataFrame:
    return boundary.prominence(samples(spark, sf), ["g"], "anchor").select("event_id", *rounded("prominence"))


@query(f"WITH {SAMPLES_SQL} SELECT event_id, round((0.4 * anchor + 0.3 * p_post + 0.1 * p_pre + 0.2 * motion) / 1.0, 6) + 0.0 AS score FROM s")
def event_blend(spark: SparkSession, sf: str) -> DataFrame:
    score = boundary.event_blend(F.col("anchor"), F.col("p_post"), F.col("p_pre"), F.col("motion"))
    return samples(spark, sf).withColumn("score", score).select("event_id", *rounded("score"))


@query(f"""WITH RECURSIVE {SAMPLES_SQL}, o AS (SELECT g, t, anchor, row_number() OVER (PARTITION BY g ORDER BY anchor DESC, t) AS k FROM s),
x AS (SELECT g, k, [t] AS kept FROM o WHERE k = 1
  UNION ALL SELECT o.g, o.k, CASE WHEN len(x.kept) >= 5 OR list_min([abs(y - o.t) for y in x.kept]) <= 500 THEN x.kept ELSE list_append(x.kept, o.t) END FROM x JOIN o ON o.g = x.g AND o.k = x.k + 1),
l AS (SELECT g, max_by(kept, k) AS kept FROM x GROUP BY g)
SELECT g, i::BIGINT AS pick, kept[i] AS t_ms FROM l, LATERAL (SELECT unnest(range(1, len(kept) + 1)) AS i)""")
def temporal_nms(spark: SparkSession, sf: str) -> DataFrame:
    return boundary.suppressed(samples(spark, sf), ["g"], "anchor").select("g", F.col("pick").cast("long").alias("pick"), "t_ms")


@query(f"WITH {SAMPLES_SQL} SELECT event_id FROM (SELECT event_id, anchor, max(anchor) OVER (PARTITION BY g ORDER BY t RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS top FROM s) WHERE anchor = top")
def local_maxima(spark: SparkSession, sf: str) -> DataFrame:
    return boundary.peaks(samples(spark, sf), ["g"], "anchor").select("event_id")


# a session a type, so that budgets are many: regions are hits, a video's priority its best score, every 50th hit is pinned
@query(f"""WITH {CANDIDATES_SQL}, {calibrated_sql()}, e AS (SELECT 'p' || video_id % 5 AS session_id, video_id, event_id, rid AS id, score, seq % 50 = 0 AS pinned FROM r),
v AS (SELECT session_id, video_id, row_number() OVER (PARTITION BY session_id ORDER BY max(score) DESC, video_id) AS vr FROM e GROUP BY session_id, video_id),
a AS (SELECT e.*, row_number() OVER (PARTITION BY session_id, video_id, event_id ORDER BY pinned DESC, score DESC, id) AS er FROM e JOIN v USING (session_id, video_id) WHERE vr <= 5),
b AS (SELECT *, row_number() OVER (PARTITION BY session_id, event_id ORDER BY score DESC, id) AS fr FROM a WHERE er <= 3),
c2 AS (SELECT *, CASE WHEN pinned THEN 0 WHEN fr = 1 THEN 1 ELSE 2 END AS kind FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY kind, score DESC, id) AS rank FROM c2),
f AS (SELECT *, row_number() OVER (PARTITION BY session_id, rank > 51 ORDER BY md5(id), id) AS x FROM d)
SELECT session_id, id, kind, rank > 51 AS explored FROM f WHERE rank <= 51 OR x <= 9""")
def frontier(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.regions import atomic_regions

    rows = atomic_regions(candidates(spark, sf)).select(
        F.concat(F.lit("p"), (F.col("video_id") % 5).cast("string")).alias("session_id"), "video_id", "event_id", "id",
        F.col("normalized_coarse_score").alias("score"), F.col("normalized_coarse_score").alias("priority"), (F.col("seq") % 50 == 0).alias("pinned"),
    )
    return runs.frontier(rows).select("session_id", "id", "kind", "explored")


@query(f"""WITH {CANDIDATES_SQL}, {calibrated_sql()}, p AS (SELECT *, row_number() OVER (PARTITION BY video_id, event_id ORDER BY score DESC, rid) AS k FROM r),
x AS (SELECT a.session_id, a.video_id, (a.score + b.score + c.score) / 3 - (0.01 * greatest(0.0, (b.t - a.t) / 3600 - 10) + 0.01 * greatest(0.0, (c.t - b.t) / 3600 - 10)) / 2
        + 0.02 * ((a.seq % 50 = 0)::INT + (b.seq % 50 = 0)::INT + (c.seq % 50 = 0)::INT) / 3 AS raw, [a.rid, b.rid, c.rid] AS ids
      FROM p a JOIN p b ON a.video_id = b.video_id AND b.t > a.t JOIN p c ON c.video_id = a.video_id AND c.t > b.t
      WHERE a.event_id = 'view' AND b.event_id = 'click' AND c.event_id = 'purchase' AND a.k <= 8 AND b.k <= 8 AND c.k <= 8),
{calibrated_sql("session_id", "x").replace("m1 AS", "n1 AS").replace("m2 AS", "n2 AS").replace("m1 ", "n1 ").replace("m2 ", "n2 ").replace("'atomic_' || id AS rid, ", "").replace("r AS (", "y AS (")},
z AS (SELECT *, row_number() OVER (ORDER BY round(raw, 9) DESC, video_id, ids) AS rank FROM y)
SELECT video_id, array_to_string(ids, ',') AS ids, {r6("raw")}, {r6("score")}, rank FROM z WHERE rank <= 20""")
def strict_ordered_tuples(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.regions import atomic_regions

    rows = atomic_regions(candidates(spark, sf)).select(
        "session_id", "video_id", "event_id", "id", (F.col("best_seconds") / 3600).alias("t"), F.col("normalized_coarse_score").alias("score"), (F.col("seq") % 50 == 0).alias("pinned")
    )
    out = boundary.strict_tuples(rows, ["view", "click", "purchase"])
    return out.select("video_id", F.array_join("ids", ",").alias("ids"), *rounded("raw", "score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH r AS (SELECT p_partkey AS id, p_partkey % 10 AS g, (p_partkey % 30)::DOUBLE AS a, (p_partkey % 30 + p_size)::DOUBLE AS z, p_partkey % 30 + p_size / 2 AS peak FROM part),
n AS (SELECT g, greatest(1, floor(2000 / count(*)))::INT AS share FROM r GROUP BY g),
w AS (SELECT *, greatest(a, peak - 1) AS lo, least(z, peak + 1) AS hi FROM r),
t AS (SELECT id, 0 AS kind, round(lo + i * 0.1, 3) AS t FROM w, LATERAL (SELECT unnest(range(0, floor((hi - lo) / 0.1 + 1e-9)::BIGINT + 1)) AS i)
      UNION ALL SELECT id, 1, round(a + i * 0.5, 3) FROM w, LATERAL (SELECT unnest(range(0, floor((z - a) / 0.5 + 1e-9)::BIGINT + 1)) AS i)),
d AS (SELECT id, t, min(kind) AS kind FROM t GROUP BY id, t),
k AS (SELECT d.*, row_number() OVER (PARTITION BY d.id ORDER BY kind, t) AS k FROM d)
SELECT k.id, t FROM k JOIN r USING (id) JOIN n USING (g) WHERE k.k <= share""")
def frame_budget(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(
        k.alias("id"), (k % 10).alias("session_id"), (k % 30).cast("double").alias("start_seconds"), (k % 30 + F.col("p_size")).cast("double").alias("end_seconds"),
        (k % 30 + F.col("p_size") / 2).alias("peak"),
    )
    return boundary.frame_budget(rows, 2000).select("id", "t")
