"""Order constraints from event relations ``events(session_id, event_pos, event_id, temporal_relation, reference_event_id)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written

#: Events of a session whose pairs may become expressions of a plan; the closure itself takes any number.
MOST_EVENTS = 32


def edges(events: DataFrame) -> DataFrame:
    """Direct edges ``session_id, i, j``: the event at i comes first. Other relations, and dangling references, give none."""
    other = events.select("session_id", F.col("event_id").alias("reference_event_id"), F.col("event_pos").alias("other"))
    both = events.join(other, ["session_id", "reference_event_id"]).where("temporal_relation in ('after', 'before')")
    after = F.col("temporal_relation") == "after"
    i, j = F.when(after, F.col("other")).otherwise(F.col("event_pos")), F.when(after, F.col("event_pos")).otherwise(F.col("other"))
    return both.select("session_id", i.alias("i"), j.alias("j")).distinct()


def order_constraints(events: DataFrame) -> DataFrame:
    """Transitive closure of the edges, for all sessions at once: path lengths double until nothing is new.

    A row ``(i, i)`` is a cycle. Sessions without any relation have no row, and ``unrelated`` tells them from sessions whose
    relations have no direction. Each doubling is written, so the plan stays as short as one join.
    """
    out = written(edges(events), "edges")
    size = out.count()
    while size:
        a, b = out.select("session_id", "i", F.col("j").alias("k")), out.select("session_id", F.col("i").alias("k"), "j")
        further = a.hint("merge").join(b.hint("merge"), ["session_id", "k"]).select("session_id", "i", "j")
        out = written(out.union(further).distinct(), "closure")
        before, size = size, out.count()
        if size == before:
            break
    return out


def unrelated(events: DataFrame) -> DataFrame:
    """Sessions that carry no relation data at all: their order is the chain of neighbours."""
    some = F.max(((F.col("temporal_relation") != "unknown") | F.col("reference_event_id").isNotNull()).cast("int"))
    return events.groupBy("session_id").agg(some.alias("some")).where("some = 0").select("session_id")


def relation_violations(events: DataFrame) -> DataFrame:
    """``rule, session_id, event_id``: references to no event, and events on a cycle."""
    known = events.select("session_id", F.col("event_id").alias("reference_event_id"))
    dangling = events.where("reference_event_id is not null").join(known, ["session_id", "reference_event_id"], "left_anti")
    loops = order_constraints(events).where("i = j").select("session_id", F.col("i").alias("event_pos"))
    on = events.join(loops, ["session_id", "event_pos"], "left_semi")
    row = lambda name, df: df.select(F.lit(name).alias("rule"), "session_id", "event_id")
    return row("dangling_reference", dangling).union(row("cycle", on))


def pairs(constraints: DataFrame, session: str) -> list[tuple[int, int]]:
    """One session's pairs for a plan's expressions: the square of its few events at most, and an error beyond that."""
    rows = constraints.where(F.col("session_id") == session).select("i", "j").limit(MOST_EVENTS**2 + 1).collect()
    if len(rows) > MOST_EVENTS**2:
        raise ValueError(f"session {session} has pairs of more than {MOST_EVENTS} events, too many for a plan's expressions")
    return sorted((r.i, r.j) for r in rows)
