"""Repair of conversations' structure by Knuth's lightest derivation.

A repaired conversation's role initials match ``(s?(ua)+)?``. A row is kept (cost 0), reroled to user or assistant (3) or
deleted (4); an empty message of user or assistant may be inserted anywhere (3); a truncated row that stays adds 3; blank
and duplicate rows must go. The cheapest repair is wanted, and of equally cheap ones the one whose edits' initials (D,
I, K, R) come first.

Deductions make items: ``(i, p, q)`` says that the first i rows of a block can bring the pattern from state p to state q.
Rows' edits are facts; an item with a fact gives an item, and an insertion turns an item into another. The agenda pops the lightest
item by (cost, rows used, audit), and an item's first pop is final: a result costs at least what it is made of, uses at least
as many rows, and, with both equal, is longer, so functions are monotone and superior, and Knuth's generalisation of
Dijkstra's algorithm holds. Audits of one item with one cost are never prefixes of each other, as what one has in addition would
be insertions that cost; so what follows keeps their order, and the lightest parts make the lightest whole.

No task needs a conversation's texts at once. Rows are sorted by range and numbered; BLOCK numbers in a row are a block. A
block that starts its conversation has one first state, other blocks have four, and give the lightest way from each of them to each
state. Then a conversation's blocks, a row each without texts, are chained by the same deductions over blocks in the place of rows.
The chosen states go back to the blocks, whose rows are edited where they are, and repaired blocks stream past a running hash.
What one task holds of a conversation is its audit, a character a row, which the result has as one string anyway.

Defined results: a null role or text is one space, and so is a null id or turn in the key of the damage; a null
conversation is one of its own; null turns come first. Rows that share a turn are ordered by role, the text's first PREFIX
characters and its hash, and equal rows stay together. Roles are judged by their first character; an empty one fits nothing. A
conversation whose rows are all gone has zeros, an empty audit and the hash of nothing. Only the id, turn, role and text
columns are read, so extra columns can't clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, stored

#: Rows of a block: numbers that share all but the lowest BITS bits.
BITS = 10
PREFIX = 200
#: States of the pattern: nothing yet, after system, after user, after assistant. What each initial leads to; -1: nowhere.
START, ENDS = 0, (0, 3)
NEXT = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
#: The message that a state asks for, and so the role of what is reroled or inserted there.
WANTED = ("user", "user", "assistant", "user")
REROLE, DELETE, INSERT, STAYS = 3, 4, 3, 3


def damaged(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv_id, turn, role, body`` after the damage that a row's key draws."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv), F.lit(":"), space(turn))) % 20
    body = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("body", "[.!?]", "")).otherwise(F.col("body"))
    some = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("body"), kind.alias("kind"))
    some = some.where("kind <> 0").withColumns({"body": body, "role": F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))})
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return some.withColumn("copy", copies).drop("kind", "copy")


def lined(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, body) with ``uid``, which ascends along each conversation, ``block`` and ``word``; stored."""
    n = partitions(rows.sparkSession)
    rows = rows.withColumns({"uid": F.monotonically_increasing_id(), "start": F.left("body", F.lit(PREFIX)), "word": F.xxhash64("body")})
    by = ["conv_id", "turn", "role", "start", "word", "uid"]
    rows = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("uid", F.monotonically_increasing_id())
    return stored(rows.drop("start").withColumn("block", F.shiftright("uid", BITS)), "lines")


def faults(rows: DataFrame) -> DataFrame:
    """``uid, conv_id, block, turn, initial, fault`` of lined rows; fault is blank, duplicate, truncated or null."""
    seen = F.xxhash64(F.lit("again"), F.col("role"), F.col("body"))
    last = F.regexp_extract("body", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    own = stored(
        rows.select("uid", "conv_id", "block", "turn", F.left("role", F.lit(1)).alias("initial"), "word", seen.alias("seen"), last.alias("last")), "facts"
    )
    first = own.groupBy("conv_id", "word", "seen").agg(F.min("uid").alias("uid")).select("uid", F.lit(True).alias("first"))
    own = own.hint("merge").join(first.hint("merge"), "uid", "left")
    fault = F.when(F.col("last") == "", "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    return own.select("uid", "conv_id", "block", "turn", "initial", fault.alias("fault"))


class Trail:
    """An audit as its last letters and the trail before them, with the state reached; trails share their beginnings."""

    __slots__ = ("up", "letters", "state", "depth")

    def __init__(self, up: Trail | None, letters: str, state: int) -> None:
        self.up, self.letters, self.state, self.depth = up, letters, state, up.depth + 1 if up else 0

    def __lt__(self, other: Trail) -> bool:
        """By audit; only what comes after the last common trail is read."""
        a, b, x, y = self, other, [], []
        while a is not b:
            if a.depth >= b.depth:
                x.append(a.letters)
                a = a.up
            else:
                y.append(b.letters)
                b = b.up
        return "".join(reversed(x)) < "".join(reversed(y))

    def parts(self) -> list[Trail]:
        """All trails but the empty one, in order."""
        out, at = [], self
        while at.up:
            out.append(at)
            at = at.up
        return out[::-1]


def lightest(steps: int, starts: Iterable[int], edits: Callable, inserts: bool) -> dict[tuple[int, int], tuple[int, Trail]]:
    """``(p, q) -> (cost, trail)``, the lightest way over all ``steps`` from state p in ``starts`` to q.

    ``edits(i, q)`` gives the facts of step i in state q: ``(cost, letters, next state)``.
    """
    empty = Trail(None, "", START)
    agenda = [(0, 0, empty, p, p) for p in starts]
    final: set[tuple[int, int, int]] = set()
    goals: dict[tuple[int, int], tuple[int, Trail]] = {}
    while agenda:
        cost, i, trail, p, q = heapq.heappop(agenda)
        if (i, p, q) in final:
            continue
        final.add((i, p, q))
        if i == steps:
            goals[p, q] = cost, trail
        else:
            for more, letters, to in edits(i, q):
                if (i + 1, p, to) not in final:
                    heapq.heappush(agenda, (cost + more, i + 1, Trail(trail, letters, to), p, to))
        if inserts and (i, p, to := NEXT[WANTED[q][0]][q]) not in final:
            heapq.heappush(agenda, (cost + INSERT, i, Trail(trail, "I", to), p, to))
    return goals


def row_edits(rows: list[tuple[str, str | None]]) -> Callable:
    """Facts of rows ``(initial, fault)``."""

    def edits(i: int, q: int) -> Iterator[tuple[int, str, int]]:
        initial, fault = rows[i]
        yield DELETE, "D", q
        if fault in ("blank", "duplicate"):
            return
        more = STAYS if fault else 0
        to = NEXT[initial][q] if initial in NEXT else -1
        if to >= 0:
            yield more, "K", to
        yield REROLE + more, "R", NEXT[WANTED[q][0]][q]

    return edits


def blocks(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row a block: its counts, its ends, and ``ways``, the lightest ``(p, q, cost, audit)``; and its rows, packed."""
    row = F.struct("uid", "initial", "fault", "turn")
    packed = facts.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    packed = stored(packed.withColumn("key", F.col("rows")[0].uid), "packed")
    firsts = packed.groupBy("conv_id").agg(F.min("key").alias("key")).select("key", F.lit(True).alias("first"))
    packed = packed.hint("merge").join(firsts.hint("merge"), "key", "left")
    names = ["key", "blank", "duplicate", "truncated", "illegal", "head", "tail", "ways"]
    way = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    kinds = [pa.int64(), *[pa.int64()] * 4, pa.string(), pa.string(), way]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, first, rows in zip(*(b.column(c).to_pylist() for c in ("key", "first", "rows"))):
                told, found = [r["initial"] for r in rows], [r["fault"] for r in rows]
                ways = lightest(len(rows), (START,) if first else range(4), row_edits(list(zip(told, found))), True)
                ways = [{"p": p, "q": q, "cost": c, "audit": "".join(x.letters for x in t.parts())} for (p, q), (c, t) in sorted(ways.items())]
                counts = [found.count(f) for f in ("blank", "duplicate", "truncated")]
                out.append([key, *counts, sum(illegal(x, y) for x, y in zip(told, told[1:])), told[0], told[-1], ways])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    schema = "key long, blank long, duplicate long, truncated long, illegal long, head string, tail string, ways array<struct<p int, q int, cost long, audit string>>"
    known = packed.select("key", "conv_id", "block")
    ways = packed.select("key", "first", "rows").mapInArrow(each, schema)
    return stored(known.hint("merge").join(ways.hint("merge"), "key"), "blocks"), packed


def illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def chained(found: DataFrame) -> DataFrame:
    """A row a block, ``key, start, part`` (the block's first state and its edits), and on a conversation's last block
    its counts, cost and audit; stored. Blocks of a conversation stream past in order."""
    n = partitions(found.sparkSession)
    dealt = found.repartition(n, "conv_id").sortWithinPartitions("conv_id", "key")
    counts = ["blank", "duplicate", "truncated", "illegal"]
    names = ["key", "start", "part", *counts, "cost", "audit"]
    kinds = [pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 5, pa.string()]

    def whole(rows: list[dict]) -> Iterator[list]:
        ways = [{} for _ in rows]
        for own, r in zip(ways, rows):
            for w in r["ways"]:
                own.setdefault(w["p"], []).append((w["cost"], w["audit"], w["q"]))
        goals = lightest(len(rows), (START,), lambda i, q: ways[i].get(q, ()), False)
        cost, best = min(goals[START, q] for q in ENDS if (START, q) in goals)
        sums = [sum(r[c] for r in rows) for c in counts]
        sums[-1] += sum(illegal(a["tail"], b["head"]) for a, b in zip(rows, rows[1:]))
        audit = "".join(x.letters for x in best.parts())
        for r, x in zip(rows, best.parts()):
            own = [*sums, cost, audit] if r is rows[-1] else [None] * 6
            yield [r["key"], x.up.state, x.letters, *own]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            out = []
            for r in b.to_pylist():
                if held and held[-1]["conv_id"] != r["conv_id"]:
                    out += whole(held)
                    held = []
                held.append(r)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*whole(held)), kinds)], names)

    schema = "key long, start int, part string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    return stored(dealt.mapInArrow(each, schema), "chains")


def edited(found: DataFrame, chains: DataFrame) -> DataFrame:
    """``uid, before, role, after``: a row's lines, and those of inserted messages around it; a null role is the row's own."""
    names = ["uid", "before", "edit", "role", "after"]
    kinds = [pa.int64(), pa.list_(pa.string()), pa.string(), pa.string(), pa.list_(pa.string())]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                q, at, before = r["start"], 0, []
                for letter in r["part"]:
                    if letter == "I":
                        before.append(f"{WANTED[q]}:")
                        q = NEXT[WANTED[q][0]][q]
                        continue
                    row, at = r["rows"][at], at + 1
                    out.append([row["uid"], before, letter, WANTED[q] if letter == "R" else None, []])
                    before = []
                    if letter != "D":
                        q = NEXT[row["initial"] if letter == "K" else WANTED[q][0]][q]
                out[-1][4] = before
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    both = found.select("key", F.transform("rows", lambda r: F.struct(r.uid.alias("uid"), r.initial.alias("initial"))).alias("rows"))
    both = both.hint("merge").join(chains.select("key", "start", "part").hint("merge"), "key").select("start", "part", "rows")
    return stored(both.mapInArrow(each, "uid long, before array<string>, edit string, role string, after array<string>"), "edits")


def hashed(lines: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of ``conv_id, uid, line``: lines stream past a running hash in order."""
    n = partitions(lines.sparkSession)
    dealt = lines.repartition(n, "conv_id").sortWithinPartitions("conv_id", "uid").select("conv_id", "line")

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, own, empty = None, None, True
        for b in batches:
            out = []
            for i, line in enumerate(b.column("line")):
                conv = b.column("conv_id").slice(i, 1)
                if running is None or own != conv:
                    if running is not None:
                        out.append((own, running.hexdigest()))
                    running, own, empty = sha256(), conv, True
                if line.as_py():
                    running.update(("" if empty else "\n").encode() + line.as_py().encode())
                    empty = False
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([c for c, _ in out]), pa.array([x for _, x in out])], ["conv_id", "repaired_sha256"])
        if running is not None:
            yield pa.RecordBatch.from_arrays([own, pa.array([running.hexdigest()])], ["conv_id", "repaired_sha256"])

    kind = lines.schema["conv_id"].dataType.simpleString()
    return dealt.mapInArrow(each, f"conv_id {kind}, repaired_sha256 string")


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``rows`` (conv_id, turn, role, body): the repaired messages ``conv_id, uid, line``, several lines where messages were
    inserted, empty where the row is gone; and a row a conversation, ``conv_id`` with counts, cost and audit."""
    lines = lined(rows)
    known = faults(lines)
    found, packed = blocks(known)
    chains = chained(found)
    edits = edited(packed, chains)
    both = lines.select("uid", "conv_id", "role", "body").withColumnRenamed("role", "own").hint("merge").join(edits.hint("merge"), "uid")
    own = F.when(F.col("edit") != "D", F.concat(F.coalesce("role", "own"), F.lit(":"), "body"))
    messages = both.select("conv_id", "uid", F.concat_ws("\n", "before", own, "after").alias("line"))
    turns = lines.where("turn is not null").groupBy("conv_id", F.col("turn").cast("long").alias("t")).agg(F.lit(1)).groupBy("conv_id")
    gaps = turns.agg((F.max("t") - F.min("t") + 1 - F.count("*")).alias("gaps")).withColumnRenamed("conv_id", "other")
    whole = chains.where("cost is not null").hint("merge").join(found.select("key", "conv_id").hint("merge"), "key")
    whole = whole.hint("merge").join(gaps.hint("merge"), F.col("conv_id").eqNullSafe(F.col("other")), "left")
    return messages, whole.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def reports(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each conversation of ``ids`` (conv_id): what ``repaired`` says, and the hash of its repaired lines."""
    messages, whole = repaired(rows)
    sums = hashed(messages).withColumnRenamed("conv_id", "other")
    whole = whole.hint("merge").join(sums.hint("merge"), F.col("conv_id").eqNullSafe(F.col("other"))).drop("other").withColumnRenamed("conv_id", "other")
    out = ids.distinct().hint("merge").join(whole.hint("merge"), F.col("conv_id").eqNullSafe(F.col("other")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(sha256(b"").hexdigest())
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return reports(damaged(rows, "conv_id", "turn", "role", "text"), rows.select("conv_id"))


_CRC = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}, ''), lambda x: [ascii(x)::BIGINT,0,0,0,0,0,0,0]))), "
    "lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295::BIGINT)"
)
_WHITE = r"[\x20\x09-\x0D]"
#: Row by row, the lightest (cost, audit) of each state; up to two insertions stand before a row and at the end, as more
#: would come back to a state at a cost. States and steps as in NEXT.
OP12_SQL = rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM raw WHERE kind <> 0),
line AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM hurt),
told AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prior,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?]{_WHITE}*$') THEN 'truncated' ELSE '' END AS fault
  FROM line),
step(initial, p, q) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('a', 2, 3), ('u', 3, 2)),
gain(p, ins, more, q) AS (
  VALUES (0, '', 0, 0), (1, '', 0, 1), (2, '', 0, 2), (3, '', 0, 3), (0, 'I', 3, 2), (1, 'I', 3, 2), (2, 'I', 3, 3), (3, 'I', 3, 2),
         (0, 'II', 6, 3), (1, 'II', 6, 3), (2, 'II', 6, 2), (3, 'II', 6, 3)),
edit AS (
  SELECT conv_id, i, n, 'D' AS letter, 4 AS more, NULL AS initial FROM told
  UNION ALL SELECT conv_id, i, n, 'K', CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, initial FROM told WHERE fault IN ('', 'truncated')
  UNION ALL SELECT conv_id, i, n, 'R', CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, unnest(['u', 'a']) FROM told WHERE fault IN ('', 'truncated')),
move AS (
  SELECT e.conv_id, e.i, g.p, g.ins || e.letter AS letters, g.more + e.more AS more, coalesce(s.q, g.q) AS q
  FROM edit e CROSS JOIN gain g LEFT JOIN step s ON s.initial = e.initial AND s.p = g.q WHERE e.letter = 'D' OR s.q IS NOT NULL),
best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, {{'cost': 0::BIGINT, 'audit': ''}} AS way FROM told
  UNION ALL
  SELECT b.conv_id, b.i + 1, m.q, min({{'cost': b.way.cost + m.more, 'audit': b.way.audit || m.letters}})
  FROM best b JOIN move m ON b.conv_id IS NOT DISTINCT FROM m.conv_id AND m.i = b.i + 1 AND m.p = b.q GROUP BY b.conv_id, b.i, m.q),
ends AS (
  SELECT b.conv_id, min({{'cost': b.way.cost + g.more, 'audit': b.way.audit || g.ins}}) AS way
  FROM best b JOIN (SELECT conv_id, max(i) AS n FROM told GROUP BY conv_id) t ON b.conv_id IS NOT DISTINCT FROM t.conv_id AND b.i = t.n
  JOIN gain g ON g.p = b.q AND g.q IN (0, 3) GROUP BY b.conv_id),
done AS (
  SELECT conv_id, way.audit AS audit, 0 AS at, 0::BIGINT AS used, 0 AS q, []::VARCHAR[] AS lines FROM ends
  UNION ALL
  SELECT d.conv_id, d.audit, d.at + 1, d.used + (x.letter <> 'I')::INT, coalesce(s.q, d.q),
         CASE x.letter WHEN 'D' THEN d.lines WHEN 'K' THEN list_append(d.lines, t.role || ':' || t.text)
              ELSE list_append(d.lines, CASE d.q WHEN 2 THEN 'assistant:' ELSE 'user:' END || CASE x.letter WHEN 'R' THEN t.text ELSE '' END) END
  FROM done d, LATERAL (SELECT substr(d.audit, d.at + 1, 1) AS letter) x
  LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM d.conv_id AND t.i = d.used + 1 AND x.letter <> 'I'
  LEFT JOIN step s ON s.p = d.q AND s.initial = CASE x.letter WHEN 'K' THEN t.initial WHEN 'D' THEN NULL ELSE CASE d.q WHEN 2 THEN 'a' ELSE 'u' END END
  WHERE d.at < length(d.audit)),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY conv_id),
all_ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, coalesce(s.gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate,
       coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal, coalesce(e.way.cost, 0)::BIGINT AS cost, coalesce(e.way.audit, '') AS audit,
       sha256(coalesce(array_to_string(d.lines, chr(10)), '')) AS repaired_sha256
FROM all_ids a LEFT JOIN sums s ON a.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN ends e ON a.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN done d ON a.conv_id IS NOT DISTINCT FROM d.conv_id AND d.at = length(d.audit)"""
