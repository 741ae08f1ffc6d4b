"""Quotation linking of conversations.

A line, which ends in a line feed or a carriage return and one, has as its quote level the number of ``>`` that it starts
with. Lines of one level in a row are a passage; a
passage's pieces are its sentences, white space and case made even, so a quote that wraps its lines anew keeps its hashes.
A quoted piece comes from the latest earlier turn of its conversation that says it unquoted; a passage comes from the
turn that most of its pieces come from, the later one if two tie. A message replies to the origin of most of its
level-1 pieces. Replies form threads: a conversation is ordered by each thread's first turn, then by turn, so that a
reply stands after what it replies to, and bodies have no quotes left.

The look-up of earlier turns is an as-of join in two steps, within blocks of turns and over blocks, and so is the
numbering, so no task needs a whole conversation or all places of one common line.

Defined results: null or empty text has an empty body and no quotes; a message with a null conversation or turn links to
nothing and is a thread of its own, with position null; rows that repeat a turn are messages of their own, in the
order of role and body, and a quote of their turn means the turn. A quote that nobody said is counted, not linked.
Only the id, turn, role and text columns are read, so extra columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

QUOTE = re.compile(r"((?:[ \t]*>)+)[ \t]?")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: Turns in a block.
BLOCK = 1000


def pieces(text: str) -> list[int]:
    """Hashes of a passage's sentences."""
    parts = (" ".join(s.split()).lower() for s in SENTENCE.split(" ".join(text.split())))
    return [xxhash.xxh64_intdigest(s) - (1 << 63) for s in parts if s]


def parsed(text: str | None) -> tuple[str, list[tuple[int, int, int]]]:
    """The body without quotes, and ``(passage, level, hash)`` of every piece, quoted or not."""
    passages: list[tuple[int, list[str]]] = []
    for line in (text or "").replace("\r\n", "\n").split("\n"):
        m = QUOTE.match(line)
        level = m[1].count(">") if m else 0
        if not passages or passages[-1][0] != level:
            passages.append((level, []))
        passages[-1][1].append(line[m.end() :] if m else line)
    body = "\n".join(line for level, lines in passages if not level for line in lines).strip("\n")
    return body, [(i, level, h) for i, (level, lines) in enumerate(passages) for h in pieces("\n".join(lines))]


def messages(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``uid, conv_id, turn, role, body, pieces``."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("hash", pa.int64())]))
        for b in batches:
            found = [parsed(t) for t in b.column("text").to_pylist()]
            own = [[{"passage": p, "level": v, "hash": h} for p, v, h in x] for _, x in found]
            columns = [b.column(c) for c in ("uid", "conv_id", "turn", "role")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([x for x, _ in found], pa.string()), pa.array(own, kind)], ["uid", "conv_id", "turn", "role", "body", "pieces"]
            )

    some = rows.select(
        F.monotonically_increasing_id().alias("uid"), F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.col(role).cast("string").alias("role"), F.col(text).alias("text"),
    )
    schema = "uid long, conv_id long, turn long, role string, body string, pieces array<struct<passage int, level int, hash long>>"
    return stored(some.mapInArrow(each, schema), "messages")


def origins(quoted: DataFrame, said: DataFrame) -> DataFrame:
    """``quoted`` with ``origin``, the latest turn before its own in ``said`` (conv_id, hash, turn); null if there is none."""
    key = ["conv_id", "hash"]
    said = said.hint("merge").join(quoted.select(*key).distinct().hint("merge"), key, "left_semi").distinct()
    block = F.floor(F.col("turn") / BLOCK)
    both = said.select(*key, "turn", F.col("turn").alias("at"), F.lit(None).cast("long").alias("uid"), F.lit(None).cast("int").alias("passage"), F.lit(None).cast("int").alias("level"))
    both = both.unionByName(quoted.withColumn("at", F.lit(None).cast("long"))).withColumn("block", block)
    both = stored(both, "turns")
    before = W.partitionBy(*key).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    last = both.groupBy(*key, "block").agg(F.max("at").alias("own")).withColumn("earlier", F.max("own").over(before)).drop("own")
    inside = W.partitionBy(*key, "block").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    found = both.withColumn("inside", F.max("at").over(inside)).where("uid is not null")
    found = found.hint("merge").join(last.hint("merge"), [*key, "block"], "left")
    return found.select("uid", "conv_id", "turn", "passage", "level", F.coalesce("inside", "earlier").alias("origin"))


def passages(parts: DataFrame) -> DataFrame:
    """``uid, conv_id, turn, passage, level, origin, pieces``: a row for each quoted passage."""
    some = parts.select("uid", "conv_id", "turn", F.inline("pieces")).where("conv_id is not null and turn is not null")
    quoted = some.where("level > 0").select("uid", "conv_id", "turn", "passage", "level", "hash")
    found = stored(origins(quoted, some.where("level = 0").select("conv_id", "hash", "turn")), "origins")
    votes = found.groupBy("uid", "conv_id", "turn", "passage", "level", "origin").agg(F.count("*").alias("n"))
    best = F.max_by("origin", F.when(F.col("origin").isNotNull(), F.struct("n", "origin")))
    return votes.groupBy("uid", "conv_id", "turn", "passage", "level").agg(best.alias("origin"), F.sum("n").alias("pieces"))


def threads(replies: DataFrame) -> DataFrame:
    """``conv_id, turn, thread`` from ``conv_id, turn, up``: the turn at the top, by doubling the step each time."""
    links = stored(replies, "links")
    while True:
        above = links.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("further"))
        new = links.hint("merge").join(above.hint("merge"), ["conv_id", "up"], "left")
        new = stored(new.select("conv_id", "turn", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")), "links")
        links = new.select("conv_id", "turn", "up")
        if not new.where("moved").take(1):
            return links.withColumnRenamed("up", "thread")


def conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, body, n_quotes, quote_level, n_linked, reply_to, thread, position, chat`` for each row.

    ``position`` orders a conversation, from 0; ``chat`` is the message as a chat template writes it.
    """
    parts = messages(rows, conv, turn, role, text)
    quotes = stored(passages(parts), "passages")
    level1 = quotes.where("level = 1 and origin is not null").groupBy("uid", "origin").agg(F.sum("pieces").alias("n"))
    reply = level1.groupBy("uid").agg(F.max_by("origin", F.struct("n", "origin")).alias("reply_to"))
    counts = quotes.groupBy("uid").agg(F.count("*").alias("n_quotes"), F.max("level").alias("quote_level"), F.count("origin").alias("n_linked"))
    own = parts.select("uid", "conv_id", "turn", "role", "body").hint("merge").join(counts.hint("merge"), "uid", "left")
    own = stored(own.hint("merge").join(reply.hint("merge"), "uid", "left"), "replies")
    up = own.where("reply_to is not null").groupBy("conv_id", "turn").agg(F.max("reply_to").alias("up"))
    own = own.hint("merge").join(threads(up).hint("merge"), ["conv_id", "turn"], "left").withColumn("thread", F.coalesce("thread", "turn"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    block = [F.floor(F.col(c) / BLOCK).alias(f"{c}_block") for c in ("thread", "turn")]
    own = stored(own.select("*", *block), "threads")
    # positions: rows of earlier threads' blocks, then by thread and turn inside; a block of threads with many turns is cut by turn
    per = own.where(known).groupBy("conv_id", "thread", "turn_block").agg(F.count("*").alias("n"), F.first("thread_block").alias("thread_block"))
    sums = per.groupBy("conv_id", "thread_block").agg(F.sum("n").alias("all"))
    sums = sums.withColumn("before", F.sum("all").over(W.partitionBy("conv_id").orderBy("thread_block").rowsBetween(W.unboundedPreceding, -1)))
    inner = W.partitionBy("conv_id", "thread_block").orderBy("thread", "turn_block").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("inner", F.sum("n").over(inner)).hint("merge").join(sums.hint("merge"), ["conv_id", "thread_block"])
    per = per.select("conv_id", "thread", "turn_block", (F.coalesce("before", F.lit(0)) + F.coalesce("inner", F.lit(0))).alias("first"))
    row = F.row_number().over(W.partitionBy("conv_id", "thread", "turn_block").orderBy("turn", "role", "body", "uid")) - 1
    out = own.where(known).hint("merge").join(per.hint("merge"), ["conv_id", "thread", "turn_block"]).withColumn("position", F.col("first") + row)
    out = out.unionByName(own.where(~known), allowMissingColumns=True)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    chat = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), "body", F.lit("\n"))
    return out.select("conv_id", "turn", "role", "body", zero("n_quotes"), zero("quote_level"), zero("n_linked"), "reply_to", "thread", "position", chat.alias("chat"))


def op1_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
