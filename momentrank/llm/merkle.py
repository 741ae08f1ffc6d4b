"""Merkle manifest of a dataset as a content-addressed graph, and proofs by descent from its root.

H is the lowercase hex SHA-256 of its inputs, digests as hex text. A row is a leaf: H of its columns in turn, each ``-``
where it is null, else its UTF-8 byte count, ``:`` and its value. A group's leaves ascend by id, and every WIDTH nodes in a
row become one node, until one is left, the subroot. Subroots, by the group's name, make the root in the same way.

The graph is kept as records ``digest -> children``. GENERATIONS of them stand in one record, a page, under the digest of
its top node: what lies below a node of height 6 is looked up once and not in six joins. Equal subtrees have one record. A
proof starts at the root: requests for a page's leaves travel down together, look up the record of the digest that they
have reached, take the child that the rank's digits in base WIDTH pick, and keep the others as a segment of the
path. The segments, collected from the root, are reversed at the leaf. So tables shrink by WIDTH ** GENERATIONS from one
step to the next, what travels is a row a page, and leaves are met once to make pages and once to answer.

Ranks need no task that sees a whole group: rows are sorted into ranges of (group, id, digest, row), and the rows of a
group in earlier ranges are counted.

Defined results: a null id comes first, rows that share an id are ordered by digest, and equal rows are leaves of their own;
a null group is a group of its own, the first, and differs from an empty name. A group of one row has that leaf as
subroot; one group's subroot is the root; a proof without siblings is H of nothing. No rows give no root and no proofs. Ids
have any type that can be sorted, groups any that casts to text. Only the named columns are read, so extra columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, salted_join, stored

WIDTH, GENERATIONS = 3, 6
PAGE = WIDTH**GENERATIONS
GROUP = ["known", "name"]


def digest_of(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(*columns: Column) -> Column:
    """H of a row's columns."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def numbered(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """``leaves`` (known, name and more) with ``rank`` from 0 in their group, by ``order``; stored."""
    n = partitions(leaves.sparkSession)
    leaves = leaves.withColumn("row", F.monotonically_increasing_id())  # tells equal rows apart, and lets ranges cut between them
    by = [*GROUP, *order, "row"]
    dealt = leaves.repartitionByRange(n, *by).sortWithinPartitions(*by)
    dealt = stored(dealt.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "leaves")
    ranges = dealt.groupBy(*GROUP, "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.sum("n").over(W.partitionBy(*GROUP).orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    ranges = ranges.select(*GROUP, "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    both = dealt.hint("merge").join(ranges.hint("merge"), [*GROUP, "part"])
    return both.withColumn("rank", F.col("row") + F.col("shift")).drop("row", "part", "shift")


def height(n: Column) -> Column:
    """Levels above ``n`` leaves until one node is left."""
    return F.size(F.filter(F.array(*[F.lit(WIDTH**k).cast("long") for k in range(40)]), lambda most: most < n))


def generations(digests: list[str], levels: int) -> list[list[str]]:
    """A page's nodes, level by level: the given ones, then their parents, up to ``levels`` above."""
    out = [digests]
    for _ in range(levels):
        last = out[-1]
        out.append([digest_of("".join(last[k : k + WIDTH])) for k in range(0, len(last), WIDTH)])
    return out


def segments(page: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """What stands left and right of the node on the way from place ``at`` up to the page's top, level by level."""
    left, right = [], []
    for level in page[:-1]:
        first = at - at % WIDTH
        left.append("".join(level[first:at]))
        right.append("".join(level[at + 1 : first + WIDTH]))
        at //= WIDTH
    return left, right


def records(pages: DataFrame) -> DataFrame:
    """``known, name, at, height, digest, levels`` of pages (known, name, at, height, digests); ``levels`` has the top node last."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            levels = [generations(d, k) for d, k in zip(b.column("digests").to_pylist(), b.column("levels").to_pylist())]
            columns = [*(b.column(c) for c in (*GROUP, "at", "height")), pa.array([x[-1][0] for x in levels], pa.string())]
            columns.append(pa.array(levels, pa.list_(pa.list_(pa.string()))))
            yield pa.RecordBatch.from_arrays(columns, [*GROUP, "at", "height", "digest", "levels"])

    schema = "known boolean, name string, at long, height int, digest string, levels array<array<string>>"
    return stored(pages.mapInArrow(each, schema), "records")


def tree(asked: DataFrame, heights: DataFrame) -> list[DataFrame]:
    """Records of each band of GENERATIONS levels, from pages of leaves ``(known, name, at, asks)`` with a digest in each ask."""
    sized = asked.hint("merge").join(heights.hint("merge"), GROUP)
    levels = lambda band: F.greatest(F.lit(0), F.least(F.lit(GENERATIONS), F.col("height") - band * GENERATIONS)).alias("levels")
    bands = [records(sized.select(*GROUP, "at", "height", levels(0), F.transform("asks", lambda a: a.leaf).alias("digests")))]
    most = heights.agg(F.max("height")).first()[0] or 0
    for band in range(1, -(-most // GENERATIONS)):
        below = bands[-1].where(F.col("height") > band * GENERATIONS)
        up = below.groupBy(*GROUP, F.floor(F.col("at") / PAGE).alias("at"), "height")
        up = up.agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("x"))
        bands.append(records(up.select(*GROUP, "at", "height", levels(band), F.transform("x", lambda a: a.digest).alias("digests"))))
    return bands


def tops(bands: Sequence[DataFrame]) -> DataFrame:
    """``known, name, height, digest``: the top node of each group."""
    own = [b.where(F.greatest(F.lit(0), F.ceil(F.col("height") / GENERATIONS) - 1) == k).select(*GROUP, "height", "digest") for k, b in enumerate(bands)]
    out = own[0]
    for b in own[1:]:
        out = out.union(b)
    return out


def descended(bands: Sequence[DataFrame], asked: DataFrame, roots: DataFrame, answer, schema: str) -> DataFrame:
    """What ``answer(claim, way, place)`` gives for every leaf, by descent from ``roots``.

    ``roots``: known, name, height, digest, subroot, left, right; the last two hold what lies above a group's top node. A
    step looks up records by digest; ``left`` and ``right`` hold a string a level, from the page's own top upwards.
    """
    store = [b.select("digest", "levels").dropDuplicates(["digest"]) for b in bands]
    start = lambda k: roots.where(F.greatest(F.lit(0), F.ceil(F.col("height") / GENERATIONS) - 1) == k).withColumn("at", F.lit(0).cast("long"))
    columns = [*GROUP, "height", "digest", "subroot", "left", "right", "at"]
    here = stored(start(len(bands) - 1).select(columns), "requests")

    def down(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*columns]
        for b in batches:
            for r in b.to_pylist():
                out = []
                for i, child in enumerate(r["levels"][0]):
                    left, right = segments(r["levels"], i)
                    out.append([r["known"], r["name"], r["height"], child, r["subroot"], left + r["left"], right + r["right"], r["at"] * PAGE + i])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    kinds = [pa.bool_(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64()]
    ddl = "known boolean, name string, height int, digest string, subroot string, left array<string>, right array<string>, at long"
    for k in range(len(bands) - 1, 0, -1):
        met = salted_join(here, store[k], "digest", "at", here.count())
        here = stored(met.mapInArrow(down, ddl).unionByName(start(k - 1).select(columns)), "requests")
    met = stored(salted_join(here, store[0], "digest", "at", here.count()), "reached")
    met = met.hint("merge").join(asked.hint("merge"), [*GROUP, "at"])

    own = [f for f in asked.schema["asks"].dataType.elementType.fields if f.name not in ("rank", "claim")]
    given = dict(c.split() for c in schema.split(", "))

    def answers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"string": pa.string(), "array<string>": pa.list_(pa.string())}
        for b in batches:
            for r in range(b.num_rows):
                way = {c: b.column(c)[r].as_py() for c in ("subroot", "levels", "left", "right")}
                part = b.column("asks")[r].values
                out = zip(*[answer(claim, way, i) for i, claim in enumerate(part.field("claim").to_pylist())])
                columns = [pa.array(c, types[t]) for c, t in zip(out, given.values())]
                yield pa.RecordBatch.from_arrays([*[part.field(f.name) for f in own], *columns], [*[f.name for f in own], *given])

    return met.select("subroot", "levels", "left", "right", "asks").mapInArrow(answers, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in own], schema]))


def proof(claim: str, way: dict, at: int) -> tuple[str, str, str]:
    """The subroot, H of the siblings from leaf to root, and the root that ``claim`` in the leaf's place folds to."""
    left, right = segments(way["levels"], at)
    node, path = claim, []
    for a, b in zip(left + way["left"], right + way["right"]):
        path += [a, b]
        node = digest_of(a + node + b)
    return way["subroot"], digest_of("".join(path)), node


def paths(claim: str, way: dict, at: int) -> tuple[list[str], list[str]]:
    left, right = segments(way["levels"], at)
    return left + way["left"], right + way["right"]


def asks(ranked: DataFrame, *own: str) -> DataFrame:
    """A row a page: ``known, name, at, asks``, the requests for its leaves in order."""
    ask = F.struct("rank", "leaf", "claim", *own)
    pages = ranked.groupBy(*GROUP, F.floor(F.col("rank") / PAGE).alias("at")).agg(F.array_sort(F.collect_list(ask), lambda a, b: (a.rank - b.rank).cast("int")).alias("asks"))
    return stored(pages, "asks")


def heights(ranked: DataFrame) -> DataFrame:
    return stored(ranked.groupBy(*GROUP).agg(height(F.max("rank") + 1).alias("height")), "heights")


def proofs(rows: DataFrame, id_col: str, group_col: str, leaf_of: Column, claim_of: Column) -> DataFrame:
    """``id, leaf, subroot, root, proof, folded`` for each row: the proof of ``leaf_of``, and the root that ``claim_of`` folds to."""
    group = F.col(group_col).cast("string")
    leaves = rows.select(
        group.isNotNull().alias("known"), F.coalesce(group, F.lit("")).alias("name"), F.col(id_col).alias("id"), leaf_of.alias("leaf"), claim_of.alias("claim")
    )
    asked = asks(numbered(leaves, ["id", "leaf"]), "id")
    pages = asked.select(*GROUP, (F.col("at") * PAGE + F.size("asks") - 1).alias("rank"))
    bands = tree(asked, heights(pages))
    subroots = stored(tops(bands), "subroots")
    # the same again over subroots, as leaves of one group
    one = subroots.select(F.lit(True).alias("known"), F.lit("").alias("name"), F.col("known").alias("own_known"), F.col("name").alias("own_name"), "height", F.col("digest").alias("leaf"), F.col("digest").alias("claim"))
    ranked = numbered(one, ["own_known", "own_name"])
    upper = asks(ranked, "own_known", "own_name", "height")
    top = tree(upper, heights(upper.select(*GROUP, (F.col("at") * PAGE + F.size("asks") - 1).alias("rank"))))
    root = tops(top).first()
    none = F.array().cast("array<string>")
    begin = tops(top).select("*", F.lit("").alias("subroot"), none.alias("left"), none.alias("right"))
    ways = descended(top, upper, begin, paths, "left array<string>, right array<string>")
    ways = ways.select(F.col("own_known").alias("known"), F.col("own_name").alias("name"), "height", F.col("leaf").alias("digest"), F.col("leaf").alias("subroot"), "left", "right")
    found = descended(bands, asked, stored(ways, "ways"), proof, "subroot string, proof string, folded string")
    return found.select("id", "leaf", "subroot", F.lit(root.digest if root else None).cast("string").alias("root"), "proof", "folded")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof; where 2 divides the id's CRC-32 the claim is a copy without line feeds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = ["doc_id", "source", "lang", "n_chars"]
    bad = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(bad, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    own = [F.col(c) for c in columns]
    claim = F.when(bad & (F.instr("text", "\n") > 0), leaf(*own, text)).otherwise(leaf(*own, F.col("text")))
    found = proofs(docs, "doc_id", "source", leaf(*own, F.col("text")), claim)
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {0})"
_CRC = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}, ''), lambda x: [ascii(x)::BIGINT,0,0,0,0,0,0,0]))), "
    "lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295::BIGINT)"
)
#: The tree level by level, once over leaves and once over subroots; siblings by place, and a fold up the levels.
OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT *, CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS told FROM documents),
l AS (SELECT doc_id, source, {_LEAF.format(_FIELD.format("text"))} AS leaf, {_LEAF.format(_FIELD.format("told"))} AS claim FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n FROM l),
t AS (
  SELECT source, 0 AS level, rank AS pos, leaf AS digest, n FROM r
  UNION ALL
  SELECT source, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY source, level, pos // 3, n),
s AS (SELECT source, digest AS subroot, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, rank AS pos, subroot AS digest, n FROM s
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY level, pos // 3, n),
p AS (SELECT source, level, pos // 3 AS parent, array_agg(digest ORDER BY pos) AS kids FROM t WHERE n > 1 GROUP BY source, level, pos // 3),
q AS (SELECT level, pos // 3 AS parent, array_agg(digest ORDER BY pos) AS kids FROM u WHERE n > 1 GROUP BY level, pos // 3),
way AS (
  SELECT r.doc_id, r.leaf, r.rank, r.source, p.level, p.kids, (r.rank // power(3, p.level)::BIGINT) % 3 AS place
  FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source AND p.parent = r.rank // power(3, p.level + 1)::BIGINT
  UNION ALL
  SELECT r.doc_id, r.leaf, r.rank, r.source, s.height + q.level, q.kids, (s.rank // power(3, q.level)::BIGINT) % 3
  FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source JOIN q ON q.parent = s.rank // power(3, q.level + 1)::BIGINT),
w AS (SELECT source, rank, level, array_to_string(list_slice(kids, 1, place), '') AS a, array_to_string(list_slice(kids, place + 2, 3), '') AS b FROM way),
f AS (
  SELECT source, rank, 0 AS level, claim AS node FROM r
  UNION ALL
  SELECT f.source, f.rank, f.level + 1, sha256(w.a || f.node || w.b) FROM f JOIN w ON f.source IS NOT DISTINCT FROM w.source AND f.rank = w.rank AND f.level = w.level),
o AS (SELECT source, rank, arg_max(node, level) AS folded FROM f GROUP BY source, rank),
k AS (SELECT source, rank, sha256(string_agg(a || b, '' ORDER BY level)) AS proof FROM w GROUP BY source, rank)
SELECT r.doc_id, r.leaf, s.subroot, (SELECT digest FROM u WHERE n = 1) AS root, coalesce(k.proof, sha256('')) AS proof_sha256, o.folded AS folded_root,
       o.folded = (SELECT digest FROM u WHERE n = 1) AS verified
FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source JOIN o ON r.source IS NOT DISTINCT FROM o.source AND r.rank = o.rank
LEFT JOIN k ON r.source IS NOT DISTINCT FROM k.source AND r.rank = k.rank"""
