"""Embedding near-duplicates: navigable small-world graphs, one a shard, and every shard queried.

Equal vectors of a label are one class first, with a number of its own and a count. A label's classes are dealt to shards
of about SHARD vectors by a hash; a shard builds its hierarchical graph, and audits it: members turned away to the threshold
cosine must be found again, and the beam is widened until enough are. Each block of queries (the shards' own members) goes
to every graph of its label: graphs are dealt to lanes, a lane's task takes its graph first and then the blocks one by one,
so only queries are copied. A query whose beam is full of links may have more of them, so it is compared with the
whole shard. What the search finds is verified in double precision; found links make local components, in which all pairs of
queries and members are then compared exactly, in blocks, so a dense group's counts don't hang on the beam. A task gives
counts and one link from each vector to its local component's smallest, never pairs. Local components join over all shards
by alternating stars.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or
a null id, link with nothing: no links, a component of their own, kept. Vectors of another length than the label's
most common one form shards of their own. Each row is a vector, so a repeated row links with its copy, and rows that share
an id are linked, or not, each for itself; component_id is the smallest id of the rows reached. Ids have any type that can be
sorted, and labels any type: they are equal or not, as they are. Only the id, vector
and label columns are read, so extra columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, partitions, salted_join, stored

THRESHOLD = 0.93
SHARD = 8192
#: Links a vector picks, and links that others may add, a layer; one vector in SPREAD is in the next layer up.
OWN, ADDED, SPREAD = 16, 16, 16
BEAM = 48
#: Members that an audit turns away and looks for, and the share that must be found.
AUDIT, RECALL = 256, 0.985
QUERIES = 512
#: Tasks that share the queries of one graph.
LANES = 4


class Graph:
    def __init__(self, vectors: np.ndarray) -> None:
        self.x = vectors.astype(np.float32)
        rng = np.random.default_rng(len(vectors))
        level = np.minimum((-np.log(1 - rng.random(len(vectors))) / np.log(SPREAD)).astype(int), 6)
        self.layers = [np.flatnonzero(level >= k) for k in range(level.max(initial=0) + 1)]
        self.links = [np.full((len(vectors), OWN + ADDED), -1, np.int32) for _ in self.layers]
        self.near = [np.full((len(vectors), ADDED), -2, np.float32) for _ in self.layers]
        for k in range(len(self.layers) - 1, -1, -1):
            nodes, at = self.layers[k], 0
            while at < len(nodes):
                size = min(len(nodes) - at, 512, max(128, at))
                self.insert(k, nodes[:at], nodes[at : at + size])
                at += size

    def insert(self, k: int, old: np.ndarray, new: np.ndarray) -> None:
        """Link a batch of nodes to what is there, and to each other."""
        q = self.x[new]
        own = q @ q.T
        np.fill_diagonal(own, -2)
        take = min(BEAM, len(new) - 1)
        near = np.argpartition(-own, take - 1, axis=1)[:, :take] if take > 0 else np.zeros((len(new), 0), int)
        ids, sims = new[near], np.take_along_axis(own, near, 1)
        if len(old):
            found, near_old = self.beam(k, q, self.descend(q, k, old), BEAM)
            ids, sims = np.concatenate([ids, found], 1), np.concatenate([sims, near_old], 1)
        by = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)
        picked = self.diverse(ids, sims)
        self.links[k][new, :OWN] = picked
        # each picked node may add the new one in return, if it is nearer than what others added
        a, b = np.repeat(new, OWN), picked.ravel()
        a, b = a[b >= 0], b[b >= 0]
        sim = np.einsum("ij,ij->i", self.x[a], self.x[b])
        there = np.unique(b)
        held = self.links[k][there, OWN:]
        a = np.concatenate([a, held.ravel()])
        b = np.concatenate([b, np.repeat(there, ADDED)])
        sim = np.concatenate([sim, self.near[k][there].ravel()])
        by = np.lexsort((-sim, b))
        a, b, sim = a[by], b[by], sim[by]
        rank = np.arange(len(b)) - np.searchsorted(b, b)
        keep = (rank < ADDED) & (a >= 0)
        self.links[k][there, OWN:], self.near[k][there] = -1, -2
        self.links[k][b[keep], OWN + rank[keep]] = a[keep]
        self.near[k][b[keep], rank[keep]] = sim[keep]

    def diverse(self, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Of candidates, nearest first, those nearer to the node than to any picked before; then the nearest others."""
        n, width = ids.shape
        picked, count = np.full((n, OWN), -1, np.int32), np.zeros(n, int)
        spare = np.zeros((n, width), bool)
        for c in range(width):
            some = np.flatnonzero((ids[:, c] >= 0) & (count < OWN))
            if not len(some):
                continue
            most = count[some].max()
            other = picked[some, :most]
            to = np.einsum("id,imd->im", self.x[ids[some, c]], self.x[other]) if most else np.zeros((len(some), 0), np.float32)
            good = ~((to > sims[some, c, None]) & (other >= 0)).any(1)
            spare[some[~good], c] = True
            some = some[good]
            picked[some, count[some]] = ids[some, c]
            count[some] += 1
        for i in np.flatnonzero((count < OWN) & spare.any(1)):
            rest = ids[i, spare[i]][: OWN - count[i]]
            picked[i, count[i] : count[i] + len(rest)] = rest
        return picked

    def descend(self, q: np.ndarray, to: int, present: np.ndarray) -> np.ndarray:
        """Seeds for layer ``to``: the best few of the layer above, or some node that is there."""
        top = len(self.layers) - 1
        if to == top:
            return np.repeat(present[None, :4], len(q), 0)
        seeds = np.repeat(self.layers[top][None, :4], len(q), 0)
        for k in range(top, to, -1):
            seeds = self.beam(k, q, seeds, 12)[0][:, :6]
        # a node of an upper layer comes first in every layer below it only if it is there already
        there = np.zeros(len(self.x), bool)
        there[present] = True
        seeds = np.where((seeds >= 0) & there[seeds], seeds, -1)
        return np.concatenate([seeds, np.repeat(present[None, :2], len(q), 0)], 1)

    def beam(self, k: int, q: np.ndarray, seeds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ``width`` nodes for each query, and their cosines, best first; -1 where there are fewer."""
        n, rows = len(self.x), np.arange(len(q))
        seen = np.zeros((len(q), n), bool)
        ids, sims = np.full((len(q), width), -1, np.int32), np.full((len(q), width), -2, np.float32)
        done = np.ones((len(q), width), bool)
        who, what = np.repeat(rows, seeds.shape[1]), seeds.ravel()
        while True:
            key = np.unique(who[what >= 0] * n + what[what >= 0])
            who, what = key // n, key % n
            new = ~seen[who, what]
            who, what = who[new], what[new]
            if not len(who):
                break
            seen[who, what] = True
            sim = np.einsum("ij,ij->i", q[who], self.x[what])
            better = sim > sims[who, -1]
            who, what, sim = who[better], what[better], sim[better]
            if len(who):
                place = np.arange(len(who)) - np.searchsorted(who, who)
                pad = place.max() + 1
                i2, s2 = np.full((len(q), pad), -1, np.int32), np.full((len(q), pad), -2, np.float32)
                i2[who, place], s2[who, place] = what, sim
                ids, sims = np.concatenate([ids, i2], 1), np.concatenate([sims, s2], 1)
                done = np.concatenate([done, i2 < 0], 1)
                by = np.argsort(-sims, axis=1, kind="stable")[:, :width]
                ids, sims, done = (np.take_along_axis(x, by, 1) for x in (ids, sims, done))
            step = np.argsort(done, axis=1, kind="stable")[:, :6]  # the nearest that are not yet expanded
            some = ~np.take_along_axis(done, step, 1)
            np.put_along_axis(done, step, True, 1)
            if not some.any():
                break
            who, at = np.nonzero(some)
            nodes = ids[who, step[who, at]]
            what = self.links[k][nodes].ravel()
            who = np.repeat(who, OWN + ADDED)
        return ids, sims

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        return self.beam(0, q, self.descend(q, 0, self.layers[0]), width)

    def audited(self, threshold: float) -> int:
        """The beam's width at which enough of the members that are turned away to the threshold are found again."""
        rng = np.random.default_rng(1)
        at = rng.permutation(len(self.x))[:AUDIT]
        aside = rng.standard_normal(self.x[at].shape)
        aside -= self.x[at] * np.einsum("ij,ij->i", aside, self.x[at])[:, None]
        aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-9)
        q = (self.x[at] * (threshold + 0.01) + aside * np.sqrt(1 - (threshold + 0.01) ** 2)).astype(np.float32)
        width = BEAM
        while width < len(self.x):
            ids, sims = self.search(q, width)
            got = (sims >= threshold).any(1)
            if got.mean() >= RECALL:
                break
            width *= 2
        return width


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def smallest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Label of each of n nodes: the smallest node that links a-b reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compared(graph: Graph, width: int, ids: np.ndarray, mult: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """``node, links, root`` for queries and members that are linked; all ids are of classes, links count their vectors."""
    a, b = [], []
    for s in range(0, len(q), QUERIES):
        found, sims = graph.search(q[s : s + QUERIES].astype(np.float32), width)
        full = np.flatnonzero(sims[:, -1] >= threshold - 1e-3)
        for rows in (full[k : k + 128] + s for k in range(0, len(full), 128)):
            i, m = np.nonzero(q[rows] @ x.T >= threshold)
            # one link from each to the smallest that it reaches here: pairs could be as many as the shard's square
            near, at = np.unique(np.concatenate([q_ids[rows[i]], ids[m]]), return_inverse=True)
            label = smallest(at[: len(i)], at[len(i) :], len(near))
            a.append(near)
            b.append(near[label])
        sims[full] = -2
        i, j = np.nonzero(sims >= threshold - 1e-3)
        i, m = i + s, found[i, j]
        good = (np.einsum("ij,ij->i", q[i], x[m]) >= threshold) & (q_ids[i] != ids[m])
        a.append(q_ids[i[good]])
        b.append(ids[m[good]])
    a, b = np.concatenate(a), np.concatenate(b)
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = smallest(at[: len(a)], at[len(a) :], len(nodes))
    q_at, m_at = np.searchsorted(nodes, q_ids), np.searchsorted(nodes, ids)
    q_in = np.flatnonzero(nodes[np.minimum(q_at, len(nodes) - 1)] == q_ids) if len(nodes) else np.zeros(0, int)
    m_in = np.flatnonzero(nodes[np.minimum(m_at, len(nodes) - 1)] == ids) if len(nodes) else np.zeros(0, int)
    q_in, m_in = (v[np.argsort(label[w[v]], kind="stable")] for v, w in ((q_in, q_at), (m_in, m_at)))
    q_label, m_label = label[q_at[q_in]], label[m_at[m_in]]
    links = np.zeros(len(q_in), np.int64)
    for c in np.unique(q_label):
        qs = np.arange(*np.searchsorted(q_label, [c, c + 1]))
        ms = m_in[slice(*np.searchsorted(m_label, [c, c + 1]))]
        for s in range(0, len(qs), 1024):
            rows = q_in[qs[s : s + 1024]]
            near = (q[rows] @ x[ms].T >= threshold) & (q_ids[rows, None] != ids[ms])
            links[qs[s : s + 1024]] = near @ mult[ms]
    zero = np.zeros(len(m_in), np.int64)
    return np.concatenate([q_ids[q_in], ids[m_in]]), np.concatenate([links, zero]), nodes[np.concatenate([q_label, m_label]).astype(int)]


def linked(classes: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """``node, links, root`` rows of all searches, from ``id, label, size, vector, mult``."""
    n = partitions(classes.sparkSession)
    counts = classes.groupBy("label", "size").agg(F.ceil(F.count("*") / shard).alias("shards"))
    dealt = classes.hint("merge").join(counts.hint("merge"), ["label", "size"])
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")))

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids, mult = t.column("id").to_numpy(), t.column("mult").to_numpy()
        x = unit(np.array(t.column("vector").to_pylist(), np.float64))
        g = Graph(x)
        layers = [np.int64(len(g.layers)).tobytes()]
        for nodes, links in zip(g.layers, g.links):
            layers += [np.int64(len(nodes)).tobytes(), nodes.astype(np.int64).tobytes(), links[nodes].tobytes()]
        values = [t.column(c)[0].as_py() for c in ("label", "size", "shard", "shards")] + [ids.tobytes(), mult.tobytes(), x.tobytes(), b"".join(layers), g.audited(threshold)]
        return pa.table([[v] for v in values], schema)

    schema = pa.schema([("label", pa.string()), ("size", pa.int32()), ("shard", pa.int64()), ("shards", pa.int64()), ("ids", pa.binary()), ("mult", pa.binary()), ("x", pa.binary()), ("layers", pa.binary()), ("width", pa.int32())])
    ddl = "label string, size int, shard long, shards long, ids binary, mult binary, x binary, layers binary, width int"
    graphs = stored(dealt.select("label", "size", "shard", "shards", "id", "mult", "vector").groupBy("label", "size", "shard").applyInArrow(build, ddl), "graphs")
    lane = F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))).alias("lane")
    first = graphs.select("label", "size", "shard", lane, F.lit(-1).cast("long").alias("block"), "ids", "mult", "x", "layers", "width")
    empty = F.lit(None).cast("binary")
    blocks = graphs.select("label", "size", F.col("shard").alias("block"), "shards", "ids", empty.alias("mult"), "x", empty.alias("layers"), F.lit(None).cast("int").alias("width"))
    # a block goes to each shard's number, also to the few numbers that no vector has drawn, whose lanes have no graph
    blocks = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).drop("shards")
    blocks = blocks.withColumn("lane", F.pmod("block", F.lit(LANES)).cast("int"))
    place = ["label", "size", "shard", "lane"]
    both = first.unionByName(blocks).repartition(n, *place).sortWithinPartitions(*place, "block")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = here = None
        for b in batches:
            for r in range(b.num_rows):
                at = tuple(b.column(c)[r].as_py() for c in place)
                size, block, ids_, mult_, x_, layers, width_ = (b.column(c)[r].as_py() for c in ("size", "block", "ids", "mult", "x", "layers", "width"))
                if block < 0:
                    width, ids, mult, x = width_, np.frombuffer(ids_, np.int64), np.frombuffer(mult_, np.int64), np.frombuffer(x_).reshape(-1, size)
                    graph, here = opened(x, layers), at
                    continue
                if here != at:
                    continue
                found = compared(graph, width, ids, mult, x, np.frombuffer(ids_, np.int64), np.frombuffer(x_).reshape(-1, size), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["node", "links", "root"])

    return stored(both.mapInArrow(search, "node long, links long, root long"), "found")


def opened(x: np.ndarray, layers: bytes) -> Graph:
    """A graph from its vectors and the bytes of its layers."""
    g = Graph.__new__(Graph)
    g.x, g.layers, g.links, at = x.astype(np.float32), [], [], 8
    for _ in range(int(np.frombuffer(layers, np.int64, 1)[0])):
        m = int(np.frombuffer(layers, np.int64, 1, at)[0])
        nodes = np.frombuffer(layers, np.int64, m, at + 8)
        links = np.full((len(x), OWN + ADDED), -1, np.int32)
        links[nodes] = np.frombuffer(layers, np.int32, m * (OWN + ADDED), at + 8 + 8 * m).reshape(m, -1)
        at += 8 + 8 * m + 4 * m * (OWN + ADDED)
        g.layers.append(nodes)
        g.links.append(links)
    return g


def label_key(rows: DataFrame, label_col: str) -> Column:
    """A text for each label, other texts for other labels: 1.2 and 1.7 are two, 0.0 and -0.0 are one."""
    kind = rows.select(F.col(label_col)).dtypes[0][1]
    label = F.col(label_col)
    if kind in ("double", "float"):
        return (label + F.lit(0).cast(kind)).cast("string")
    return F.to_json(F.struct(label)) if kind.startswith(("struct", "array", "map")) else F.hex(label) if kind == "binary" else label.cast("string")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row: component_id is the smallest id reachable by links."""
    v = F.col("vector")
    fine = F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = rows.select(F.col(id_col).alias("id"), label_key(rows, label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.coalesce(fine & F.col("id").isNotNull() & F.col("label").isNotNull(), F.lit(False))
    some = stored(some.withColumn("vector", F.when(fine, F.transform(v, lambda x: x + 0.0))), "vectors")  # + 0.0: no negative zeros
    good = some.where("vector is not null")
    classes = good.groupBy("label", "vector").agg(F.min("id").alias("own"), F.count("*").alias("mult"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbers are fixed once written
    found = linked(classes.select(F.col("node").alias("id"), "label", F.size("vector").alias("size"), "vector", "mult"), threshold, shard)
    reach = components(found.select("node", "root"), "node", "root").withColumnRenamed("root", "least")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.hint("merge").join(links.hint("merge"), "node", "left").hint("merge").join(reach.hint("merge"), "node", "left")
    known = stored(known.select("label", "vector", "own", "mult", "links", F.coalesce("least", "node").alias("root"), "node"), "known")
    least = known.groupBy("root").agg(F.min("own").alias("component_id"))
    known = known.withColumn("n_links", F.col("mult") - 1 + F.coalesce("links", F.lit(0)))
    known = salted_join(known, least, "root", "node", known.count())
    out = good.hint("merge").join(known.select("label", "vector", "n_links", "component_id").hint("merge"), ["label", "vector"])
    out = out.select("id", "n_links", "component_id")
    out = out.union(some.where("vector is null").select("id", F.lit(0).cast("long"), "id"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
