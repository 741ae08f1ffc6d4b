"""Batch top-k retrieval over an embedding table, and rank fusion."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import written

#: Frames that a task holds, and query vectors that it multiplies with them at once.
CHUNK = 50_000
QUERIES = 256
#: Cells at most, and frames that their centres are fitted on.
CELLS, SAMPLE = 512, 5_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / norm)


def truncated(v: Column, d: int) -> Column:
    """The first d dimensions, normalised again; the input must be the raw vector, not a normalised one [from documentation]."""
    return normalized(F.slice(v, 1, d))


def curves(frames: DataFrame, vector: str, texts: dict[str, Sequence[float]]) -> DataFrame:
    """A cosine column for each named text vector; both sides normalised [from documentation]."""
    own = lambda v: F.array(*[F.lit(float(x)) for x in v])
    return frames.withColumns({name: dot(normalized(F.col(vector)), normalized(own(v))) for name, v in texts.items()})


def matrix(vectors: pa.Array) -> np.ndarray:
    return np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(vectors), -1)


@dataclass(frozen=True)
class Cells:
    """Centres, members and radii of cells, a row a cell: at most CELLS."""

    centres: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The most that a member's product with each query can be: the centre's, and the query's length times the cell's radius."""
        length = np.linalg.norm(q, axis=1, keepdims=True)
        return q @ self.centres.T + length * self.radii * (1 + 1e-9) + 1e-9 * length

    def first(self, bounds: np.ndarray, k: int) -> list[np.ndarray]:
        """Of each query the cells with the highest bounds, until they have k members."""
        order = np.argsort(-bounds, axis=1, kind="stable")
        enough = (np.cumsum(self.sizes[order], axis=1) < k).sum(1) + 1
        return [o[:e] for o, e in zip(order, enough)]


def fitted(frames: DataFrame, cells: int) -> np.ndarray:
    """Centres by a few rounds of k-means over at most SAMPLE frames; how well they fit decides speed, never results."""
    n = frames.count()
    some = frames.select("vector").sample(min(1.0, 1.2 * SAMPLE / max(n, 1)), seed=1).limit(SAMPLE).collect()
    some = some or frames.select("vector").limit(SAMPLE).collect()
    if not some:
        return np.zeros((0, 0))
    x = np.array([r.vector for r in some], np.float64).reshape(len(some), -1)
    cells = min(cells or int(np.clip(np.sqrt(n), 1, CELLS)), CELLS, len(x))
    c = x[np.random.default_rng(0).permutation(len(x))[:cells]]
    for _ in range(6):
        near = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


def celled(frames: DataFrame, cells: int = 0) -> tuple[DataFrame, Cells]:
    """``id, video, vector, cell`` of each frame, stored, and its cells."""
    own = frames.select(F.col("frame_id").cast("long").alias("id"), F.col("video").cast("long").alias("video"), F.col("vector").cast("array<double>").alias("vector"))
    c = fitted(own, cells)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("vector"))
            near = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
            far = np.linalg.norm(x - c[near], axis=1)
            yield b.append_column("cell", pa.array(near.astype(np.int32))).append_column("far", pa.array(far))

    held = written(own.mapInArrow(each, "id long, video long, vector array<double>, cell int, far double"), "cells")
    found = held.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
    sizes, radii = np.zeros(len(c), int), np.zeros(len(c))
    for r in found:
        sizes[r.cell], radii[r.cell] = r.n, r.far
    some = np.flatnonzero(sizes)
    number = np.cumsum(sizes > 0) - 1  # cells without members go
    held = held.withColumn("cell", F.array(*[F.lit(int(v)) for v in number], F.lit(0))[F.col("cell")]).drop("far")
    return held, Cells(c[some], sizes[some], radii[some])


def asked(queries: DataFrame, cells: Cells, k: int, floors: DataFrame | None = None) -> DataFrame:
    """``id, vector, cell``: the cells that a query looks at first; with ``floors`` (query_id, floor), those that can still have more."""
    own = queries.select(F.col("query_id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    again = floors is not None
    if again:
        own = own.hint("merge").join(floors.withColumnRenamed("query_id", "id").hint("merge"), "id", "left")

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                b = big.slice(at, 1000)
                if not len(cells.sizes):
                    continue  # no frames
                bounds = cells.bounds(matrix(b.column("vector")))
                some = cells.first(bounds, k)
                if again:
                    floor = np.array([-np.inf if v is None else v for v in b.column("floor").to_pylist()])
                    rest = bounds >= floor[:, None]
                    for row, done in zip(rest, some):
                        row[done] = False
                    some = [np.flatnonzero(row) for row in rest]
                found = pa.array([x.astype(np.int32) for x in some], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vector"), found], ["id", "vector", "cells"])

    rows = own.mapInArrow(each, "id long, vector array<double>, cells array<int>")
    return rows.select("id", "vector", F.explode("cells").alias("cell"))


def searched(held: DataFrame, asks: DataFrame, cells: Cells, k: int, chunk: int) -> DataFrame:
    """The k best frames in each chunk of a cell for each query that asks it. A task holds one chunk; queries stream past."""
    most = max(1, -(-int(cells.sizes.max(initial=1)) // chunk))
    parts = F.array(*[F.lit(max(1, -(-int(v) // chunk))) for v in cells.sizes], F.lit(1))[F.col("cell")]
    number = lambda part: (F.col("cell").cast("long") * most + part).alias("chunk")
    own = held.select(number(F.pmod(F.xxhash64("id"), parts)), F.lit(0).alias("asks"), "id", "video", "vector")
    rows = asks.select("id", "vector", "cell", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    rows = rows.select(number(F.col("part")), F.lit(1).alias("asks"), "id", F.lit(None).cast("long").alias("video"), "vector")
    n = max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(cells.sizes.sum()) // chunk))
    both = own.union(rows).repartition(n, "chunk").sortWithinPartitions("chunk", "asks")

    def best(q: np.ndarray, ids: np.ndarray, x: np.ndarray, fid: np.ndarray, vid: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(q), QUERIES):
            sims = q[s : s + QUERIES] @ x.T
            # ties at the edge are decided by frame, so all that equal the k-th are looked at
            edge = np.partition(sims, -k, axis=1)[:, -k] if k < len(x) else np.full(len(sims), -np.inf)
            i, j = np.nonzero(sims >= edge[:, None])
            by = np.lexsort((fid[j], -sims[i, j], i))
            i, j = i[by], j[by]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, j = i[keep], j[keep]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[s + i], fid[j], vid.take(pa.array(j)), sims[i, j])], ["query_id", "frame_id", "video", "score"])

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, frames, x = None, [], None
        for b in batches:
            chunks, asks_ = b.column("chunk").to_numpy(), b.column("asks").to_numpy()
            cuts = np.flatnonzero(np.r_[True, (chunks[1:] != chunks[:-1]) | (asks_[1:] != asks_[:-1])]) if len(chunks) else []
            for start, end in zip(cuts, np.r_[cuts[1:], len(chunks)].astype(int) if len(chunks) else []):
                part = b.slice(int(start), int(end - start))
                if chunks[start] != now:
                    now, frames, x = chunks[start], [], None
                if not asks_[start]:
                    frames.append(part)
                    continue
                if x is None and frames:
                    some = pa.Table.from_batches(frames).combine_chunks()
                    x, fid, vid = matrix(some.column("vector").combine_chunks()), some.column("id").to_numpy(), some.column("video").combine_chunks()
                    frames = []
                if x is not None:
                    yield from best(matrix(part.column("vector")), part.column("id").to_numpy(), x, fid, vid)

    return both.mapInArrow(each, "query_id long, frame_id long, video long, score double")


def top_k(queries: DataFrame, frames: DataFrame, k: int, chunk: int = CHUNK, cells: int = 0) -> DataFrame:
    """``query_id, frame_id, video, score, rank``: the best k frames of each query by dot product, ties by frame.

    ``queries(query_id, vector)``, ``frames(frame_id, video, vector)``. Frames lie in cells around centres. A query looks first at the
    cells with the highest bounds that hold k frames together; its k-th score there is its floor, and then it looks at the cells
    whose bound reaches the floor, and at no others. So results are exact, and a query is copied to few cells, not to all frames.
    Cells of more than ``chunk`` frames are cut. Vectors have one length and no nulls; both sides stay tables.
    """
    if not 1 <= k <= 10_000:
        raise ValueError("k must be in 1..10000")
    held, own = celled(frames, cells)
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "frame_id")
    best = lambda rows: rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    first = written(best(searched(held, asked(queries, own, k), own, k, chunk)), "first")
    floors = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    more = searched(held, asked(queries, own, k, floors), own, k, chunk)
    return best(first.drop("rank").union(more))


def fused(hits: DataFrame, k: float = 60.0, per_variant: int = 50, most: int = 100) -> DataFrame:
    """Reciprocal-rank fusion of ``(session_id, event_id, variant, video_id, frame_id, timestamp_seconds, raw)`` [from documentation].

    A variant counts a frame once, at its best row, and gives its first ``per_variant`` frames; ranks add up as 1/(k+rank); an
    event keeps ``most`` frames over all its videos. The time is that of the row with the highest raw score.
    """
    key = ["session_id", "event_id"]
    once = W.partitionBy(*key, "variant", "video_id", "frame_id").orderBy(F.desc("raw"), "timestamp_seconds")
    best = hits.withColumn("rn", F.row_number().over(once)).where("rn = 1")
    by = W.partitionBy(*key, "variant").orderBy(F.desc("raw"), "video_id", "frame_id")
    ranked = best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= per_variant)
    out = ranked.groupBy(*key, "video_id", "frame_id").agg(
        F.sum(1 / (k + F.col("rank"))).alias("score"), F.max_by("timestamp_seconds", F.struct("raw", "variant")).alias("timestamp_seconds"),
        F.array_sort(F.collect_set("variant")).alias("variants"),
    )
    final = W.partitionBy(*key).orderBy(F.round("score", 9).desc(), "video_id", "frame_id")
    return out.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= most)


def nearest(probes: DataFrame, keyframes: DataFrame, ranges: int | None = None) -> DataFrame:
    """``probes`` with the ``file`` and ``distance`` of the keyframe nearest in time; the first listed wins ties.

    ``probes(probe_id, video, t)``, ``keyframes(video, t, file, seq)``. Both are put on one line, cut into ranges of (video, t), as many as
    Spark's shuffle has or ``ranges``. The last keyframe before a probe and the first one after it are the only candidates; where a range has
    none, they come from the ranges of the video before and after, which a row a range and video hands on. So a video of
    any length is many tasks' work. A null video or time, or a video without keyframes, has a null file.
    """
    k = keyframes.where("video is not null and t is not null and file is not null").groupBy("video", "t").agg(F.min(F.struct("seq", "file")).alias("k"))
    line = k.select("video", "t", F.struct("t", "k.seq", "k.file").alias("k"), F.lit(None).cast(probes.schema["probe_id"].dataType).alias("probe_id"))
    line = line.unionByName(probes.select("video", "t", F.lit(None).cast(line.schema["k"].dataType).alias("k"), "probe_id"))
    # probes at one time are told apart by their ids, after the keyframe of that time
    keys = ["video", "t", F.col("k").isNull(), F.xxhash64("probe_id")]
    line = written(line.repartitionByRange(*([ranges] if ranges else []), *keys).withColumn("__range", F.spark_partition_id()), "line")
    ends = line.where("video is not null").groupBy("video", "__range").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    along = W.partitionBy("video").orderBy("__range")
    earlier = F.last("last", True).over(along.rowsBetween(W.unboundedPreceding, -1))
    later = F.first("first", True).over(along.rowsBetween(1, W.unboundedFollowing))
    handed = ends.select("video", "__range", earlier.alias("earlier"), later.alias("later"))
    here = W.partitionBy("video", "__range")
    before = here.orderBy("t").rangeBetween(W.unboundedPreceding, W.currentRow)
    after = here.orderBy(F.desc("t")).rangeBetween(W.unboundedPreceding, W.currentRow)
    line = line.withColumn("a", F.last("k", True).over(before)).withColumn("b", F.last("k", True).over(after)).where("k is null")
    line = line.hint("merge").join(handed.hint("merge"), ["video", "__range"], "left")
    line = line.withColumns({"a": F.coalesce("a", "earlier"), "b": F.coalesce("b", "later")})
    gap = lambda c: F.abs(F.col(f"{c}.t") - F.col("t"))
    first = F.col("b").isNull() | (gap("a") < gap("b")) | ((gap("a") == gap("b")) & (F.col("a.seq") <= F.col("b.seq")))
    one = F.when(F.col("t").isNotNull(), F.when(F.col("a").isNotNull() & first, F.col("a")).otherwise(F.col("b")))
    return line.select("probe_id", "video", "t", one.alias("k")).select("probe_id", "video", "t", "k.file", F.abs(F.col("k.t") - F.col("t")).alias("distance"))
