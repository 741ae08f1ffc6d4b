"""Document fingerprints as threshold-scaled sketches of word shingles.

A sketch keeps every hash of a 5-word shingle below 1/SCALE of the hash range, and nothing else, so sketches of any two
documents are cut by the same threshold: the union of two is the sketch of the two shingle sets together, and shared
hashes estimate resemblance and, between very unequal documents, containment. Beside the hashes a fingerprint has a
digest of the whole shingle set: the sum of all its distinct hashes. Texts with equal digests have the same shingles, so
their likeness is 1; it is also what tells short texts apart that retain no hash.

A fingerprint is the digest, 16 hex digits, and the hashes, sorted, 12 hex digits each (the upper 48 bits).

Each text is compared with its edited form and with the next document in descending order of ids. For that, rows are cut
into ranges at quantiles of a bounded sample of (id, hash of the text), so that a repeated id spreads over ranges; rows
are dealt to ranges once, and the first row of the next range is a guest at the end of each. A task streams over its
sorted rows with two documents in hand, and no text is moved twice.

Defined results: a null or empty text has no shingles, and the digest 0; a text of fewer than five words has one shingle,
all of it. Equal shingle sets have likeness and containment 1; else a text without retained hashes has likeness 0, and
nothing of it is known to be contained. Rows that repeat an id follow each other by a hash of their text; null ids come
last. A single document is its own next. Only the id and text columns are read, so extra columns can't clash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, words

SHINGLE = 5
SCALE = 8
LOWEST = -(1 << 63)
#: Rows sampled for each range; bounds what the driver reads.
SAMPLE = 40


@dataclass(frozen=True)
class Sketch:
    """The retained hashes, sorted and distinct, as their upper 48 bits; and the digest of all shingles."""

    hashes: np.ndarray
    digest: int


def shingle_hashes(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of the text's shingles."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    digest, data = xxhash.xxh64_intdigest, b" ".join(w)
    if len(w) < SHINGLE:
        return np.array([digest(data)], np.uint64)
    size = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(w) - SHINGLE + 1].tolist()
    return np.unique(np.array([digest(data[a:b]) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())], np.uint64))


def sketch(text: str | None, scale: int = SCALE) -> Sketch:
    every = shingle_hashes(text)
    upper = (every >> np.uint64(16)).astype(np.int64)  # sorted, as the hashes are
    return Sketch(np.unique(upper[upper < (1 << 48) // scale]), int(every.sum(dtype=np.uint64)))


def fingerprint(s: Sketch) -> str:
    return f"{s.digest:016x}" + s.hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def parsed(text: str) -> Sketch:
    return Sketch(np.array([int(text[i : i + 12], 16) for i in range(16, len(text), 12)], np.int64), int(text[:16], 16))


def shared(a: Sketch, b: Sketch) -> int:
    return len(np.intersect1d(a.hashes, b.hashes, assume_unique=True))


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated resemblance: shared hashes over all hashes."""
    if a.digest == b.digest:
        return 1.0
    both = shared(a, b)
    return both / max(len(a.hashes) + len(b.hashes) - both, 1)


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of the first text's shingles that the second has."""
    if a.digest == b.digest:
        return 1.0
    return shared(a, b) / max(len(a.hashes), 1)


def merged(a: Sketch, b: Sketch) -> np.ndarray:
    """Retained hashes of the two texts' shingles together; the digest of a union isn't known from two digests."""
    return np.union1d(a.hashes, b.hashes)


def sketched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_within``.

    Ids are integers; a column of another type is refused before anything runs.
    """
    n = partitions(docs.sparkSession)
    kind = docs.select(F.col(id_col)).dtypes[0][1]
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"sketched orders rows by integer ids; {id_col} is {kind}")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("key"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"), F.col(text_col).alias("text"),
    )
    # order of rows by their hash: a sample of (key, hash) of about SAMPLE * n rows, the same each time
    pick = F.pmod(F.xxhash64("key", "hash"), F.greatest(F.floor(F.lit(rows.count()) / (SAMPLE * n)), F.lit(1))) == 0
    sample = sorted(set(map(tuple, rows.where(pick).select("key", "hash").limit(8 * SAMPLE * n).collect())))
    cuts = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []

    @F.pandas_udf("int")
    def range_of(key: pd.Series, hash_: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, x) for x in zip(key.tolist(), hash_.tolist())], dtype="int32")

    # the first row of each range, in descending order: a row a range
    dealt = rows.withColumn("range", range_of("key", "hash"))
    first = dealt.groupBy("range").agg(F.max(F.struct("key", "hash")).alias("first")).orderBy(F.desc("range")).collect()
    after = {tuple(r.first): first[i - 1].range for i, r in enumerate(first)}  # i - 1: the first range's row ends the last

    @F.pandas_udf("array<int>")
    def seats(own: pd.Series, key: pd.Series, hash_: pd.Series) -> pd.Series:
        guests = (after.get(x) for x in zip(key.tolist(), hash_.tolist()))
        return pd.Series([[r] if g is None else [r, g] for r, g in zip(own.tolist(), guests)])

    dealt = dealt.select("doc_id", "key", "hash", "text", F.posexplode(seats("range", "key", "hash")).alias("guest", "range"))
    dealt = dealt.repartition(n, "range").sortWithinPartitions("range", "guest", F.desc("key"), F.desc("hash"))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = None

        def compared(own: tuple, other: tuple) -> tuple:
            (_, _, doc, text, a), (_, _, _, next_text, b) = own, other
            half = len(text) // 2
            edited = text[: len(text) - half] + next_text[:half]
            c = sketch(edited, scale)
            sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            return doc, len(text), sha, fingerprint(a), fingerprint(c), likeness(a, c), likeness(a, b), containment(c, a)

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
            columns = [pa.array(x, k) for x, k in zip(zip(*out), kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_within"]
        for b in batches:
            for i in range(b.num_rows):
                at, guest = b.column("range")[i].as_py(), b.column("guest")[i].as_py()
                if guest and (held is None or held[1] or held[0] != at):
                    continue  # a repeated row of the guest, or a range without rows
                text = b.column("text")[i].as_py() or ""
                row = (at, guest, b.column("doc_id")[i].as_py(), text, sketch(text, scale))
                if held and not held[1] and held[0] == at:
                    out.append(compared(held, row))
                held = row
                if len(out) >= 500:
                    yield batch()
        if out:
            yield batch()

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_within double"
    return dealt.select("range", "guest", "doc_id", "text").mapInArrow(each, schema)


def op7_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketched(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
