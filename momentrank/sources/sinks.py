"""Sinks: result logs, tables with hits at k, rendered query files, snapshots of replaced groups."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import display_time
from ..tables import SMALL, small

#: Wording of the two renderings. Fixed values.
INTRO = {"first": "Xác định khoảnh khắc ĐẦU TIÊN của mỗi sự kiện sau:", "last": "Xác định khoảnh khắc CUỐI CÙNG của mỗi sự kiện sau:"}
WRAP = {"first": "khoảnh khắc đầu tiên %s", "last": "khoảnh khắc cuối cùng %s"}


def with_hits(rows: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Adds ``hit_at_k`` columns of 0 and 1."""
    return rows.withColumns({f"hit_at_{k}": F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int") for k in ks})


def flat(rows: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, which CSV can hold."""
    nested = ("array<", "struct<", "map<")
    return rows.select(*[F.to_json(f"`{c}`").alias(c) if t.startswith(nested) else F.col(f"`{c}`") for c, t in rows.dtypes])


def with_reciprocal(rows: DataFrame) -> DataFrame:
    """Adds ``reciprocal_rank``, 0 for what wasn't found."""
    return rows.withColumn("reciprocal_rank", F.coalesce(1 / F.col("rank"), F.lit(0.0)))


def write_results(rows: DataFrame, path: str, ks: Sequence[int], metrics: DataFrame | None = None) -> None:
    """The log as JSON lines, the table as CSV, and metrics as JSON; Spark's committer shows a whole directory or none."""
    rows.write.mode("overwrite").json(f"{path}/results")
    flat(with_hits(with_reciprocal(rows), ks)).write.mode("overwrite").option("header", True).csv(f"{path}/per_query")
    if metrics is not None:
        metrics.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/metrics")


def rendered(groups: DataFrame) -> DataFrame:
    """``video, moment, value``: each file of ``query_groups`` worded twice, with the same answers."""
    rows = groups.select("*", F.explode(F.array(F.lit("first"), F.lit("last"))).alias("moment"))
    first = F.col("moment") == "first"
    wrap = F.when(first, F.format_string(WRAP["first"], "text")).otherwise(F.format_string(WRAP["last"], "text"))
    ask = F.concat(F.col("event"), F.lit(": "), wrap)
    tell = F.concat(F.col("event"), F.lit(": "), display_time(F.col("start_seconds")), F.lit(" - "), display_time(F.col("end_seconds")))
    both = rows.groupBy("video", "context", "moment").agg(F.array_sort(F.collect_list(F.struct("pos", ask.alias("ask"), tell.alias("tell")))).alias("x"))
    join = lambda f: F.array_join(F.transform("x", f), "\n")
    intro = F.when(F.col("moment") == "first", INTRO["first"]).otherwise(INTRO["last"])
    video = F.concat(F.lit('video_path: "'), "video", F.lit('.mp4"'))
    text = F.concat_ws("\n", "context", intro, join(lambda e: e.ask), F.lit("**Answer"), video, join(lambda e: e.tell))
    return both.select("video", "moment", F.concat(text, F.lit("\n")).alias("value"))


def write_rendered(groups: DataFrame, path: str) -> None:
    rendered(groups).select("moment", "value").write.mode("overwrite").partitionBy("moment").text(path)


def export(rows: DataFrame, path: str, kind: str) -> None:
    """CSV with a header, where nested columns are JSON text; or JSON lines."""
    if kind == "csv":
        flat(rows).write.mode("overwrite").option("header", True).csv(path)
    else:
        rows.write.mode("overwrite").json(path)


# Snapshots. ``data/batch=...`` holds what batches wrote, a folder a group of equal keys; ``live/v=...`` lists the groups that are live. A
# version counts once Spark's committer has marked it, so a reader has the old list or the new one, never half a batch.

BATCH, SLOT = "snapshot_batch", "snapshot_slot"


def _folders(spark: SparkSession, path: str, done: bool = False) -> list[str]:
    """Names of the folders in ``path``; with ``done`` those that a committer has marked."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    folder = hadoop(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder) if f.isDirectory()]
    return [n for n in names if not done or fs.exists(hadoop(f"{path}/{n}/_SUCCESS"))]


def _versions(spark: SparkSession, path: str) -> dict[int, str]:
    """Committed versions and the batches that made them."""
    found = (re.fullmatch(r"v=(\d+)-(.+)", n) for n in _folders(spark, f"{path}/live", done=True))
    return {int(m[1]): m[2] for m in found if m}


def _listed(spark: SparkSession, path: str) -> DataFrame | None:
    versions = _versions(spark, path)
    return spark.read.parquet(f"{path}/live/v={max(versions):020d}-{versions[max(versions)]}") if versions else None


def replace_groups(rows: DataFrame, replaced: DataFrame, path: str, keys: Sequence[str] = ("session_id", "event_id"), batch: str | None = None) -> None:
    """Puts ``rows`` in the place of all rows whose keys ``replaced`` lists; a listed group without rows is empty from then on.

    Rows of groups that are not listed are an error before anything is written. The list of live groups is switched last, so a
    failed call changes nothing that is seen. A ``batch`` that is committed already is not written again, and what a failed call
    left is overwritten. There must be one writer at a time. The list has a row a group, and so does ``replaced``.
    """
    spark, names = rows.sparkSession, list(keys)
    versions = _versions(spark, path)
    batch = re.sub(r"[^\w.]", "_", batch) if batch else uuid.uuid4().hex
    if batch in versions.values():
        return
    slot = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
    wanted = replaced.select(*names).distinct().select(*names, slot.alias(SLOT))
    marked = rows.withColumn(SLOT, slot)
    if marked.select(SLOT).distinct().hint("merge").join(wanted.select(SLOT).hint("merge"), SLOT, "left_anti").take(1):
        raise ValueError("rows have groups that are not replaced")
    data = f"{path}/data/{BATCH}={batch}"
    marked.repartition(SLOT).write.mode("overwrite").partitionBy(SLOT).parquet(data)
    there = marked.select(*names, SLOT).distinct().withColumn(BATCH, F.lit(batch))
    old = _listed(spark, path)
    if old is not None:
        there = there.unionByName(old.hint("merge").join(wanted.select(SLOT).hint("merge"), SLOT, "left_anti").select(there.columns))
    there.write.mode("overwrite").parquet(f"{path}/live/v={max(versions, default=0) + 1:020d}-{batch}")


def live(spark: SparkSession, path: str, most: int = SMALL) -> DataFrame:
    """The rows of the latest snapshot. Up to ``most`` live groups prune the folders that are read; more are joined."""
    groups = _listed(spark, path)
    if groups is None:
        raise ValueError(f"{path} has no snapshot yet")
    written_ = [n for n in _folders(spark, f"{path}/data", done=True)]
    groups = groups.select(BATCH, SLOT)
    rows = spark.read.option("mergeSchema", "true").option("basePath", f"{path}/data").parquet(*[f"{path}/data/{n}" for n in written_])
    kinds = {BATCH: F.col(BATCH).cast("string"), SLOT: F.col(SLOT).cast("string")}
    return rows.withColumns(kinds).join(small(groups, most), [BATCH, SLOT], "left_semi").drop(BATCH, SLOT)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Removes batches without a live group, and all lists but the latest; returns the batches' names. Not while others read older snapshots."""
    versions = _versions(spark, path)
    if not versions:
        return []
    used = {r[0] for r in _listed(spark, path).select(BATCH).distinct().collect()}
    gone = [n for n in _folders(spark, f"{path}/data") if n.removeprefix(f"{BATCH}=") not in used]
    old = [f"{path}/live/{n}" for n in _folders(spark, f"{path}/live") if n != f"v={max(versions):020d}-{versions[max(versions)]}"]
    for name in [*[f"{path}/data/{n}" for n in gone], *old]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(name)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return gone
