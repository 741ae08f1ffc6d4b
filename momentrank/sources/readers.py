"""Readers: nested responses, query files, manifests, annotations, keyframes and detections, to flat tables.

Each has a column form over a DataFrame of texts or structs, which the file form calls, so the same parsing runs over files
and over tables. Rows that break a rule go to a report instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import candidate_id, timestamp_seconds, video_id

RESPONSE = (
    "session_id string, event_id string, query array<string>, results array<struct<video_name:string,frame_index:bigint,"
    "timestamp:string,timestamp_seconds:double,score:double,watch_url:string>>"
)
#: Line patterns of query files. Fixed values.
EVENT_LINE = r"(?i)^\s*(E\d+)\s*:\s*(.*?)\s*$"
ANSWER_LINE = r"(?i)^\s*\*\*\s*Answer\s*$"
PATH_LINE = r"(?i)^\s*video_path\s*:\s*[\"']?(.*?)[\"']?\s*$"
RANGE_LINE = r"(?i)^\s*(E\d+)\s*:\s*(\d+(?::\d+){1,2}(?:\.\d+)?)\s*-\s*(\d+(?::\d+){1,2}(?:\.\d+)?)\s*$"


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESPONSE).json(path)


def hits_of(responses: DataFrame, most: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Candidates, one row a hit with its 1-based rank, and a quarantine of broken hits with the first rule each breaks.

    Explicit seconds go before the display time. An array holds one response's hits, at most ``most``.
    """
    rows = responses.select("session_id", "event_id", "query", F.posexplode("results").alias("pos", "r"))
    video, t = video_id(F.col("r.video_name")), F.coalesce("r.timestamp_seconds", timestamp_seconds(F.col("r.timestamp")))
    score, rank = F.col("r.score"), F.col("pos") + 1
    why = (
        F.when(F.size("query") != 1, "echoed_query").when(rank > most, "too_many_hits").when(video.isNull(), "no_video")
        .when(F.coalesce(F.col("r.frame_index"), F.lit(-1)) < 0, "bad_frame").when(score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")), "bad_score")
        .when(t.isNull() | (t < 0), "bad_time")
    )
    out = rows.select(
        candidate_id(F.col("session_id"), F.col("event_id"), video, F.col("r.frame_index"), rank).alias("id"), "session_id", "event_id",
        video.alias("video_id"), F.col("r.frame_index").alias("frame_id"), t.alias("timestamp_seconds"), score.alias("raw_relevance_score"),
        F.col("r.watch_url").alias("watch_url"), rank.cast("long").alias("rank"), why.alias("why"),
    )
    return out.where("why is null").drop("why"), out.where("why is not null").select("session_id", "event_id", "rank", "why")


def read_query_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, value`` of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def lines_of(texts: DataFrame) -> DataFrame:
    """``path, n, line, answer``: answer is true after the file's first answer mark; the mark itself is left out."""
    rows = texts.select("path", F.posexplode(F.split(F.regexp_replace("value", "^﻿", ""), r"\r\n|\r|\n")).alias("n", "line"))
    mark = F.min(F.when(F.col("line").rlike(ANSWER_LINE), F.col("n"))).over(W.partitionBy("path"))
    rows = rows.withColumn("mark", mark).where("mark is null or n <> mark")
    return rows.select("path", "n", "line", F.coalesce(F.col("n") > F.col("mark"), F.lit(False)).alias("answer"))


def query_groups(texts: DataFrame) -> DataFrame:
    """``path, video, context, pos, event, text, start_seconds, end_seconds``: a row for each event line of ``path, value``.

    Later answer lines of an event replace earlier ones, and so does a later path line.
    """
    line = F.col("line")
    rows = lines_of(texts)
    head, tail = rows.where("NOT answer"), rows.where("answer")
    event = F.upper(F.regexp_extract(line, EVENT_LINE, 1))
    events = head.where(line.rlike(EVENT_LINE)).select("path", "n", event.alias("event"), F.regexp_extract(line, EVENT_LINE, 2).alias("text"))
    events = events.withColumn("pos", (F.row_number().over(W.partitionBy("path").orderBy("n")) - 1).cast("long")).drop("n")
    other = head.where(~line.rlike(EVENT_LINE) & (F.trim(line) != "")).select("path", F.struct("n", F.trim(line).alias("t")).alias("x"))
    context = other.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.t), " ").alias("context"))
    video = tail.where(line.rlike(PATH_LINE)).groupBy("path").agg(F.max_by(F.regexp_extract(line, PATH_LINE, 1), "n").alias("video"))
    part = lambda i: timestamp_seconds(F.regexp_extract(line, RANGE_LINE, i), True)
    answers = tail.where(line.rlike(RANGE_LINE)).select("path", F.upper(F.regexp_extract(line, RANGE_LINE, 1)).alias("event"), F.struct("n", part(2).alias("a"), part(3).alias("z")).alias("x"))
    answers = answers.groupBy("path", "event").agg(F.max("x").alias("x")).select("path", "event", F.col("x.a").alias("start_seconds"), F.col("x.z").alias("end_seconds"))
    out = events.hint("merge").join(video.hint("merge"), "path", "left").join(context.hint("merge"), "path", "left")
    out = out.join(answers.hint("merge"), ["path", "event"], "left")
    return out.select("path", video_id(F.col("video"), "benchmark").alias("video"), "context", "pos", "event", "text", "start_seconds", "end_seconds")


def query_file_violations(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """``rule, path`` of files without events, video or an answer, with a repeated event, a backward range or another file's video."""
    row = lambda rule, df: df.select(F.lit(rule).alias("rule"), "path").distinct()
    videos = groups.select("path", "video").distinct()
    out = row("no_events", texts.hint("merge").join(groups.hint("merge"), "path", "left_anti"))
    out = out.union(row("no_video", groups.where("video is null"))).union(row("no_answer", groups.where("start_seconds is null or end_seconds is null")))
    out = out.union(row("duplicate_event", groups.groupBy("path", "event").count().where("count > 1")))
    out = out.union(row("backward_range", groups.where("end_seconds < start_seconds")))
    twice = videos.where("video is not null").groupBy("video").agg(F.count("*").alias("n")).where("n > 1")
    return out.union(row("duplicate_video", videos.hint("merge").join(twice.hint("merge"), "video", "left_semi")))


def queries_of(groups: DataFrame, mode: str = "event") -> DataFrame:
    """``query_id, query_text, video`` in one of three modes: a row an event, the same with its context first, or a row a file."""
    text = F.col("text")
    if mode == "file":
        parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
        files = groups.groupBy("path", "video", "context").agg(parts.alias("x"))
        return files.select(F.concat("video", F.lit(":all")).alias("query_id"), F.concat_ws(" ", "context", F.array_join(F.transform("x", lambda e: e.text), " ")).alias("query_text"), "video")
    if mode not in ("event", "event_with_context"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "event_with_context":
        text = F.concat_ws(" ", "context", "text")
    return groups.select(F.concat_ws(":", "video", "event").alias("query_id"), text.alias("query_text"), "video", "event", "start_seconds", "end_seconds")


def manifest_of(rows: DataFrame) -> DataFrame:
    """Queries from rows with any of the known aliases of each field."""
    have = set(rows.columns)
    alias = {"query_id": ("query_id", "id"), "query_text": ("query_text", "query", "text"), "video": ("ground_truth_video", "video_id", "video", "video_name"),
             "start_seconds": ("start_seconds", "start"), "end_seconds": ("end_seconds", "end")}
    pick = lambda names, kind: F.coalesce(*[F.col(n).cast(kind) for n in names if n in have], F.lit(None).cast(kind))
    columns = {c: pick(names, "double" if c.endswith("seconds") else "string") for c, names in alias.items()}
    columns["video"] = video_id(columns["video"], "benchmark")
    return rows.select(*[c.alias(n) for n, c in columns.items()])


#: Fields of a JSON manifest, under any of their names.
MANIFEST = (
    "query_id string, id string, query_text string, query string, text string, ground_truth_video string, video_id string, video string, "
    "video_name string, start_seconds double, start double, end_seconds double, end double"
)


def manifest_lines(lines: DataFrame) -> DataFrame:
    """Queries from a column ``value`` of JSON objects, one a row; blank lines are left out."""
    rows = lines.where(F.trim("value") != "").select(F.from_json("value", MANIFEST).alias("q"))
    return manifest_of(rows.select("q.*"))


def manifest_documents(texts: DataFrame) -> DataFrame:
    """Queries from a column ``value`` of whole JSON documents, each a list or ``{queries: [...]}``."""
    item = f"struct<{MANIFEST.replace(' string', ':string').replace(' double', ':double')}>"
    items = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{item}>")).otherwise(F.from_json("value", f"queries array<{item}>").queries)
    return manifest_of(texts.select(F.explode(items).alias("q")).select("q.*"))


def read_manifest(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON lines, one JSON document (a list or ``{queries: [...]}``) or CSV with a header."""
    if kind == "csv":
        return manifest_of(spark.read.option("header", True).csv(path))
    return manifest_lines(spark.read.text(path)) if kind == "jsonl" else manifest_documents(spark.read.text(path, wholetext=True))


def lenient_manifest(texts: DataFrame) -> DataFrame:
    """``path, pos, query_text, video`` from JSON that is a list or ``{queries}``, of strings or objects; truth is optional."""
    items = F.coalesce(F.from_json("value", "array<string>"), F.from_json(F.get_json_object("value", "$.queries"), "array<string>"))
    rows = texts.select("path", F.posexplode(items).alias("pos", "item"))
    field = lambda *names: F.coalesce(*[F.get_json_object("item", f"$.{n}") for n in names])
    plain = F.when(~F.col("item").startswith("{"), F.col("item"))
    return rows.select("path", F.col("pos").cast("long").alias("pos"), F.coalesce(plain, field("query", "query_text", "text")).alias("query_text"),
                       video_id(field("ground_truth_video", "video_id", "video"), "client").alias("video"))


ANNOTATIONS = "database map<string,struct<subset:string,recipe_type:string,annotations:array<struct<id:bigint,sentence:string,segment:array<double>>>>>"


def annotations_of(rows: DataFrame, subsets: Sequence[str] | None = None) -> DataFrame:
    """``query_id, query_text, video, subset, start_seconds, end_seconds`` of a map of videos to annotated segments."""
    videos = rows.select(F.explode("database").alias("video", "v"))
    if subsets:
        videos = videos.where(F.lower("v.subset").isin([s.lower() for s in subsets]))
    seg = videos.select("video", "v.subset", F.posexplode("v.annotations").alias("pos", "a"))
    key = F.coalesce(F.col("a.id").cast("string"), F.col("pos").cast("string"))
    return seg.select(F.concat_ws(":", "video", key).alias("query_id"), F.col("a.sentence").alias("query_text"), "video", "subset",
                      F.try_element_at("a.segment", F.lit(1)).alias("start_seconds"), F.try_element_at("a.segment", F.lit(2)).alias("end_seconds"))


def read_annotations(spark: SparkSession, path: str, subsets: Sequence[str] | None = None) -> DataFrame:
    return annotations_of(spark.read.schema(ANNOTATIONS).option("multiLine", True).json(path), subsets)


def expected_videos(names: DataFrame) -> DataFrame:
    """Distinct video ids of a column ``value``; blank lines and comments are left out."""
    some = names.where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    return some.select(video_id(F.col("value"), "benchmark").alias("video")).where("video is not null").distinct()


def read_expected_videos(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if kind == "txt":
        return expected_videos(spark.read.text(path))
    rows = spark.read.option("header", True).csv(path) if kind == "csv" else spark.read.option("multiLine", kind == "json").json(path)
    have = [c for c in ("video_id", "video", "video_name", "path", "value") if c in rows.columns]
    return expected_videos(rows.select(F.coalesce(*have).alias("value")))


def first_rows(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("x")).select(*key, "x.*")


def read_keyframe_map(spark: SparkSession, path: str) -> DataFrame:
    """``video, frame, n`` of CSV files named after their video; the first row of a frame counts, by its place in the file."""
    rows = spark.read.option("header", True).schema("n int, pts_time double, fps double, frame_idx bigint").csv(path)
    at = F.struct("_metadata.file_block_start", F.monotonically_increasing_id())
    rows = rows.select(video_id(F.regexp_replace("_metadata.file_path", r"\.csv$", "")).alias("video"), F.col("frame_idx").alias("frame"), "n", at.alias("seq"))
    return first_rows(rows, ["video", "frame"], "seq").drop("seq")


def detections_of(texts: DataFrame) -> DataFrame:
    """``video, n, entities, scores`` from ``path, value`` of documents ``<video>/<n>.json``; a broken one has null arrays, so it
    satisfies nothing."""
    found = F.from_json("value", "detection_class_entities array<string>, detection_scores array<string>")
    rows = texts.select("path", found.alias("d"))
    return rows.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("video"), F.regexp_extract("path", r"(\d+)\.json$", 1).cast("int").alias("n"),
                       F.col("d.detection_class_entities").alias("entities"), F.col("d.detection_scores").cast("array<double>").alias("scores"))


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return detections_of(read_query_files(spark, path))


def keyframes_of(texts: DataFrame) -> DataFrame:
    """``video, t, file, seq`` from ``path, value`` of manifests ``<video>_keyframes.json``; a broken one gives nothing."""
    found = F.from_json("value", "keyframes array<struct<index:bigint,timestamp:double,file:string>>")
    video = F.regexp_extract("path", r"([^/]+)_keyframes\.json$", 1)
    some = texts.select(video.alias("video"), F.posexplode(found.keyframes).alias("seq", "k"))
    return some.select("video", F.col("k.timestamp").alias("t"), F.col("k.file").alias("file"), F.col("seq").cast("long").alias("seq")).where("t is not null and file is not null")


def read_keyframe_manifests(spark: SparkSession, path: str) -> DataFrame:
    return keyframes_of(read_query_files(spark, path))


def keyframe_files(names: DataFrame, most: int = 50) -> DataFrame:
    """``video, frame, path`` of image paths named ``<video>_<frame>``, by frame, ``most`` a video (the listing's page size)."""
    pattern = r"([^/]+?)[_-]?(\d+)\.(?:jpg|jpeg|png|webp)$"
    some = names.select("path", F.regexp_extract(F.lower("path"), pattern, 2).alias("f"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("video")).where("f <> ''")
    some = some.select("video", F.col("f").cast("long").alias("frame"), "path")
    by = W.partitionBy("video").orderBy("frame", "path")
    return some.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= most).drop("rn")


def list_keyframe_files(spark: SparkSession, path: str, most: int = 50) -> DataFrame:
    return keyframe_files(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path"), most)


def cache_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of a column ``value`` of JSON objects, without those that carry an error or aren't JSON."""
    found = lines.select(F.from_json("value", f"{schema}, error string, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    return found.where("error is null and _bad is null").drop("error", "_bad")


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return cache_lines(spark.read.text(path), schema)
