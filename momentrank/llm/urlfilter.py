"""URL filter rules by a sort-merge range join.

A host's labels in reverse, each with an end mark, are a key of which every subdomain's key is a continuation:
a rule's host is an interval of keys. Keys are cut into ranges at quantiles of a bounded sample; a rule goes to each
range that its interval meets. In a range, rules and urls sorted by key pass one sweep with a stack of the rules
whose intervals are open, which nest. A path can't be part of the interval, as subdomains lie between, so the rules
on the stack are tried by path. Keys end in a hash of the row, so one hot url spreads over ranges.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule; the longest rule
(host and path) wins, then the longer host, then a block; repeated rows each get their row. Only the id and url
columns are read, so extra columns can't clash.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions

#: (host, path, verdict); fixed by the query's contract.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
END = "\x01"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys sampled for each range; bounds what the driver reads.
SAMPLE = 40


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_key(host: Column) -> Column:
    labels = F.reverse(F.split(host, r"\."))
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(labels, END), F.lit(END)))


def judged(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row; ``rules`` has host, path, verdict."""
    spark = pages.sparkSession
    n = partitions(spark)
    host, path = parts(F.col(url_col))
    salt = F.hex(F.xxhash64(F.col(id_col), F.col(url_col)))
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), salt.alias("salt"))
    urls = urls.withColumn("key", F.encode(F.concat(reversed_key(F.col("host")), F.lit("\x00"), F.col("salt")), "UTF-8"))
    rows = pages.count()
    some = urls.select("key").sample(fraction=min(1.0, SAMPLE * n / max(rows, 1)), seed=1).limit(4 * SAMPLE * n)
    sample = sorted(bytes(r.key) for r in some.collect())
    cuts = [sample[len(sample) * i // n] for i in range(1, n)] if sample else []

    def ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {"rows": [], "range": []}
            for i, (key, rule) in enumerate(zip(b.column("key").to_pylist(), b.column("rule").to_pylist())):
                first = bisect_right(cuts, key)
                last = bisect_right(cuts, key + b"\xff") if rule else first
                found["rows"] += [i] * (last - first + 1)
                found["range"] += range(first, last + 1)
            yield b.take(pa.array(found["rows"], pa.int64())).append_column("range", pa.array(found["range"], pa.int32()))

    def sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[bytes, list[tuple]]] = []
        within = None
        for b in batches:
            ids, rules_, verdicts = [], [], []
            kept = []
            columns = [b.column(c).to_pylist() for c in ("range", "key", "rule", "host", "path", "verdict")]
            for i, (at, key, rule, host, path, verdict) in enumerate(zip(*columns)):
                if at != within:
                    stack, within = [], at
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if rule:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, []))
                    stack[-1][1].append((len(host) + len(path), len(host), verdict == "block", host, path, verdict))
                    continue
                fits = [r for _, open_ in stack for r in open_ if path.startswith(r[4]) and f".{host}".endswith(f".{r[3]}")]
                best = max(fits, default=None)
                kept.append(i)
                rules_.append(best and best[3] + best[4])
                verdicts.append(best[5] if best else default)
            out = b.select(["page_id", "host", "path"]).take(pa.array(kept, pa.int64()))
            yield out.append_column("rule", pa.array(rules_, pa.string())).append_column("verdict", pa.array(verdicts, pa.string()))

    host = F.translate(F.col("host"), UPPER, LOWER)
    given = rules.select(
        F.lit(None).cast("long").alias("page_id"), host.alias("host"), "path", "verdict", F.encode(reversed_key(host), "UTF-8").alias("key"), F.lit(True).alias("rule")
    )
    all_ = urls.select("page_id", "host", "path", F.lit("").alias("verdict"), "key", F.lit(False).alias("rule")).union(given)
    dealt = all_.mapInArrow(ranges, "page_id long, host string, path string, verdict string, key binary, rule boolean, range int")
    dealt = dealt.repartition(n, "range").sortWithinPartitions("range", "key", F.col("rule").desc())
    return dealt.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")


def op4_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules)


OP4_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id,
             translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                    ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (SELECT page_id, host, path, rhost || rpath AS rule, verdict,
             row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
      FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1"""
