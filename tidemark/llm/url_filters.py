"""URL filters by a sort-merge range join.

A URL's canonical key is its reversed host, then a mark, then its path. A rule's host, reversed and closed by the mark or by a dot, is a
prefix, and so an interval of keys: it covers the host and all subdomains. Keys are cut into ranges at sampled quantiles; a rule goes to
every range that its interval meets, which for n ranges is one place for each rule and the open rules at each cut. Within a range, rules and
URLs are sorted together by Spark and swept once as a stream: a stack holds the nested rule hosts that are open, the innermost on top, and a
URL is judged by those alone. A key that fills several ranges (one URL in a third of all rows) is dealt over all of them by row.

Rule choice: of the open rules whose path is a prefix of the URL's path, the longest host and path together, then the longest host. A host's
paths are kept by length, so that a URL asks once for each length, however many rules the host has. Rule hosts are read with A-Z lowered; of
rules with one host and path the greatest verdict counts (block before allow); rules with a null in any column are none. Null URLs and
those without `://` have an empty host and path and fit no rule. Repeated rows are each judged. No rule: the default verdict. An empty table
gives none; a very long URL is judged whole; other columns are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, prepare

#: The contract's rules as (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Keys sampled for each range to place the cuts: cuts only balance the work.
SAMPLED = 40
MARK = "\x01"  # after a whole host


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """example.net becomes net.example. with a dot after every label, so that a label is never taken for a longer one's start."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def flip(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


class Open:
    """The rules of one host: verdicts by path, and the lengths that paths have, longest first."""

    def __init__(self, key: str):
        self.key, self.verdicts, self.lengths = key, {}, []

    def add(self, path: str, name: str, verdict: str) -> None:
        self.verdicts[path] = name, verdict
        if -len(path) not in self.lengths[(at := bisect.bisect_left(self.lengths, -len(path))) : at + 1]:
            self.lengths.insert(at, -len(path))

    def best(self, path: str) -> tuple[str, str] | None:
        return next((found for n in self.lengths if (found := self.verdicts.get(path[:-n])) is not None and -n <= len(path)), None)


def judge(stack: list[Open], path: str) -> tuple[str, str] | None:
    """The rule that wins: (rule as host and path, verdict). Hosts further up the stack are longer."""
    won = None
    for open_ in stack:
        found = open_.best(path)
        if found is not None and (won is None or len(found[0]) >= len(won[0])):
            won = found
    return won


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, default: str = "allow", ranges: int | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, one row per row of pages. rules: (verdict, host, path) triples or a table of these columns."""
    spark = pages.sparkSession
    prepare(spark)
    urls = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"))
    kind = urls.schema["page_id"].dataType.simpleString()
    ranges = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    urls = urls.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    urls = urls.withColumn("key", F.concat(reversed_host(F.col("host")), F.lit(MARK), F.col("path")))
    held = spark.createDataFrame(rules, "verdict string, host string, path string") if isinstance(rules, list) else rules.select("verdict", "host", "path")
    held = held.dropna().withColumn("host", ascii_lower(F.col("host"))).groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("low", reversed_host(F.col("host")))

    n = urls.count()
    part = min(1.0, SAMPLED * ranges / max(1, n))
    seen = sorted(r.key for r in urls.select("key").sample(part, seed=7).toLocalIterator()) if ranges > 1 else []
    cuts = spark.sparkContext.broadcast([seen[len(seen) * k // ranges] for k in range(1, ranges)] if seen else [])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, turn = cuts.value, 0
        for batch in batches:
            to = []
            for key in batch.column("key").to_pylist():
                low, high = bisect.bisect_left(at, key), bisect.bisect_right(at, key)
                turn += 1
                to.append(low + turn % (high - low + 1))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *batch.columns], names=["range", *batch.schema.names])

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A rule for each range that its interval [low, low + the last character) meets."""
        at = cuts.value
        for batch in batches:
            met = [range(bisect.bisect_left(at, low), bisect.bisect_right(at, low + "\U0010ffff") + 1) for low in batch.column("low").to_pylist()]
            rows = pa.array([k for k, m in enumerate(met) for _ in m], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x for m in met for x in m], pa.int32()), *(c.take(rows) for c in batch.columns)], names=["range", *batch.schema.names])

    left = urls.select("key", F.lit(1).alias("side"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict")).mapInArrow(deal, f"range int, key string, side int, page_id {kind}, host string, path string, verdict string")
    right = held.select(F.col("low").alias("key"), F.lit(0).alias("side"), F.lit(None).cast(kind).alias("page_id"), "host", "path", "verdict", "low").mapInArrow(cover, f"range int, key string, side int, page_id {kind}, host string, path string, verdict string, low string").drop("low")
    both = left.unionByName(right).repartition(ranges, "range").sortWithinPartitions("range", "key", "side")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[Open] = []
        now = None
        for batch in batches:
            rows, rule, verdict = [], [], []
            for k, (range_, key, side, host, path, says) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("range", "key", "side", "host", "path", "verdict")), strict=True)):
                if range_ != now:
                    stack, now = [], range_
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if side == 0:
                    if not stack or stack[-1].key != key:
                        stack.append(Open(key))
                    stack[-1].add(path, host + path, says)
                else:
                    won = judge(stack, path)
                    rows.append(k)
                    rule.append(won and won[0])
                    verdict.append(won[1] if won else default)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id").take(at), batch.column("host").take(at), batch.column("path").take(at), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return both.mapInArrow(sweep, f"page_id {kind}, host string, path string, rule string, verdict string")


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return url_filter(pages)


SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
w AS (SELECT page_id, host, path, rhost || rpath AS rule, verdict, length(rhost || rpath) AS n FROM h LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, arg_max(rule, n) AS rule, coalesce(arg_max(verdict, n), 'allow') AS verdict FROM w GROUP BY page_id, host, path
"""
