"""URL filters: one trie over reversed host labels, then path segments.

A rule is (host, path prefix, allow | block). It fits a URL whose host equals the rule's host or is
below it and whose path starts with the rule's path. Precedence: the rule with most host labels,
then the one with the longest path; when both verdicts exist for the same entry, block wins.

The trie travels to the executors in the task closure, so the number of rules is checked against
`max_rules`; above it, or for rules that are a DataFrame, `judge_by_join` does the same by an equi-join on
host suffixes.

Edge cases: a null URL or one without `://` has empty host and path and fits no rule; repeated rows
are judged alike; an empty table gives an empty result; other columns of the input are ignored
unless named in `keep`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.common import load

#: Rules of the contract: verdict, host, path.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
DEFAULT_VERDICT = "allow"
MAX_RULES = 500_000


@dataclass
class Node:
    """A host label or a whole path segment; `ends` has the rules whose path ends inside the next segment."""

    labels: dict = field(default_factory=dict)
    segments: dict = field(default_factory=dict)
    ends: dict = field(default_factory=dict)
    longest: int = 0


def build_trie(rules) -> Node:
    root = Node()
    for verdict, host, path in rules:
        at = root
        for label in reversed(host.split(".")) if host else ():
            at = at.labels.setdefault(label, Node())
        *whole, last = path.split("/")
        for segment in whole:
            at = at.segments.setdefault(segment, Node())
        if at.ends.get(last, ("", ""))[1] != "block":
            at.ends[last] = (host + path, verdict)
        at.longest = max(at.longest, len(last))
    return root


def _in_path(node: Node, segments: list[str]):
    """The rule with the longest path below a host's node, or None."""
    found = None
    for segment in segments:
        for n in range(min(len(segment), node.longest), -1, -1):
            if segment[:n] in node.ends:
                found = node.ends[segment[:n]]
                break
        node = node.segments.get(segment)
        if node is None:
            break
    return found


def match(trie: Node, host: str, path: str):
    """(rule, verdict) of the rule that wins, or None."""
    segments, found, at = path.split("/"), None, trie
    for label in reversed(host.split(".")):
        at = at.labels.get(label)
        if at is None:
            break
        if at.ends or at.segments:
            found = _in_path(at, segments) or found
    return found


def host_and_path(url):
    """Columns host and path of a URL column (see the module's text for null and odd ones)."""
    whole = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(df: DataFrame, rules=RULES, url: str = "url", keep=("page_id",), default: str = DEFAULT_VERDICT, max_rules: int = MAX_RULES) -> DataFrame:
    """df's `keep` columns with host, path, rule and verdict."""
    rules = list(rules)
    if len(rules) > max_rules:
        return judge_by_join(df, df.sparkSession.createDataFrame(rules, "verdict string, host string, path string"), url, keep, default)
    host, path = host_and_path(F.col(url))
    rows = df.select(F.struct(*keep).alias("kept"), host.alias("host"), path.alias("path"))
    schema = pa.schema([("rule", pa.string()), ("verdict", pa.string())])
    out = rows.schema.simpleString()[len("struct<") : -1] + ",rule:string,verdict:string"
    trie = build_trie(rules)

    def apply(batches):
        for batch in batches:
            found = [match(trie, h, p) or (None, default) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            columns = list(pa.table({"rule": [x[0] for x in found], "verdict": [x[1] for x in found]}, schema=schema).combine_chunks().columns)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns)], names=[*batch.schema.names, "rule", "verdict"])

    return rows.mapInArrow(apply, out).select("kept.*", "host", "path", "rule", "verdict")


def judge_by_join(df: DataFrame, rules: DataFrame, url: str = "url", keep=("page_id",), default: str = DEFAULT_VERDICT) -> DataFrame:
    """As judge(), for rules (verdict, host, path) of any number: an equi-join on the distinct hosts' suffixes."""
    host, path = host_and_path(F.col(url))
    rows = df.select(F.struct(*keep).alias("kept"), host.alias("host"), path.alias("path"))
    urls = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = urls.withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    r = rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), "verdict")
    hits = suffixes.join(r, "suffix").where(F.col("path").startswith(F.col("prefix")))
    order = F.struct(F.size(F.split("suffix", r"\.")), F.length("prefix"), F.col("verdict") == "block")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("suffix", "prefix").alias("rule"), "verdict"), order).alias("best"))
    return rows.join(best, ["host", "path"], "left").select("kept.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "pages"))


SQL = """
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages)
SELECT page_id, host, path,
  CASE WHEN fits('example.com', '/en/7') THEN 'example.com/en/7' WHEN fits('com', '/en/') THEN 'com/en/'
       WHEN fits('example.net', '/de/8') THEN 'example.net/de/8' WHEN fits('net', '/de/') THEN 'net/de/'
       WHEN fits('org', '/es/') THEN 'org/es/' END AS rule,
  CASE WHEN fits('example.com', '/en/7') THEN 'allow' WHEN fits('com', '/en/') THEN 'block'
       WHEN fits('example.net', '/de/8') THEN 'block' WHEN fits('net', '/de/') THEN 'allow'
       WHEN fits('org', '/es/') THEN 'block' ELSE 'allow' END AS verdict
FROM u
"""


def _spelled(sql: str) -> str:
    import re

    return re.sub(r"fits\('([^']*)', '([^']*)'\)", r"(ends_with('.' || host, '.\1') AND starts_with(path, '\2'))", sql)


SQL = _spelled(SQL)
