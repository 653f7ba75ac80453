"""URL filter: a broadcast trie over reversed host labels and path segments.

Each rule names a host and a path prefix. It fits its host and every subdomain when the url's path
starts with its path; of the fitting rules the longest wins (most host labels, then longest path),
whether it allows or blocks. Host labels are walked from the top level down, path segments from the
left; a rule whose path ends inside a segment is kept at the segment before as a partial segment.

At most ``max_rules`` rules are broadcast as a trie. More go through a join instead, exactly: every url
tries the pairs of a suffix of its host and a run of its leading path segments against the rules of that
pair, and the longest that fits wins; only urls that fit a rule are shuffled back.

Defined results: a null url or one without ``://`` has an empty host and path and no rule; a url no
rule fits gets ``default``; repeated rows are judged alike; an empty table gives an empty result; other
columns, whatever their names, are not read. Two rules for one host and path with different verdicts
are an error. Time is linear in a url's length for a given set of rules.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, materialize

_HOST = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

#: The rules of the contract: verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased and path, both empty without ``://``."""
    found = _HOST.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def _checked(rules: Iterable[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """The distinct rules with their hosts lower-cased; unknown and contradictory verdicts are errors."""
    verdicts: dict = {}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r}")
        if verdicts.setdefault((host.translate(_LOWER), path), (verdict, host))[0] != verdict:
            raise ValueError(f"two verdicts for {host}{path}")
    return [(verdict, host, path) for (_, path), (verdict, host) in verdicts.items()]


class UrlTrie:
    """Host nodes are dicts of labels; a path node holds child segments and partial-segment rules by length."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in _checked(rules):
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            node = node.setdefault("paths", {})
            *whole, partial = path.split("/")
            for segment in whole:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            node.setdefault("partial", {})[partial] = (f"{host}{path}", verdict)
            node["lengths"] = sorted({*node.get("lengths", ()), len(partial)}, reverse=True)

    @staticmethod
    def _path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            for n in node.get("lengths", ()):
                if n <= len(segment) and (hit := node["partial"].get(segment[:n])):
                    best = hit
                    break
            node = node.get("segments", {}).get(segment)
            if node is None:
                break
        return best

    def judge(self, host: str, path: str) -> tuple[str, str] | None:
        """Rule text and verdict of the longest fitting rule, or None."""
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            if "paths" in node:
                best = self._path(node["paths"], segments) or best
        return best


def _split_columns(url):
    """Host and path of a url column, both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _join_rules(spark, narrow: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    """What the trie gives, by a join of (host suffix, leading segments)."""
    keyed = [(h.translate(_LOWER), *p.rsplit("/", 1), f"{h}{p}", v) if "/" in p else (h.translate(_LOWER), None, p, f"{h}{p}", v) for v, h, p in rules]
    table = spark.createDataFrame(keyed, "__h string, __lead string, __rest string, __rule string, __verdict string")
    host, path = _split_columns(F.coalesce("__url", F.lit("")))
    urls, _ = materialize(narrow.select(F.monotonically_increasing_id().alias("__row"), F.col("__key").alias("key"), host.alias("host"), path.alias("path")), "urls")
    depths = table.select(F.size(F.split("__lead", "/")).alias("d")).agg(F.max("d")).first()[0] or 0
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    suffixes = urls.select("__row", "path", labels.alias("l"), F.explode(F.sequence(F.lit(1), F.size(labels))).alias("i"))
    suffixes = suffixes.select("__row", "path", F.col("i").alias("n"), F.array_join(F.expr("slice(l, size(l) - i + 1, i)"), ".").alias("__h"))
    suffixes = suffixes.join(table.select("__h").distinct(), "__h", "left_semi")  # hosts no rule names go early
    leads = suffixes.select("__row", "path", "n", "__h", segments.alias("g"), F.explode(F.sequence(F.lit(0), F.least(F.size(segments) - 1, F.lit(depths)))).alias("k"))
    leads = leads.select("__row", "n", "__h", F.when(F.col("k") > 0, F.array_join(F.expr("slice(g, 1, k)"), "/")).alias("__lead"), F.expr("get(g, k)").alias("s"))
    fits = leads.join(table, leads["__h"].eqNullSafe(table["__h"]) & leads["__lead"].eqNullSafe(table["__lead"]) & F.startswith("s", "__rest"))
    best = fits.groupBy("__row").agg(F.max(F.struct("n", F.length("__rule").alias("m"), "__rule", "__verdict")).alias("b"))
    judged = urls.join(best, "__row", "left")
    return judged.select("key", "host", "path", F.col("b.__rule").alias("rule"), F.coalesce("b.__verdict", F.lit(default)).alias("verdict"))


def filter_urls(df: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, default: str = "allow", max_rules: int = 100_000) -> DataFrame:
    """``key``, host, path, rule and verdict for every row of ``df``."""
    spark = df.sparkSession
    rules = _checked(rules)
    narrow = df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{url}`").cast("string").alias("__url"))
    if len(rules) > max_rules:
        return _join_rules(spark, narrow, rules, default).withColumnRenamed("key", key)
    trie = spark.sparkContext.broadcast(UrlTrie(rules))
    arrow_rows(spark)

    def run(batches):
        judge = trie.value.judge
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [judge(h, p) or (None, default) for h, p in parts]
            text = pa.string()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([h for h, _ in parts], text), pa.array([p for _, p in parts], text),
                    pa.array([r for r, _ in found], text), pa.array([v for _, v in found], text),
                ],
                names=["key", "host", "path", "rule", "verdict"],
            )

    kind = narrow.schema[0].dataType.simpleString()
    return narrow.mapInArrow(run, f"key {kind}, host string, path string, rule string, verdict string").withColumnRenamed("key", key)


def op3_url_filter(spark, sf_dir) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP3_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM u
), r(rule_host, rule_path, rule_verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), f AS (
  SELECT p.page_id, p.host, p.path, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host) DESC NULLS LAST, length(rule_path) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM f WHERE k = 1
"""
