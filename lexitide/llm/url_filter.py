"""Operator 7: allow and block lists as a broadcast trie over reversed host labels and path segments.

A rule (verdict, host, path) fits its host and every subdomain of it where the url's path starts with the rule's
path. Of the rules that fit, the one with most host labels wins, then the one with the longest path; of equal
rules block wins. The trie is broadcast; lists beyond `shard_rules` rules are split into several tries, whose best
matches are compared. A list of more than `max_rules` rules, or one given as a DataFrame, is not broadcast: each host
suffix and path start of a url that has a length some rule of that host has is joined to the rules, with the same answer.

Edge cases: a null url, or one without `://`, has an empty host and path, fits no rule and gets `malformed`;
urls that no rule fits get `default`; rules with an empty host fit no url; repeated rows and null ids are judged
like any other; an empty table or list gives no matches; columns other than id and url are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.llm.common import LOWER, UPPER, spread_join, written

_LOWERED = str.maketrans(UPPER, LOWER)


@dataclass
class _Node:
    next: dict[str, _Node] = field(default_factory=dict)
    paths: _Node | None = None  # on a host label: the root of its rules' path segments
    tails: dict[str, tuple[str, str]] = field(default_factory=dict)  # on a path node: last, maybe cut, segment -> (verdict, rule)
    longest: int = 0


class UrlTrie:
    """Host labels from the last to the first, then path segments."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]) -> None:
        self.root = _Node()
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.translate(_LOWERED).split(".")):
                node = node.next.setdefault(label, _Node())
            node.paths = at = node.paths or _Node()
            *whole, tail = path.split("/")
            for segment in whole:
                at = at.next.setdefault(segment, _Node())
            if at.tails.get(tail, ("",))[0] != "block":
                at.tails[tail] = (verdict, host.translate(_LOWERED) + path)
            at.longest = max(at.longest, len(tail))

    @staticmethod
    def _in_path(root: _Node, segments: list[str]) -> tuple[int, str, str] | None:
        """The deepest rule whose path starts these segments: (its length, verdict, rule)."""
        best, node, used = None, root, 0
        for i, segment in enumerate(segments):
            for n in range(min(len(segment), node.longest), -1, -1):
                if hit := node.tails.get(segment[:n]):
                    best = (used + n, *hit)
                    break
            if i == len(segments) - 1 or segment not in node.next:
                break
            used += len(segment) + 1
            node = node.next[segment]
        return best

    def match(self, host: str, path: str) -> tuple[int, int, str, str] | None:
        """(host labels, path length, verdict, rule) of the longest match."""
        best, node, segments = None, self.root, path.split("/")
        if not host:
            return None
        for depth, label in enumerate(reversed(host.split(".")), 1):
            node = node.next.get(label)
            if node is None:
                break
            if node.paths is not None and (hit := self._in_path(node.paths, segments)):
                best = (depth, *hit)
        return best


def host_and_path(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for mark in "?#":
        rest = rest.split(mark, 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWERED), slash + path


def _joined(pages: DataFrame, rules: DataFrame, default: str, malformed: str) -> DataFrame:
    """judge_urls by joins, for rules (verdict, host, path) of any number. pages: page_id, url."""
    lower = lambda c: F.translate(c, UPPER, LOWER)
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rows = pages.select("page_id", rest.alias("rest")).select("page_id", lower(F.regexp_extract("rest", r"^[^/?#]*", 0)).alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))
    known = rules.select("verdict", lower(F.col("host")).alias("suffix"), F.col("path").alias("start")).groupBy("suffix", "start").agg(F.max("verdict").alias("verdict"))  # block > allow
    lengths = known.groupBy("suffix").agg(F.collect_set(F.length("start")).alias("lengths"))  # no more than a url has characters
    urls = written(rows.filter("host <> ''").select("host", "path").distinct(), "urls")
    labels = F.split("host", r"\.")
    tails = urls.select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(labels, -n, n), ".").alias("suffix")))).alias("t")).select("host", "path", "t.*")
    tried = spread_join(tails, lengths, ["suffix"], ["host", "path"]).withColumn("length", F.explode("lengths")).filter(F.col("length") <= F.length("path"))
    tried = tried.withColumn("start", F.expr("left(path, length)")).drop("lengths")
    hits = spread_join(tried, known, ["suffix", "start"], ["host", "path"])
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("suffix", "start").alias("rule"), "verdict"), F.struct("depth", "length")).alias("best"))
    out = spread_join(rows, best, ["host", "path"], ["page_id"], how="left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.when(F.col("host") == "", malformed).otherwise(default)).alias("verdict"))


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", malformed: str = "block",
    shard_rules: int = 200_000, max_rules: int = 1_000_000,
) -> DataFrame:
    """Per row: page_id, host, path, rule (null if none fits), verdict. rules: (allow or block, host, path)."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    if isinstance(rules, DataFrame):
        return _joined(rows, rules, default, malformed)
    if len(rules) > max_rules:
        return _joined(rows, pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string"), default, malformed)
    context = pages.sparkSession.sparkContext
    tries = [context.broadcast(UrlTrie(rules[i : i + shard_rules])) for i in range(0, len(rules), shard_rules)]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, names, verdicts = [], [], [], []
            for url in batch.column(1).to_pylist():
                host, path = host_and_path(url)
                found = [m for t in tries if (m := t.value.match(host, path))]
                best = max(found, key=lambda m: (m[0], m[1], m[2] == "block"), default=None)
                hosts.append(host)
                paths.append(path)
                names.append(best and best[3])
                verdicts.append(best[2] if best else default if host else malformed)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, names, verdicts))], names=["page_id", "host", "path", "rule", "verdict"])

    fit: Callable = judge
    return rows.mapInArrow(fit, f"page_id {pages.schema[id_col].dataType.simpleString()}, host string, path string, rule string, verdict string")
