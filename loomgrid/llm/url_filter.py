"""URL allow and block lists: a trie over reversed host labels and path segments, matched by longest rule.

The list is built on the driver from rules handed in as Python values, checked against `MAX_RULES`, and broadcast.
Matching walks one trie per URL inside an Arrow batch; pages are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import LOWER, UPPER

#: Most rules that one broadcast trie may hold (some 200 bytes each); split a longer list over several calls.
MAX_RULES = 500_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The production rules.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


class Node:
    """A trie node: whole labels or segments lead to children; `partial` holds rules that end inside the next segment, `sizes` the lengths of their ends, longest first."""

    __slots__ = ("children", "paths", "partial", "sizes")

    def __init__(self) -> None:
        self.children: dict[str, Node] = {}
        self.paths: Node | None = None
        self.partial: dict[str, Rule] = {}
        self.sizes: list[int] = []


class UrlTrie:
    """Rules by reversed host labels, then by path segments.

    A rule fits its host and every subdomain, if the path starts with the rule's path. Of the fitting rules the one
    with most host labels wins, then the one with the longest path; of two rules for the same host and path, block.
    """

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.root = Node()
        for n, rule in enumerate(rules):
            if n >= MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules for one broadcast trie")
            if rule.verdict not in ("allow", "block"):
                raise ValueError(f"verdict {rule.verdict!r} is neither allow nor block")
            self._add(rule)

    def _add(self, rule: Rule) -> None:
        node = self.root
        for label in reversed(rule.host.split(".")):
            node = node.children.setdefault(label, Node())
        node.paths = node.paths or Node()
        *whole, last = rule.path.split("/")
        node = node.paths
        for segment in whole:
            node = node.children.setdefault(segment, Node())
        if len(last) not in node.sizes:
            node.sizes = sorted([*node.sizes, len(last)], reverse=True)
        old = node.partial.get(last)
        if old is None or rule.verdict == "block":
            node.partial[last] = rule

    @staticmethod
    def _longest_path(node: Node, path: str) -> Rule | None:
        best = None
        segments = path.split("/")
        for depth, segment in enumerate(segments):
            for size in node.sizes:  # at most one look-up for each length up to the segment's
                found = node.partial.get(segment[:size]) if size <= len(segment) else None
                if found is not None:
                    best = found
                    break
            if depth + 1 == len(segments) or segment not in node.children:
                break
            node = node.children[segment]
        return best

    def match(self, host: str, path: str) -> Rule | None:
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node.children.get(label)
            if node is None:
                break
            if node.paths is not None:
                best = self._longest_path(node.paths, path) or best
        return best


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host from the first `://` up to `/`, `?`, `#` or the end with A-Z lower-cased; path then up to `?`, `#` or the end.

    A null url, or one without `://`, has an empty host and an empty path.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def filter_urls(pages: DataFrame, rules: Iterable[Rule] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule (its text or null), verdict.

    Pages that no rule fits get `default`; so do null urls and urls without `://`. Repeated rows stay repeated, a null
    id stays null, an empty table gives an empty result, and other columns of `pages` are not read.
    """
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))
    host, path = split_url(F.col(url_col))
    narrow = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = trie.value.match
        for batch in batches:
            found = [match(h, p) for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True)]
            rule = pa.array([f.text if f else None for f in found], pa.string())
            verdict = pa.array([f.verdict if f else default for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["host"], batch["path"], rule, verdict], names=["id", "host", "path", "rule", "verdict"])

    id_type = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(judge, f"id {id_type}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


ORACLE = """
with r(verdict, host, path) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
rest as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (
    select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rest),
best as (
    select p.page_id, p.host, p.path, r.host || r.path as rule, r.verdict,
           row_number() over (partition by p.page_id order by length(r.host) desc nulls last, length(r.path) desc nulls last) as k
    from parts p left join r on (p.host = r.host or p.host like '%.' || r.host) and starts_with(p.path, r.path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from best where k = 1
"""
