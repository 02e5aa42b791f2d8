"""Judge URLs by allow and block rules held in a trie.

The trie's first levels are host labels from the right (``net``, then
``example``), the next are path segments; a rule's last, unfinished segment is
a remainder that the URL's next segment must start with.  The rule that fits
with the most host labels wins, then the one with the longest path, then block
before allow.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rule list is broadcast; longer ones are refused instead of risking the executors' memory.
MAX_RULES = 1_000_000


class Rule(NamedTuple):
    verdict: str  #: allow or block
    host: str
    path: str  #: starts with a slash

    @property
    def text(self) -> str:
        return self.host + self.path


class _Node:
    __slots__ = ("labels", "paths")

    def __init__(self) -> None:
        self.labels: dict[str, _Node] = {}
        self.paths: _Path | None = None


class _Path:
    __slots__ = ("ends", "lengths", "segments")

    def __init__(self) -> None:
        self.segments: dict[str, _Path] = {}
        self.ends: dict[str, Rule] = {}  # by the unfinished last segment
        self.lengths: list[int] = []  # those of ``ends``, longest first

    def end(self, rest: str, rule: Rule) -> None:
        self.ends[rest] = rule
        self.lengths = sorted({*self.lengths, len(rest)}, reverse=True)


class UrlTrie:
    def __init__(self, rules: list[Rule]) -> None:
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are broadcast")
        self.root = _Node()
        for rule in sorted(rules, key=lambda r: r.verdict != "allow"):  # a block entry replaces an equal allow entry
            node = self.root
            for label in reversed(rule.host.lower().split(".")):
                node = node.labels.setdefault(label, _Node())
            node.paths = at = node.paths or _Path()
            *done, rest = rule.path.split("/")
            for segment in done:
                at = at.segments.setdefault(segment, _Path())
            at.end(rest, rule)

    def find(self, host: str, path: str) -> Rule | None:
        """The rule that wins for an already normalised host and path."""
        node, best = self.root, None
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            if node.paths is not None:
                best = _deepest(node.paths, segments) or best
        return best


def _deepest(at: _Path | None, segments: list[str]) -> Rule | None:
    best = None
    for segment in segments:
        # a rule's remainder is looked up by the lengths that rules have, so a long segment costs no more than a short one
        found = (at.ends.get(segment[:n]) for n in at.lengths if n <= len(segment))
        best = next((rule for rule in found if rule), best)
        at = at.segments.get(segment)
        if at is None:
            break
    return best


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with columns host, path, rule (null: none fits) and verdict.

    Same-named columns of ``df`` are replaced.  A null URL, or one without
    ``://``, has an empty host and path and gets ``default``, as does any that
    no rule fits.  An empty rule list gives ``default`` everywhere.  A URL of
    any length is judged whole, in time that grows with its length alone.
    """
    trie = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        find, known = trie.value.find, {}
        found = []
        for host, path in zip(hosts, paths, strict=True):
            rule = find(host, path)
            found.append(known.setdefault(rule, (rule.text, rule.verdict) if rule else (None, default)))
        return pd.DataFrame(found, columns=["rule", "verdict"])

    parted = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    return parted.withColumn("_judged", judge("host", "path")).withColumns({"rule": F.col("_judged.rule"), "verdict": F.col("_judged.verdict")}).drop("_judged")
