"""Operator 11: urls judged by allow and block entries, in a trie over reversed host labels and path segments.

An entry (host, path, verdict) fits a url whose host is the entry's or a subdomain of it and whose path
starts with the entry's, character by character: ``/en/1`` fits ``/en/1570``.  Of the entries that fit,
the longest decides: first the one with most host labels, then the one with the longest path; of an allow
and a block entry for the same place, block.  A url that none fits gets the verdict ``default``.

The trie holds host labels from the last to the first; below a host, whole path segments; at a segment,
the beginnings of the next one.  A url walks it once, in as many steps as the trie is deep, whatever
the number of entries.  It is broadcast only after the entries were counted (`TRIE_ENTRIES`,
`TRIE_BYTES`); more are joined: a url's host suffixes and, for each, those beginnings of its path that
are as long as some entry of that host.  Both ways give the same rows.

Defined cases: a null url, or one without ``://``, has an empty host and path, which no entry with a
host fits; nothing is decoded, ports and user names belong to the host; entries with a null host,
path or verdict are left out, any verdict but allow and block raises; hosts of entries are lower-cased
(A-Z); repeated pages get equal results; empty tables give no rows; other columns are kept by `allowed`.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ALLOW, BLOCK = "allow", "block"
Entry = tuple[str, str, str]
#: Entries of the query, (host, path, verdict): fixed values.
ENTRIES: tuple[Entry, ...] = (
    ("org", "/", ALLOW),
    ("example.org", "/es/", BLOCK),
    ("example.org", "/en/1", BLOCK),
    ("com", "/fr/", ALLOW),
    ("com", "/de/", BLOCK),
)
#: More entries, or more bytes of them, are joined rather than broadcast.
TRIE_ENTRIES, TRIE_BYTES = 200_000, 32 << 20
_FOUND = "rule string, verdict string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then what follows up to ``?``, ``#`` or the end."""
    rest = F.coalesce(F.get(F.split(url, "://", 2), F.lit(1)), F.lit(""))
    return common.ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


class Trie:
    """Entries by reversed host labels, then path segments.

    A host node is [children by label, its path node or None]; a path node is [children by whole segment,
    {beginning of the next segment: (rule, verdict)}, the beginnings' lengths, longest first].
    """

    def __init__(self, entries: Iterable[Entry]):
        self.root: list[Any] = [{}, None]
        for host, path, verdict in entries:
            node = self.root
            for label in reversed(host.translate(str.maketrans(common.UPPER, common.LOWER)).split(".")):
                node = node[0].setdefault(label, [{}, None])
            if node[1] is None:
                node[1] = [{}, {}, ()]
            at = node[1]
            *whole, beginning = path.split("/")
            for segment in whole:
                at = at[0].setdefault(segment, [{}, {}, ()])
            if beginning not in at[1] or verdict == BLOCK:
                at[1][beginning] = (host + path, verdict)
                at[2] = tuple(sorted(set(map(len, at[1])), reverse=True))

    @staticmethod
    def _longest(node: list[Any], path: str) -> tuple[str, str] | None:
        best, at = None, 0
        while True:
            for n in node[2]:
                if path[at : at + n] in node[1]:
                    best = node[1][path[at : at + n]]
                    break
            end = path.find("/", at)
            node = node[0].get(path[at:end]) if end >= 0 and node[0] else None
            if node is None:
                return best
            at = end + 1

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest entry that fits, or None."""
        node, found, at = self.root, [], len(host)
        while at >= 0 and node[0]:
            dot = host.rfind(".", 0, at)
            node = node[0].get(host[dot + 1 : at])
            if node is None:
                break
            if node[1]:
                found.append(node[1])
            at = dot
        return next((best for p in reversed(found) if (best := self._longest(p, path))), None)


def _checked(entries: DataFrame) -> DataFrame:
    e = entries.select(common.ascii_lower(F.col("host")).alias("host"), "path", "verdict").where("host is not null and path is not null and verdict is not null")
    other = e.where(~F.col("verdict").isin(ALLOW, BLOCK)).select("verdict").first()
    if other:
        raise ValueError(f"verdict {other[0]}")
    return e


def _by_trie(urls: DataFrame, entries: Iterable[Entry]) -> DataFrame:
    trie = urls.sparkSession.sparkContext.broadcast(Trie(entries))

    @F.pandas_udf(_FOUND)
    def match(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        found = map(trie.value.match, host, path)
        return pd.DataFrame([x or (None, None) for x in found], columns=["rule", "verdict"], dtype=object)

    return urls.withColumn("found", match("host", "path"))


def _by_join(urls: DataFrame, entries: DataFrame) -> DataFrame:
    """The same by equi-joins, for more entries than a task should hold."""
    labels = F.size(F.split("host", r"\."))
    best = F.max(F.struct(F.col("verdict") == BLOCK, "verdict"))["verdict"]  # block wins a tie
    entries = common.materialize(entries.groupBy("host", "path").agg(best.alias("verdict")), "entries")
    lengths = entries.groupBy(F.col("host").alias("suffix")).agg(F.collect_set(F.length("path")).alias("lengths"))
    deepest = entries.agg(F.coalesce(F.max(labels), F.lit(0))).first()[0]
    parts = F.split("host", r"\.")
    longest = F.least(F.size(parts), F.lit(deepest))
    suffixes = F.when(longest > 0, F.transform(F.sequence(F.lit(1), longest), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))).otherwise(F.array())
    one = urls.select("host", "path").distinct()
    near = one.select("host", "path", F.explode(suffixes).alias("suffix")).join(lengths, "suffix")
    near = near.select("host", "path", "suffix", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    near = near.withColumn("beginning", F.substr("path", F.lit(1), F.col("n")))
    e = entries.select(F.col("host").alias("suffix"), F.col("path").alias("beginning"), "verdict", labels.alias("labels"))
    hit = F.struct("labels", "n", F.concat("suffix", "beginning").alias("rule"), "verdict")
    found = near.join(e, ["suffix", "beginning"]).groupBy("host", "path").agg(F.max(hit).alias("hit"))
    found = found.select("host", "path", F.struct("hit.rule", "hit.verdict").alias("found"))
    return urls.join(found, ["host", "path"], "left")


def _judged(urls: DataFrame, entries: DataFrame | Sequence[Entry], default: str) -> DataFrame:
    if isinstance(entries, DataFrame):
        few = _checked(entries)
        rows, held = few.limit(TRIE_ENTRIES + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0))).first()
        out = _by_trie(urls, map(tuple, few.collect())) if rows <= TRIE_ENTRIES and held <= TRIE_BYTES else _by_join(urls, few)
    else:
        if len(entries) > TRIE_ENTRIES:
            raise ValueError(f"more than {TRIE_ENTRIES} entries: give them as a table")
        for _, _, verdict in entries:
            if verdict not in (ALLOW, BLOCK):
                raise ValueError(f"verdict {verdict}")
        out = _by_trie(urls, entries)
    return out.withColumns({"rule": F.col("found.rule"), "verdict": F.coalesce("found.verdict", F.lit(default))}).drop("found")


def judge(pages: DataFrame, entries: DataFrame | Sequence[Entry] = ENTRIES, default: str = ALLOW) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each of ``pages`` (page_id, url); ``rule`` is host and path of the entry, or null."""
    host, path = host_and_path(F.col("url"))
    return _judged(pages.select("page_id", host.alias("host"), path.alias("path")), entries, default).select("page_id", "host", "path", "rule", "verdict")


def allowed(pages: DataFrame, entries: DataFrame | Sequence[Entry] = ENTRIES, default: str = ALLOW) -> DataFrame:
    """``pages`` without those whose url is blocked; all columns are kept."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.struct("*").alias("page"), host.alias("host"), path.alias("path"))
    return _judged(rows, entries, default).where(F.col("verdict") == ALLOW).select("page.*")


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page of ``pages``: its host and path, the entry that decides and the verdict."""
    return judge(common.table(spark, sf_dir, "pages").select("page_id", "url"))


OP11_SQL = f"""
WITH e(host, path, verdict) AS (VALUES {", ".join(str(e) for e in ENTRIES)}),
a AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{common.UPPER}', '{common.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
u AS (SELECT *, row_number() OVER () AS n FROM b),
m AS (SELECT n, arg_max((e.host || e.path, e.verdict), (length(e.host) - length(replace(e.host, '.', '')), length(e.path))) AS best
      FROM u JOIN e ON (u.host = e.host OR ends_with(u.host, '.' || e.host)) AND starts_with(u.path, e.path) GROUP BY n)
SELECT page_id, host, path, best[1] AS rule, coalesce(best[2], 'allow') AS verdict FROM u LEFT JOIN m USING (n)
"""
