"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is a grouped minimum and one equi-join, so a hub is combined before the shuffle and the
join on it can be split.  Rounds write to the shared folder; nothing reaches the driver but a
count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Keys with more rows than `HUB` are joined by broadcast, apart from the others; the bound rises so that there are at most `HUBS`.
HUB, HUBS = 256, 100_000


def with_one(rows: DataFrame, one: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined by ``key`` with ``one``, which has a row for each key and in ``n`` its number of ``rows``, ``total`` in all.

    All rows of a hub would meet in one task of a shuffled join.  They stay where they are: there are at most
    `HUBS` hubs, so their rows of ``one`` are broadcast.
    """
    hub = F.col("n") > max(HUB, total // HUBS)
    hubs = F.broadcast(one.where(hub).drop("n"))
    rest = rows.join(hubs.select(key), key, "left_anti").join(one.where(~hub).drop("n"), key)
    return rows.join(hubs, key).unionByName(rest)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    out = with_one(both.where("v > u"), least, "u", 2 * edges.count()).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` run from the larger to the smaller node."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    out = with_one(edges, least, "u", edges.count()).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the least node of its component.

    Direction, repeats and loops do not matter; edges with a null end are left out.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    now = common.materialize(edges.where("a is not null and b is not null").select(a.alias("u"), b.alias("v")).where("u != v").distinct(), "edges")
    state = None
    while True:
        large = common.materialize(_large_star(now), "edges")
        after = common.materialize(_small_star(large), "edges")
        common.discard(large)
        new = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        common.discard(now)
        now = after
        if tuple(new) == state:
            break
        state = tuple(new)
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
