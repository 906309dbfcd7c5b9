"""Alerts with a refractory period: the first hot row fires, then the session is locked for r rows.

A hot row more than r rows after the hot one before it always fires, so hot rows fall into islands that do not
touch each other, and rows at most r after an island's first never fire.  Whether a later row of an island fires
depends on earlier firings, which no window frame expresses.  Islands of up to `ISLAND` rows are folded, each as
an array.  In a longer one every row points to the next that may fire after it; pointers are doubled until
all have left the island, and from its first row the firings are then found by halving jumps, all by equi-joins, so an
island of any length spans many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..scratch import materialize
from .prefix import Running, number_rows, running

#: Rows of an island that one fold takes.
ISLAND = 4096


def _folded(rows: DataFrame, position: str) -> DataFrame:
    """(isle, position) of the later firings of islands that are short enough for an array."""
    isles = rows.groupBy("__isle").agg(F.sort_array(F.collect_list(position)).alias("ps"), F.max("__r").alias("r"), F.max("__first").alias("first"))
    none = F.array().cast("array<bigint>")
    start = F.struct(F.col("first").alias("last"), none.alias("out"))
    step = lambda a, p: F.when(p - a["last"] > F.col("r"), F.struct(p.alias("last"), F.concat(a["out"], F.array(p)).alias("out"))).otherwise(a)
    return isles.select("__isle", F.explode(F.aggregate("ps", start, step)["out"]).alias(position))


def _jumped(rows: DataFrame, position: str) -> DataFrame:
    """The same for islands of any length, by doubled pointers.  The first of ``rows`` of an island fires."""
    numbered = materialize(number_rows(rows, ["__isle"], [position], "n"), "numbered")
    here = numbered.select("__isle", F.col(position).alias("t"), F.lit(1).alias("o"), F.col("n").alias("seen"), F.lit(None).cast("long").alias("n"))
    asks = numbered.select("__isle", (F.col(position) + F.col("__r")).alias("t"), F.lit(0).alias("o"), F.lit(None).cast("long").alias("seen"), "n")
    # from the last position down, so that the last row seen is the next one beyond the lock
    ahead = running(here.unionByName(asks), ["__isle"], [F.col("t").desc(), "o"], {"to": Running("last", F.col("seen"))})
    jumps = [materialize(ahead.where("n is not null and to is not null").select("__isle", "n", "to"), "jumps")]
    while True:
        further = jumps[-1].select("__isle", F.col("n").alias("to"), F.col("to").alias("next"))
        doubled = materialize(jumps[-1].join(further, ["__isle", "to"]).select("__isle", "n", F.col("next").alias("to")), "jumps")
        if doubled.isEmpty():
            break
        jumps.append(doubled)
    fired = numbered.where("n = 0").select("__isle", "n")
    for jump in reversed(jumps):
        fired = materialize(fired.unionByName(fired.join(jump, ["__isle", "n"]).select("__isle", F.col("to").alias("n"))), "fired")
    return fired.join(numbered, ["__isle", "n"]).select("__isle", position)


def refractory_alerts(windows: DataFrame, keys: Sequence[str], score: str, threshold: float | Column, r: int | Column, position: str = "window_idx", config: EngineConfig = DEFAULT) -> DataFrame:
    """(keys, position) of the rows that alert; ``position`` numbers a session's rows from 0."""
    lock = F.lit(r) if isinstance(r, int) else r
    hot = windows.where(F.col(score) >= threshold).select(*keys, F.col(position).cast("long").alias(position), lock.cast("long").alias("__r"))
    hot = materialize(hot, "hot")
    hot = running(hot, keys, [position], {"__before": Running("last", F.col(position), inclusive=False)}, config)
    hot = hot.withColumn("__fires", F.coalesce(F.col(position) - F.col("__before") > F.col("__r"), F.lit(True))).drop("__before")
    hot = running(hot, keys, [position], {"__first": Running("last", F.when(F.col("__fires"), F.col(position)))}, config)
    rows = materialize(hot.where(F.col("__fires") | (F.col(position) - F.col("__first") > F.col("__r"))), "islands")
    later = rows.where("not __fires").select(F.struct(*keys, F.col("__first").alias("__at")).alias("__isle"), position, "__r", "__first")
    sizes = later.groupBy("__isle").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > ISLAND)
    if sizes.isEmpty():
        found = _folded(later, position)
    else:
        long = materialize(sizes.select("__isle"), "islands")
        found = _folded(later.join(long, "__isle", "left_anti"), position).unionByName(_jumped(later.join(long, "__isle", "left_semi"), position))
    return rows.where("__fires").select(*keys, position).unionByName(found.select(*(F.col("__isle")[k].alias(k) for k in keys), position))
