"""Intervals: merging, overlap joins and counts with explicit boundaries, points in intervals.

No join compares all intervals of a session with each other.  An overlap join is a sweep over tagged starts
and ends: running counts of the other side's starts give every interval the ranks of those inside it, a
run, which is met in blocks of ranks.  Its work is linear in the rows and in the pairs, whatever the lengths
and however many intervals one session has; the running counts let a session span tasks.  Counts of
overlaps, and with them semi and anti joins, need no pairs: starts so far less ends so far.

`overlapping_pairs` and `label_points` join by slices of time instead, which is cheaper where intervals are
short beside a slice and evenly spread, as alerts and windows are.  These joins ask for a merge: Spark judges a side
by the bytes of its Parquet files, and of well packed ones it would broadcast millions of rows through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..scratch import materialize
from .prefix import Running, number_rows, running

#: Seconds of a slice of time that near intervals meet in.
BUCKET = 3600.0
#: Ranks of a block: an interval is copied once for so many that it overlaps, and compared with twice as many in vain at most.
RANKS = 64


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str = "start_s", end: str = "end_s", gap: float = 0.0, config: EngineConfig = DEFAULT) -> DataFrame:
    """Merge intervals of a key that touch or overlap: start <= latest end so far + gap.

    Returns the keys, start, end, ``merged`` (rows of the interval) and event_index (from 0 by start).
    """
    rows = running(df.select(*keys, start, end), keys, [start, end], {"__reach": Running("max", F.col(end), inclusive=False)}, config)
    fresh = F.when(F.col(start) <= F.col("__reach") + gap, 0).otherwise(1)
    islands = running(rows, keys, [start, end], {"__island": Running("sum", fresh)}, config)
    out = islands.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("merged"))
    return out.withColumn("event_index", F.col("__island") - 1).drop("__island")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column, closed: bool) -> Column:
    """Whether two intervals overlap; with ``closed`` touching counts."""
    return (a_start <= b_end) & (a_end >= b_start) if closed else (a_start < b_end) & (a_end > b_start)


def _sides(df: DataFrame, keys: Sequence[str], bounds: tuple[str, str], row: Column) -> tuple[DataFrame, list[str]]:
    """(rows with id, keys as __key0.., s, e and all of the row; the keys' names).  Rows are written, so that ids stay."""
    ks = [f"__key{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(n) for k, n in zip(keys, ks, strict=True)), F.col(bounds[0]).cast("double").alias("s"), F.col(bounds[1]).cast("double").alias("e"), row.alias("row"))
    return materialize(rows.withColumn("id", F.monotonically_increasing_id()), "intervals"), ks


def _is_real(ks: Sequence[str]) -> Column:
    """Whether a row can overlap any: no null key or bound, and no end before the start."""
    ok = F.coalesce(F.col("s") <= F.col("e"), F.lit(False))
    for k in ks:
        ok = ok & F.col(k).isNotNull()
    return ok


def _starts_inside(spans: DataFrame, points: DataFrame, ks: Sequence[str], first: bool, last: bool, config: EngineConfig) -> DataFrame:
    """(row, e, s of ``spans``, other, oe, os of ``points``) where a point's start lies in a span; the ends belong to it if ``first``, ``last``."""
    ranked = number_rows(points.select(*ks, "s", "e", "id", "row"), ks, ["s", "id"], "rank", config=config)
    none = F.lit(None)
    tag = lambda at, order, point, own: [*ks, F.col(at).alias("t"), F.lit(order).alias("o"), F.lit(point).cast("long").alias("point"), *own]
    kind = spans.schema["row"].dataType
    starts = spans.select(*tag("s", 0 if first else 2, 0, ["id", "row", "s", "e"]))
    ends = spans.select(*tag("e", 2 if last else 0, 0, ["id", none.cast(kind).alias("row"), none.cast("double").alias("s"), none.cast("double").alias("e")]))
    marks = points.select(*tag("s", 1, 1, [none.cast("long").alias("id"), none.cast(kind).alias("row"), none.cast("double").alias("s"), none.cast("double").alias("e")]))
    swept = running(starts.unionByName(ends).unionByName(marks), ks, ["t", "o"], {"seen": Running("sum", F.col("point"))}, config).where("id is not null")
    begins = F.col("s").isNotNull()
    runs = swept.groupBy(*ks, "id").agg(F.first("row", ignorenulls=True).alias("row"), F.max("s").alias("s"), F.max("e").alias("e"),
                                        F.max(F.when(begins, F.col("seen"))).alias("lo"), F.max(F.when(~begins, F.col("seen"))).alias("hi")).where("lo < hi")
    block = F.sequence(F.floor(F.col("lo") / RANKS), F.floor((F.col("hi") - 1) / RANKS))
    copies = runs.select(*ks, "row", "s", "e", "lo", "hi", F.explode(block).alias("block"))
    met = ranked.select(*ks, F.col("row").alias("other"), F.col("s").alias("os"), F.col("e").alias("oe"), "rank", F.floor(F.col("rank") / RANKS).alias("block"))
    return copies.join(met, [*ks, "block"]).where("lo <= rank and rank < hi").select("row", "s", "e", "other", "os", "oe")


def overlap_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], closed: bool, how: str = "inner",
    left_bounds: tuple[str, str] = ("start_s", "end_s"), right_bounds: tuple[str, str] = ("start_s", "end_s"), config: EngineConfig = DEFAULT,
) -> DataFrame:
    """Join rows of equal keys whose intervals overlap: inner, left, left_semi or left_anti.  The right side's bounds come out as b_start, b_end.

    Null keys and bounds match nothing, and neither do intervals that end before they start.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join {how}")
    if how in ("left_semi", "left_anti"):
        counted = overlap_counts(left, right, keys, closed, "__overlaps", left_bounds, right_bounds, config)
        return counted.where("__overlaps > 0" if how == "left_semi" else "__overlaps = 0").drop("__overlaps")
    more = [c for c in right.columns if c not in (*keys, *right_bounds) and c not in left.columns]
    a, ks = _sides(left, keys, left_bounds, F.struct("*"))
    b, _ = _sides(right, keys, right_bounds, F.struct(F.col(right_bounds[0]).alias("b_start"), F.col(right_bounds[1]).alias("b_end"), *more))
    a, b = a.where(_is_real(ks)), b.where(_is_real(ks))
    # of a pair the later start lies in the other interval; equal starts are met once, on the left
    one = _starts_inside(a, b, ks, True, closed, config).select("row", "other", "s", "e", "os", "oe")
    two = _starts_inside(b, a, ks, False, closed, config).select(F.col("other").alias("row"), F.col("row").alias("other"), F.col("os").alias("s"), F.col("oe").alias("e"), F.col("s").alias("os"), F.col("e").alias("oe"))
    pairs = one.unionByName(two).where(overlaps(F.col("s"), F.col("e"), F.col("os"), F.col("oe"), closed)).select("row.*", *(F.col("other")[c].alias(c) for c in ("b_start", "b_end", *more)))
    if how == "inner":
        return pairs
    alone = overlap_join(left, right, keys, closed, "left_anti", left_bounds, right_bounds, config)
    return pairs.unionByName(alone, allowMissingColumns=True)


def overlap_counts(
    left: DataFrame, right: DataFrame, keys: Sequence[str], closed: bool, name: str = "n",
    left_bounds: tuple[str, str] = ("start_s", "end_s"), right_bounds: tuple[str, str] = ("start_s", "end_s"), config: EngineConfig = DEFAULT,
) -> DataFrame:
    """``left`` with the number of rows of ``right`` that each overlaps, as `overlap_join` would pair them, without pairing them.

    An interval overlaps those that start before it ends less those that end before it starts.  Open bounds count
    intervals of no length apart, as points strictly inside.
    """
    a, ks = _sides(left, keys, left_bounds, F.struct("*"))
    b = right.select(*(F.col(k).alias(n) for k, n in zip(keys, ks, strict=True)), F.col(right_bounds[0]).cast("double").alias("s"), F.col(right_bounds[1]).cast("double").alias("e")).where(_is_real(ks))
    none, zero, one = F.lit(None), F.lit(0).cast("long"), F.lit(1).cast("long")
    kind = a.schema["row"].dataType
    # order at equal times: closed, starts are seen by an end and ends not by a start; open, the other way round
    begin, ask_begin, ask_end, end = (0, 1, 2, 3) if closed else (1, 2, 0, 1)

    def tag(df, at, order, starts, ends, points, own, asks):
        return df.select(*ks, F.col(at).alias("t"), F.lit(order).alias("o"), starts.alias("starts"), ends.alias("ends"), points.alias("points"),
                         (F.col("id") if own else none.cast("long")).alias("id"), (F.col("row") if asks == "s" else none.cast(kind)).alias("row"), F.lit(asks).alias("asks"))

    long = b if closed else b.where("s < e")
    tags = [tag(long, "s", begin, one, zero, zero, False, None), tag(long, "e", end, zero, one, zero, False, None)]
    if not closed:
        tags.append(tag(b.where("s = e"), "s", begin, zero, zero, one, False, None))
    asked = a.where(_is_real(ks))
    tags += [tag(asked, "s", ask_begin, zero, zero, zero, True, "s"), tag(asked, "e", ask_end, zero, zero, zero, True, "e")]
    rows = tags[0]
    for t in tags[1:]:
        rows = rows.unionByName(t)
    swept = running(rows, ks, ["t", "o"], {c: Running("sum", F.col(c)) for c in ("starts", "ends", "points")}, config).where("id is not null")
    at = lambda c, asks: F.max(F.when(F.col("asks") == asks, F.col(c)))
    n = at("starts", "e") - at("ends", "s") + F.greatest(at("points", "e") - at("points", "s"), zero)
    counted = swept.groupBy(*ks, "id").agg(F.first("row", ignorenulls=True).alias("row"), F.greatest(n, zero).alias("__n"))
    out = counted.select("row.*", F.col("__n").alias(name))
    return out.unionByName(a.where(~_is_real(ks)).select("row.*", zero.alias(name)))


def overlapping_pairs(
    left: DataFrame, right: DataFrame, keys: Sequence[str], closed: bool,
    left_bounds: tuple[str, str] = ("start_s", "end_s"), right_bounds: tuple[str, str] = ("start_s", "end_s"), width: float = BUCKET,
) -> DataFrame:
    """`overlap_join`, inner, for intervals that are short beside ``width``.

    Both sides are repeated for each ``width`` seconds that they reach into, and join on that too, so an
    interval meets those near it, not all of its session.  A pair is kept in the slice of its later start.
    """
    slices = lambda bounds: F.explode(F.sequence(F.floor(F.col(bounds[0]) / width), F.floor(F.col(bounds[1]) / width))).alias("__slice")
    a, b = left.select("*", slices(left_bounds)), right.select("*", slices(right_bounds))
    by = [*keys, "__slice"]
    r = b.select(*(F.col(k).alias(f"__{k}") for k in by), F.col(right_bounds[0]).alias("b_start"), F.col(right_bounds[1]).alias("b_end"), *(c for c in right.columns if c not in (*keys, *right_bounds) and c not in left.columns))
    on = overlaps(F.col(left_bounds[0]), F.col(left_bounds[1]), F.col("b_start"), F.col("b_end"), closed)
    for k in by:
        on = on & (F.col(k) == F.col(f"__{k}"))
    out = a.join(r.hint("merge"), on).drop(*(f"__{k}" for k in by))
    return out.where(F.col("__slice") == F.floor(F.greatest(left_bounds[0], "b_start") / width)).drop("__slice")


def label_points(samples: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str = "start_s", end: str = "end_s", width: float = BUCKET) -> DataFrame:
    """``samples`` with ``label`` 1 where the point lies in an interval of its key, both ends inclusive.

    The intervals are merged first, so a point meets one at most and the join adds no rows.  They are
    repeated for each ``width`` seconds that they reach into, so a point is compared with those near it only.
    """
    merged = merge_intervals(intervals, keys, start, end)
    slices = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))).alias("__slice")
    iv = merged.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(start).alias("__start"), F.col(end).alias("__end"), slices)
    on = (F.floor(F.col(at) / width) == F.col("__slice")) & (F.col(at) >= F.col("__start")) & (F.col(at) <= F.col("__end"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    out = samples.join(iv.hint("merge"), on, "left").withColumn("label", F.when(F.col("__start").isNotNull(), 1).otherwise(0))
    return out.drop(*(f"__{k}" for k in keys), "__start", "__end", "__slice")


def split_alerts(alerts: DataFrame, events: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(alerts that overlap an event, alerts that overlap none), bounds inclusive."""
    counted = materialize(overlap_counts(alerts, events, keys, True, "__overlaps"), "alerts")
    return tuple(counted.where(f"__overlaps {sign} 0").drop("__overlaps") for sign in (">", "="))
