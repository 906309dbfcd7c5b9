"""Resampling by index arithmetic: every step is an equality join or a grouping, never a range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from .prefix import Running, running


def lengths(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def downsample_mean(df: DataFrame, keys: Sequence[str], value: str, factor: int = 2) -> DataFrame:
    """(keys, i, value): means of ``factor`` consecutive samples; an incomplete tail is dropped."""
    g = df.groupBy(*keys, F.floor(F.col("i") / factor).cast("long").alias("j")).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("__n"))
    return g.where(F.col("__n") == factor).select(*keys, F.col("j").alias("i"), value)


def grid(counts: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """(keys, i): rows 0 .. n - 1 for each key."""
    return counts.where(F.col(n) > 0).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)).alias("i"))


def hold(df: DataFrame, keys: Sequence[str], value: str, target: DataFrame, factor: int = 1) -> DataFrame:
    """(keys, i, value) on the grid of ``target`` (keys, n): sample i div factor, the last one held.

    With factor 1 this pads or truncates to the target's length.
    """
    size = lengths(df, keys).withColumnRenamed("n", "__have")
    to = grid(target, keys).join(size, list(keys)).withColumn("__j", F.least(F.floor(F.col("i") / factor), F.col("__have") - 1).cast("long"))
    source = df.select(*keys, F.col("i").alias("__j"), value)
    return to.join(source, [*keys, "__j"]).select(*keys, "i", value)


def interpolate(df: DataFrame, keys: Sequence[str], value: str, rate: float, target: DataFrame, target_rate: float, extrapolate: bool = False, offset: str | None = None) -> DataFrame:
    """(keys, i, value) linearly interpolated from a regular grid to ``target`` (keys, n[, offset]).

    Point i of the target lies at i / target_rate + offset seconds after the source's first sample.  Beyond
    the ends the value is clamped, or follows the edge pair's slope with ``extrapolate``.  One sample
    gives a constant.
    """
    size = lengths(df, keys).withColumnRenamed("n", "__have")
    shift = F.col(offset).cast("double") if offset else F.lit(0.0)
    points = target.where(F.col("n") > 0).select(*keys, shift.alias("__shift"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("i"))
    points = points.join(size, list(keys)).withColumn("__x", (F.col("i") / float(target_rate) + F.col("__shift")) * float(rate))
    lo = F.greatest(F.lit(0), F.least(F.floor("__x"), F.col("__have") - 2)).cast("long")
    points = points.withColumn("__lo", lo)
    a = df.select(*keys, F.col("i").alias("__lo"), F.col(value).cast("double").alias("__a"))
    b = df.select(*keys, (F.col("i") - 1).alias("__lo"), F.col(value).cast("double").alias("__b"))
    both = points.join(a, [*keys, "__lo"]).join(b, [*keys, "__lo"], "left")
    part = F.col("__x") - F.col("__lo")
    if not extrapolate:
        part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), part))
    return both.select(*keys, "i", F.coalesce(F.col("__a") + (F.col("__b") - F.col("__a")) * part, F.col("__a")).alias(value))


def interpolate_at(
    samples: DataFrame, points: DataFrame, keys: Sequence[str], at: str, value: str, tie: str | None = None, tolerance: float | None = None, config: EngineConfig = DEFAULT,
) -> DataFrame:
    """``points`` (keys, ``at``) with ``value`` linearly interpolated between the samples before and after them, at whatever times those are.

    Samples and points are put in one order, once; the last sample at or before a point is carried to it, and, from the
    other end of the same parts, the first one after it.  A point at a sample takes its value; of samples at one time the last by ``tie``
    counts backwards and the first forwards.  Beyond the ends the nearest sample is held.  Samples further away than
    ``tolerance`` seconds are no neighbours: with one neighbour it is held, without any the value is null.  Null values
    and times of samples are left out; null keys match null keys.
    """
    t, v = F.col(at).cast("double"), F.col(value).cast("double")
    order = F.col(tie).cast("double") if tie else F.lit(0.0)
    nothing = F.lit(None)
    own = F.struct(*points.columns)
    s = samples.where(v.isNotNull() & t.isNotNull()).select(*keys, t.alias("__t"), F.lit(0).alias("__o"), order.alias("__tie"), v.alias("__v"), nothing.alias("__p"))
    p = points.select(*keys, t.alias("__t"), F.lit(1).alias("__o"), F.lit(0.0).alias("__tie"), nothing.alias("__v"), own.alias("__p"))
    sample = F.when(F.col("__v").isNotNull(), F.struct(F.col("__t").alias("t"), F.col("__v").alias("v")))
    rows = running(s.unionByName(p), keys, ["__t", "__o", "__tie"], {"__a": Running("last", sample), "__b": Running("next", sample)}, config).where("__p is not null")
    near = lambda x: F.col(x) if tolerance is None else F.when(F.abs(F.col(x)["t"] - F.col("__t")) <= float(tolerance), F.col(x))
    rows = rows.withColumns({"__a": near("__a"), "__b": near("__b")})
    part = (F.col("__t") - F.col("__a.t")) / (F.col("__b.t") - F.col("__a.t"))
    between = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * part
    found = F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), between).otherwise(F.coalesce("__a.v", "__b.v"))
    return rows.select("__p.*", F.when(F.col("__t").isNotNull(), found).alias(value))


def fill_gaps(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Nulls take the last value before them, else the next one after them, else 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(value, F.coalesce(before, after, F.lit(0.0)))
