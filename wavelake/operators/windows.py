"""Count-based windows, causal and centred frames, sequences of windows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from .prefix import number_rows


def index_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "i", config: EngineConfig = DEFAULT) -> DataFrame:
    """Number the rows of each key from 0 in a total order; a key of a large table spans many tasks."""
    return number_rows(df, keys, order, name, config=config)


class Pane(NamedTuple):
    """An aggregate that can be put together from parts: min, max, sum, count, first or last (by the index) of a column."""

    how: str
    value: Column


_PARTS = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count}
#: Panes of a session that one task takes, at least; eight times the panes of a window where that is more.
PANES = 4096


def _part(p: Pane, index: str) -> Column:
    if p.how in ("first", "last"):
        return (F.min_by if p.how == "first" else F.max_by)(p.value, F.col(index))
    return _PARTS[p.how](p.value)


def count_windows(indexed: DataFrame, keys: Sequence[str], size: int, stride: int, aggs: dict[str, Column | Pane], index: str = "i") -> DataFrame:
    """Aggregate windows of ``size`` rows every ``stride`` rows; only full windows are returned.

    Window w of a key holds the rows w * stride to w * stride + size - 1.  Without overlap a row belongs to one
    window.  With it, aggregates given as `Pane` are made for panes of gcd(size, stride) rows, and a frame puts
    the panes of a window together, by blocks of a session that each hold the few panes that follow them: a row
    is shuffled once, a pane once or twice, however much windows overlap.  Any other aggregate needs its rows at
    each of their ceil(size / stride) windows.
    """
    i = F.col(index)
    column = {n: _part(a, index) if isinstance(a, Pane) else a for n, a in aggs.items()}
    if size == stride or not all(isinstance(a, Pane) for a in aggs.values()):
        if size == stride:
            rows = indexed.withColumn("window_idx", F.floor(i / size).cast("long"))
        else:
            first = F.greatest(F.lit(0), F.ceil((i - size + 1) / stride)).cast("long")
            last = F.floor(i / stride).cast("long")
            rows = indexed.withColumn("window_idx", F.explode(F.when(first <= last, F.sequence(first, last))))
        out = rows.groupBy(*keys, "window_idx").agg(F.count(F.lit(1)).alias("__n"), *(c.alias(n) for n, c in column.items()))
        return out.where(F.col("__n") == size).drop("__n")
    pane = math.gcd(size, stride)
    each, hop = size // pane, stride // pane
    panes = indexed.groupBy(*keys, F.floor(i / pane).cast("long").alias("__pane")).agg(F.count(F.lit(1)).alias("__n"), *(c.alias(n) for n, c in column.items()))
    most = max(PANES, 8 * each)
    block, p = F.floor(F.col("__pane") / most), F.col("__pane")
    here = F.when((p % most < each - 1) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    dealt = panes.withColumn("__own", block).withColumn("__block", F.explode(here))
    frame = Window.partitionBy(*keys, "__block").orderBy("__pane").rangeBetween(0, each - 1)
    merge = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.sum, "first": F.first, "last": F.last}
    out = dealt.withColumns({"__all": F.sum("__n").over(frame), **{f"__w_{n}": merge[a.how](n).over(frame) for n, a in aggs.items()}})
    out = out.where((F.col("__own") == F.col("__block")) & (p % hop == 0) & (F.col("__all") == size))
    return out.select(*keys, (p / hop).cast("long").alias("window_idx"), *(F.col(f"__w_{n}").alias(n) for n in aggs))


def window_label(label: str = "label") -> Column:
    """A window is positive if any of its rows is."""
    return (F.max(label) > 0.5).cast("int")


def first_last(value: Column, index: str = "i") -> tuple[Column, Column]:
    """Aggregates: the value at the least and at the greatest index."""
    return F.min_by(value, F.col(index)), F.max_by(value, F.col(index))


def causal_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, k: int, name: str = "smoothed") -> DataFrame:
    """Mean of a row and the k - 1 rows before it in its session; the first rows use fewer."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(max(1, k) - 1), 0)
    return df.withColumn(name, F.avg(value).over(frame))


def centred_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, k: int, name: str) -> DataFrame:
    """Convolution with a box of k rows, length kept, zeros beyond the ends: the sum is always divided by k."""
    before, after = (k // 2, k // 2 - 1) if k % 2 == 0 else (k // 2, k // 2)
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-before, after)
    return df.withColumn(name, F.sum(value).over(frame) / float(k))


def energy(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, k: int, name: str = "energy") -> DataFrame:
    """Root mean square over a centred box of k rows."""
    squared = F.col(value).cast("double") * F.col(value).cast("double")
    out = centred_mean(df, keys, order, squared, k, "__ms")
    return out.withColumn(name, F.sqrt(F.col("__ms") + 1e-8)).drop("__ms")


def sequences(windows: DataFrame, keys: Sequence[str], length: int, start: str = "start_s", end: str = "end_s", hop: int | None = None) -> DataFrame:
    """Sequences of ``length`` consecutive windows every ``hop`` (half the length), anchored at the last window's centre."""
    hop = hop or max(1, length // 2)
    w = F.col("__w")
    rows = windows.withColumnRenamed("window_idx", "__w")
    out = count_windows(rows, keys, length, hop, {"first_window": Pane("min", w), "last_window": Pane("max", w), "anchor_s": Pane("last", (F.col(start) + F.col(end)) / 2.0)}, index="__w")
    return out.withColumnRenamed("window_idx", "seq_idx")


def window_stats(indexed: DataFrame, keys: Sequence[str], size: int, value: str) -> DataFrame:
    """Per full window: mean, deviation (variance at least 1e-6), min, max, last minus first."""
    v = F.col(value).cast("double")
    first, last = first_last(v)
    spread = F.sqrt(F.greatest(F.var_pop(v), F.lit(1e-6)))
    return count_windows(indexed, keys, size, size, {"mean": F.avg(v), "sd": spread, "least": F.min(v), "most": F.max(v), "change": last - first})


def patches(vector: Column, size: int) -> Column:
    """An array cut into arrays of ``size``, the rest dropped."""
    n = F.floor(F.size(vector) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(vector, k * size + 1, size))).otherwise(F.array())


def pooled(vector: Column) -> Column:
    """struct<mean, most>: average and maximum over time."""
    total = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.struct((total / F.nullif(F.size(vector), F.lit(0))).alias("mean"), F.array_max(vector).cast("double").alias("most"))


def reconstruction_error(signal: Column, rebuilt: Column) -> Column:
    """Mean squared difference of two equal-length arrays."""
    squares = F.zip_with(signal, rebuilt, lambda a, b: (a - b).cast("double") * (a - b).cast("double"))
    return F.aggregate(squares, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(signal), F.lit(0))
