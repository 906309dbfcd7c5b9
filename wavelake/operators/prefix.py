"""Running sums, maxima and last values over orders that no single task could sort.

A window function puts all rows of a key into one task.  Here the rows are dealt out by ranges of
(keys, order), which Spark cuts from a sample, so that a long key spans many tasks and many short ones
share a task.  Each part is reduced to a row a key; what the parts before it add up to is its offset.
Only a key that spans parts needs them, so there are at most twice as many offsets as parts,
and they are broadcast.  Inside a part a window does the rest.

The dealt rows are written to the shared folder first: a part that is computed again after the loss of
an executor must hold the same rows, and both passes read them.  Rows equal in ``order`` stay in one part.

Where Spark's own estimate of the input is at most ``EngineConfig.one_task_bytes``, no key can be more than
one task holds, and the window alone does it in one shuffle; the rows are the same.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..scratch import materialize


class Running(NamedTuple):
    """What to carry along: ``sum``, ``max``, ``last`` or, from the other end, ``next`` (not null) of a column, with or without the row itself."""

    how: str
    value: Column
    inclusive: bool = True


#: Bits of `monotonically_increasing_id` that number the rows of a partition.
_ROW_BITS = 33


def fits_one_task(df: DataFrame, config: EngineConfig = DEFAULT) -> bool:
    """Whether the optimizer's size of ``df``, an upper estimate, is small enough for one task to take all of it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= config.one_task_bytes


def _carry(how: str, value: Column, window) -> Column:
    if how == "sum":
        return F.sum(value).over(window)
    return F.max(value).over(window) if how == "max" else F.last(value, ignorenulls=True).over(window)


def _frames(by: Sequence[Column | str], place: str) -> dict[tuple[bool, bool], WindowSpec]:
    """By (backwards, inclusive): the rows up to this one, from either end of ``place``."""
    out = {}
    for backwards in (False, True):
        spec = Window.partitionBy(*by).orderBy(F.desc(place) if backwards else F.asc(place))
        out |= {(backwards, True): spec.rowsBetween(Window.unboundedPreceding, 0), (backwards, False): spec.rowsBetween(Window.unboundedPreceding, -1)}
    return out


def _merge(how: str, before: Column, here: Column) -> Column:
    """What was carried up to a part and inside it, together."""
    if how == "sum":
        return F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))
    return F.greatest(before, here) if how == "max" else F.coalesce(here, before)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], columns: dict[str, Running], config: EngineConfig | None = None) -> DataFrame:
    """``df`` with ``columns`` carried along ``order`` inside each of ``keys``; null keys are a key, nulls come first.

    Sums over no rows are 0, maxima, last and next values null.  Columns that carry the same `Column` share it.  Without a ``config`` the rows are always dealt out.
    """
    for c in columns.values():
        if c.how not in ("sum", "max", "last", "next"):
            raise ValueError(f"cannot carry {c.how}")
    named = [F.col(k) for k in keys]
    by = [*named, *(F.col(o) if isinstance(o, str) else o for o in order)]
    nothing = F.lit(None)
    if config and fits_one_task(df, config):
        spec = Window.partitionBy(*keys).orderBy(*by[len(keys):])
        frames = {True: spec.rowsBetween(Window.unboundedPreceding, 0), False: spec.rowsBetween(Window.unboundedPreceding, -1)}
        ahead = {n: c for n, c in columns.items() if c.how == "next"}
        forward = {n: _merge(c.how, nothing, _carry(c.how, c.value, frames[c.inclusive])) for n, c in columns.items() if n not in ahead}
        if not ahead:
            return df.withColumns(forward)
        # the same order from its other end; a sort by place, no other shuffle
        if set(columns) & set(df.columns):
            raise ValueError("next values need names of their own")
        back = _frames(keys, "__run_at")
        out = df.withColumns(forward | {"__run_at": F.row_number().over(spec)}).withColumns({n: _carry(c.how, c.value, back[True, c.inclusive]) for n, c in ahead.items()})
        return out.select(*df.columns, *columns)
    values = [next(j for j, other in enumerate(columns.values()) if other.value is c.value) for c in columns.values()]
    rows = df.withColumns({f"__run_v{i}": c.value for i, c in enumerate(columns.values()) if values[i] == i})
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__run_at", F.monotonically_increasing_id())
    dealt = materialize(dealt, "ranges").withColumn("__run_part", F.shiftright("__run_at", _ROW_BITS))

    whole = {}
    for i, c in enumerate(columns.values()):
        v = F.col(f"__run_v{values[i]}")
        end = (F.min if c.how == "next" else F.max)(F.when(v.isNotNull(), F.struct(F.col("__run_at"), v.alias("v"))))["v"]
        whole[f"__run_w{i}"] = F.sum(v) if c.how == "sum" else F.max(v) if c.how == "max" else end
    parts = dealt.groupBy(*keys, "__run_part").agg(*(e.alias(n) for n, e in whole.items()))
    in_turn = Window.partitionBy(*keys).orderBy("__run_part")
    beyond = _frames(keys, "__run_part")
    offsets = parts.select(
        *(F.col(k).alias(f"__run_of{j}") for j, k in enumerate(keys)), F.col("__run_part").alias("__run_p"), F.coalesce(F.lag(F.lit(True)).over(in_turn), F.lead(F.lit(True)).over(in_turn)).alias("__run_goes_on"),
        *(_carry(c.how, F.col(f"__run_w{i}"), beyond[c.how == "next", False]).alias(f"__run_b{i}") for i, c in enumerate(columns.values()))).where("__run_goes_on").drop("__run_goes_on")

    inside = _frames(["__run_part", *keys], "__run_at")
    out = dealt.withColumns({f"__run_h{i}": _carry(c.how, F.col(f"__run_v{values[i]}"), inside[c.how == "next", c.inclusive]) for i, c in enumerate(columns.values())})
    on = F.col("__run_part") == F.col("__run_p")
    for j, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__run_of{j}"))
    out = out.join(F.broadcast(offsets), on, "left")
    return out.select(*(F.col(c) for c in df.columns if c not in columns), *(_merge(c.how, F.col(f"__run_b{i}"), F.col(f"__run_h{i}")).alias(n) for i, (n, c) in enumerate(columns.items())))


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str, first: int = 0, config: EngineConfig | None = None) -> DataFrame:
    """``df`` with the place of each row in ``order`` among those of its ``keys``, from ``first``; the order should be total."""
    place = Running("sum", F.lit(1).cast("long"), inclusive=False)
    return running(df, keys, order, {name: place}, config).withColumn(name, F.col(name) + first)
