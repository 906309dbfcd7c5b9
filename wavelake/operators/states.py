"""Labels of temporal state around events: 0 calm, 1 before, 2 during, 3 after."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from .intervals import BUCKET


def state_labels(points: DataFrame, events: DataFrame, keys: Sequence[str], row: Sequence[str], at: str = "anchor_s", config: EngineConfig = DEFAULT) -> DataFrame:
    """``points`` with ``state_H`` and ``label_H`` (1 iff the state is 1) for every horizon H, and ``blocked``.

    1. The first event in order that holds the point, or ended at most ``post_seconds`` before it, decides:
       during (2) or after (3).
    2. Else, if an event starts within ``pre_seconds``: after (3) where an earlier event ended less than
       ``recovery_seconds`` ago, before (1) where the next start is within the horizon.
    3. Else calm (0).

    A point in state 2 or 3 for any horizon is ``blocked``: sequences there are dropped for all.
    ``row`` identifies a point within the keys; one join and one grouping whatever the number of horizons.
    Events are repeated for each slice of time that they reach into, so a point meets those near it only.
    """
    first, last = F.col("start_s") - config.pre_seconds, F.col("end_s") + max(config.post_seconds, config.recovery_seconds)
    slices = F.explode(F.sequence(F.floor(first / BUCKET), F.floor(last / BUCKET))).alias("__slice")
    e = events.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("event_index").alias("__i"), F.col("start_s").alias("__s"), F.col("end_s").alias("__e"), slices)
    t = F.col(at)
    reach = (t >= F.col("__s") - config.pre_seconds) & (t <= F.col("__e") + max(config.post_seconds, config.recovery_seconds))
    on = reach & (F.floor(t / BUCKET) == F.col("__slice"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    held = (F.col("__s") <= t) & (t <= F.col("__e"))
    after = (F.col("__e") < t) & (t <= F.col("__e") + config.post_seconds)
    code = F.when(held, 2).when(after, 3)
    ahead = F.col("__s") > t
    g = points.join(e, on, "left").groupBy(*keys, *row, at).agg(
        F.min_by(code, F.when(code.isNotNull(), F.col("__i"))).alias("__rule1"),
        F.min(F.when(ahead & (t >= F.col("__s") - config.pre_seconds), F.col("__s") - t)).alias("__next"),
        F.max(F.when(F.col("__e") < t, F.col("__e"))).alias("__ended"),
    )
    recovering = F.coalesce(t - F.col("__ended") < config.recovery_seconds, F.lit(False))

    def state(h: int) -> Column:
        second = F.when(F.col("__next").isNotNull() & recovering, 3).when(F.col("__next") <= h, 1)
        return F.coalesce(F.col("__rule1"), second, F.lit(0))

    out = g.withColumns({f"state_{h}": state(h) for h in config.horizons_seconds})
    out = out.withColumns({f"label_{h}": (F.col(f"state_{h}") == 1).cast("int") for h in config.horizons_seconds})
    blocked = F.lit(False)
    for h in config.horizons_seconds:
        blocked = blocked | F.col(f"state_{h}").isin(2, 3)
    return out.withColumn("blocked", blocked).drop("__rule1", "__next", "__ended")
