"""Data behind figures, as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion_matrix(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, truth, guess, n, share): row-normalised; an empty row has shares 0."""
    cells = F.array(*(F.struct(F.lit(t).alias("truth"), F.lit(g).alias("guess"), F.col(c).alias("n")) for t, g, c in (("normal", "normal", "tn"), ("normal", "event", "fp"), ("event", "normal", "fn"), ("event", "event", "tp"))))
    flat = metrics.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")
    total = F.sum("n").over(Window.partitionBy(*keys, "truth"))
    return flat.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def unpivot(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(keys, metric, value): bars of a grouped chart."""
    return df.unpivot(list(keys), list(metrics), "metric", "value")


def side_by_side(standard: DataFrame, extended: DataFrame, on: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Both allocations and their gain per metric, matched on equal keys (budgets are doubles)."""
    a = standard.select(*on, *(F.col(m).alias(f"std_{m}") for m in metrics))
    b = extended.select(*on, *(F.col(m).alias(f"pro_{m}") for m in metrics))
    return a.join(b, list(on)).withColumns({f"gain_{m}": F.col(f"pro_{m}") - F.col(f"std_{m}") for m in metrics})


def missed_events(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sessions with events that no window caught, and the best score of each."""
    return hits.where(~F.col("detected")).groupBy(*keys).agg(F.count(F.lit(1)).alias("missed"), F.max("max_score").alias("best_score"))


def timeline(scored: DataFrame, keys: Sequence[str], score: str, label: str, threshold: float) -> DataFrame:
    """(keys, window_idx, outcome): tp, fp, fn or tn of each window."""
    hot, y = F.col(score) >= threshold, F.col(label) == 1
    outcome: Column = F.when(hot & y, "tp").when(hot, "fp").when(y, "fn").otherwise("tn")
    return scored.select(*keys, "window_idx", outcome.alias("outcome"))


def gains_over(rows: DataFrame, name: str, base: str, metrics: Sequence[str]) -> DataFrame:
    """(name, METRIC_gain): each other row's gain over the row named ``base``, which is one row."""
    b = rows.where(F.col(name) == base).select(*(F.col(m).alias(f"__{m}") for m in metrics)).limit(1)
    others = rows.where(F.col(name) != base).join(F.broadcast(b), F.lit(True))
    return others.select(name, *((F.col(m) - F.col(f"__{m}")).alias(f"{m}_gain") for m in metrics))


def paired_allocations(rows: DataFrame, name: str, allocations: Sequence[tuple[str, str, str]], metrics: Sequence[str]) -> DataFrame:
    """(allocation, std_*, pro_*, gain_*): for each (allocation, standard variant, extended variant) both rows side by side.

    The allocations are a constant of a few entries.
    """
    pairs = F.array(*(F.struct(F.lit(a).alias("allocation"), F.lit(s).alias("standard"), F.lit(e).alias("extended")) for a, s, e in allocations))
    each = rows.sparkSession.range(1, numPartitions=1).select(F.explode(pairs).alias("p")).select("p.*")
    part = lambda side: rows.join(F.broadcast(each.select("allocation", F.col(side).alias(name))), name).select("allocation", *metrics)
    return side_by_side(part("standard"), part("extended"), ["allocation"], metrics)


def kpis(windows: DataFrame, events: DataFrame) -> DataFrame:
    """One row of headline figures from `confusion_metrics` and `event_metrics` of one model."""
    w = windows.select(F.col("n").alias("windows"), "accuracy", "precision", "recall", "f1", "specificity", "false_alarms_per_hour")
    e = events.select(F.col("event_count").alias("events"), "detected_events", "event_sensitivity", "ci95_low", "ci95_high")
    return w.join(F.broadcast(e), F.lit(True))  # one row each
