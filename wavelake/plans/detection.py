"""From labelled samples to a detector's report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import offset_policy
from ..operators import intervals, metrics, ranking, selection, windows
from ..scratch import materialize


def label_intervals(labels: DataFrame, keys: Sequence[str], config: EngineConfig = DEFAULT) -> DataFrame:
    """Merged events from label rows (keys, onset_s, second_s)."""
    end = offset_policy(F.col("onset_s"), F.col("second_s"), config.event_seconds, config.max_offset_seconds)
    rows = labels.select(*keys, F.col("onset_s").alias("start_s"), end.alias("end_s"))
    return intervals.merge_intervals(rows, keys, gap=config.merge_gap_seconds)


def scored_windows(samples: DataFrame, keys: Sequence[str], order: Sequence[str], score: str, events: DataFrame, size: int, config: EngineConfig = DEFAULT) -> DataFrame:
    """(keys, window_idx, start_s, end_s, p, label) of full tumbling windows; ``samples`` have ``t_s`` and a score."""
    indexed = windows.index_rows(samples, keys, order)
    labelled = intervals.label_points(indexed, events, keys, "t_s")
    return windows.count_windows(labelled, keys, size, size, {
        "start_s": F.min_by("t_s", "i"), "end_s": F.max_by("t_s", "i"), "p": F.max(score), "label": windows.window_label()})


def budget_report(val: DataFrame, test: DataFrame, events: DataFrame, keys: Sequence[str], config: EngineConfig = DEFAULT, stride_seconds: float = 5.0, refractory_minutes: float = 0.0) -> DataFrame:
    """One row per alarm budget: threshold on the negatives of ``val``; window, event and alert metrics of ``test`` at it.

    ``events`` are those of the test sessions.  Alerts keep the refractory time; their columns that event
    metrics have too start with ``alert_``.
    """
    val = materialize(val.select("p", "label"), "validation")
    hours = max(val.count() * stride_seconds / 3600.0, 1e-9)
    counts = ranking.score_counts(val, "p", "label")
    lowest = {r.budget: ranking.lowest_alarm(r) for r in ranking.budget_thresholds(counts, config.alarm_budgets, hours, config).collect()}
    lock = round(max(refractory_minutes, 0.0) * 60.0 / stride_seconds)
    rows = selection.repeated(test.select(*keys, "window_idx", "start_s", "end_s", "p", "label"), "budget", list(lowest))
    rows = materialize(rows.withColumn("t", selection.by_value("budget", lowest)), "budgets")
    each, by = selection.repeated(events, "budget", list(lowest)), [*keys, "budget"]
    # one budget's rows are the windows themselves, already written: one pass for all thresholds
    once = rows.where(F.col("budget") == next(iter(lowest))).drop("budget")
    cm = metrics.over_thresholds(once, lowest, "budget", "p", "label", stride_seconds)
    ev = metrics.event_metrics(rows, each, by, "p", "label", F.col("t"), ["budget"]).select("budget", "event_count", "detected_events", "event_sensitivity", "ci95_low", "ci95_high")
    al = metrics.alert_metrics(rows, each, by, "p", F.col("t"), lock, stride_seconds, ["budget"]).select(
        "budget", "alerts", "true_alerts", "false_alerts", F.col("detected_events").alias("alert_detected_events"), F.col("event_sensitivity").alias("alert_event_sensitivity"), "false_alerts_per_hour")
    return cm.join(F.broadcast(ev), "budget").join(F.broadcast(al), "budget")  # a row per budget
