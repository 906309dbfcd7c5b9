"""Window, event and alert metrics of a scored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import log_loss, wilson
from ..scratch import materialize
from .intervals import overlapping_pairs
from .refractory import refractory_alerts


def _ratio(a: Column, b: Column, least: float = 1.0) -> Column:
    return a.cast("double") / F.greatest(b.cast("double"), F.lit(least))


def confusion_metrics(df: DataFrame, score: str, label: str, threshold: float | Column, stride_seconds: float = 5.0, groups: Sequence[str] = ()) -> DataFrame:
    """One row per group: counts of the confusion matrix and what follows from them, at score >= threshold.

    Denominators are at least 1; hours count all windows; ``loss`` clips scores at 1e-7.
    """
    y, hot = F.col(label) == 1, F.col(score) >= threshold
    base = df.groupBy(*groups).agg(
        F.count_if(y & hot).alias("tp"), F.count_if(~y & hot).alias("fp"), F.count_if(~y & ~hot).alias("tn"), F.count_if(y & ~hot).alias("fn"),
        F.count(F.lit(1)).alias("n"), F.avg(log_loss(F.col(label), F.col(score))).alias("loss"), F.max(threshold if isinstance(threshold, Column) else F.lit(float(threshold))).alias("threshold"),
    )
    return _rates(base, stride_seconds)


def _rates(base: DataFrame, stride_seconds: float) -> DataFrame:
    """What follows from the counts tp, fp, tn, fn and n."""
    tp, fp, tn, fn, n = (F.col(c) for c in ("tp", "fp", "tn", "fn", "n"))
    precision, recall, specificity = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    hours = F.greatest(n * float(stride_seconds) / 3600.0, F.lit(1e-9))
    return base.withColumns({
        "accuracy": _ratio(tp + tn, n), "precision": precision, "recall": recall,
        "f1": 2.0 * precision * recall / F.greatest(precision + recall, F.lit(1e-12)),
        "specificity": specificity, "balanced_accuracy": (recall + specificity) / 2.0, "positive_rate": _ratio(tp + fp, n),
        "all_normal_accuracy": _ratio(tn + fp, n), "false_alarms_per_hour": fp.cast("double") / hours,
    })


def sswce(df: DataFrame, score: str, label: str, positive_weight: float = 0.9, negative_weight: float = 0.1) -> DataFrame:
    """Sensitivity-specificity weighted cross entropy: weighted means of the two classes' losses."""
    loss = log_loss(F.col(label), F.col(score))
    mean = lambda y: F.coalesce(F.avg(F.when(F.col(label) == y, loss)), F.lit(0.0))
    return df.agg((positive_weight * mean(1) + negative_weight * mean(0)).alias("loss"))


def focal_loss(df: DataFrame, score: str, label: str, gamma: float = 2.0) -> DataFrame:
    p = F.col(score).cast("double")
    right = F.when(F.col(label) == 1, p).otherwise(1.0 - p)
    return df.agg(F.avg(F.pow(1.0 - right, gamma) * log_loss(F.col(label), F.col(score))).alias("loss"))


def _beside(one: DataFrame, other: DataFrame, groups: Sequence[str]) -> DataFrame:
    """A row per group (one row without groups) with the columns of both; few rows."""
    return one.join(F.broadcast(other), list(groups), "left") if groups else one.join(F.broadcast(other), F.lit(True))


def event_hits(windows: DataFrame, events: DataFrame, keys: Sequence[str], score: str, threshold: float | Column) -> DataFrame:
    """(keys, event_index, start_s, end_s, overlapping, detected, max_score) for every event, bounds inclusive."""
    w = windows.select(*keys, F.col("start_s").alias("w_start"), F.col("end_s").alias("w_end"), F.col(score).alias("w_score"), (F.col(score) >= threshold).alias("w_hot"))
    e = events.select(*keys, "event_index", "start_s", "end_s")
    met = overlapping_pairs(e, w, keys, True, right_bounds=("w_start", "w_end")).groupBy(*keys, "event_index").agg(
        F.count("w_score").alias("overlapping"), F.bool_or("w_hot").alias("detected"), F.max("w_score").alias("max_score"))
    out = e.join(met.hint("merge"), [*keys, "event_index"], "left")
    return out.select(*keys, "event_index", "start_s", "end_s", F.coalesce("overlapping", F.lit(0)).alias("overlapping"), F.coalesce("detected", F.lit(False)).alias("detected"), "max_score")


def event_metrics(windows: DataFrame, events: DataFrame, keys: Sequence[str], score: str, label: str, threshold: float | Column, groups: Sequence[str] = ()) -> DataFrame:
    """One row per group: events, detected, sensitivity with its Wilson interval, and windows by outcome.

    ``groups`` are some of ``keys``, such as a parameter that windows and events are repeated for.
    """
    hits = event_hits(windows, events, keys, score, threshold).groupBy(*groups).agg(F.count(F.lit(1)).alias("event_count"), F.count_if("detected").alias("detected_events"))
    hot, y = F.col(score) >= threshold, F.col(label) == 1
    counts = windows.groupBy(*groups).agg(F.count_if(hot).alias("positive_windows"), F.count_if(hot & y).alias("true_positive_windows"), F.count_if(hot & ~y).alias("false_positive_windows"))
    both = _beside(counts, hits, groups).fillna(0, ["event_count", "detected_events"])
    sized = both.withColumns({"event_sensitivity": _ratio(F.col("detected_events"), F.col("event_count")), "ci": wilson(F.col("detected_events"), F.col("event_count"))})
    return sized.select(*groups, "event_count", "detected_events", "event_sensitivity", F.col("ci.low").alias("ci95_low"), F.col("ci.high").alias("ci95_high"), "positive_windows", "true_positive_windows", "false_positive_windows")


def alert_metrics(windows: DataFrame, events: DataFrame, keys: Sequence[str], score: str, threshold: float | Column, refractory: int | Column, stride_seconds: float = 5.0, groups: Sequence[str] = ()) -> DataFrame:
    """One row per group (`event_metrics`): alerts after the refractory rule, events they hit, false alerts per hour."""
    # written once: alerts, their bounds and the counts read them, and no task holds the making of windows beside these
    hot = (F.col(score) >= threshold).cast("int").alias("__hot")
    lock = F.lit(refractory) if isinstance(refractory, int) else refractory
    windows = materialize(windows.select(*keys, "window_idx", "start_s", "end_s", hot, lock.alias("__lock")), "windows")
    fired = refractory_alerts(windows, keys, "__hot", 1, F.col("__lock"))
    alerts = materialize(windows.join(fired.hint("merge"), [*keys, "window_idx"]).select(*keys, "window_idx", "start_s", "end_s"), "alerts")
    e = events.select(*keys, "event_index", F.col("start_s").alias("e_start"), F.col("end_s").alias("e_end"))
    met = overlapping_pairs(alerts, e, keys, True, right_bounds=("e_start", "e_end")).groupBy(*groups).agg(
        F.count_distinct(*keys, "window_idx").alias("true_alerts"), F.count_distinct(*keys, "event_index").alias("detected_events"))
    out = windows.groupBy(*groups).agg(F.count(F.lit(1)).alias("windows"))
    for df, name in ((alerts, "alerts"), (events, "event_count")):
        out = _beside(out, df.groupBy(*groups).agg(F.count(F.lit(1)).alias(name)), groups)
    out = _beside(out, met, groups).fillna(0, ["alerts", "event_count", "true_alerts", "detected_events"])
    hours = F.greatest(F.col("windows") * float(stride_seconds) / 3600.0, F.lit(1e-9))
    out = out.withColumn("false_alerts", F.col("alerts") - F.col("true_alerts"))
    return out.withColumns({"event_sensitivity": _ratio(F.col("detected_events"), F.col("event_count")), "false_alerts_per_hour": F.col("false_alerts").cast("double") / hours})


def alerts_per_event(windows: DataFrame, events: DataFrame, keys: Sequence[str], score: str, threshold: float, refractory: int) -> DataFrame:
    """(keys, event_index, alert_count) for every event."""
    fired = windows.join(refractory_alerts(windows, keys, score, threshold, refractory).hint("merge"), [*keys, "window_idx"])
    a = fired.select(*keys, F.col("start_s").alias("w_start"), F.col("end_s").alias("w_end"))
    e = events.select(*keys, "event_index", "start_s", "end_s")
    met = overlapping_pairs(e, a, keys, True, right_bounds=("w_start", "w_end")).groupBy(*keys, "event_index").agg(F.count(F.lit(1)).alias("alert_count"))
    return e.select(*keys, "event_index").join(met.hint("merge"), [*keys, "event_index"], "left").fillna(0, ["alert_count"])


def false_alarm_rate(score: str, label: str, threshold: float | Column, hours: Column | float) -> Column:
    """Aggregate: negatives at or above the threshold per hour."""
    h = F.lit(float(hours)) if isinstance(hours, int | float) else hours
    return F.count_if((F.col(label) == 0) & (F.col(score) >= threshold)).cast("double") / h


def over_thresholds(df: DataFrame, thresholds: dict, name: str, score: str, label: str, stride_seconds: float = 5.0) -> DataFrame:
    """`confusion_metrics` for several named thresholds, for about the cost of one: a row per threshold.

    A row counts once, among those that reach as many thresholds as it does; the counts of a threshold are sums of
    these few.
    """
    if not thresholds:
        raise ValueError("no thresholds")
    y, cuts = F.col(label) == 1, sorted({float(t) for t in thresholds.values()})
    reached = F.when(F.col(score).isNotNull(), F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: t <= F.col(score))))
    loss = log_loss(F.col(label), F.col(score))
    counts = df.groupBy(reached.alias("__r")).agg(F.count_if(y).alias("__pos"), F.count_if(~y).alias("__neg"), F.count(F.lit(1)).alias("__n"), F.sum(loss).alias("__loss"), F.count(loss).alias("__losses"))
    one = []
    for key, t in thresholds.items():
        hot = F.col("__r") > cuts.index(float(t))
        of = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
        one.append(F.struct(F.lit(key).alias(name), of("__pos", hot).alias("tp"), of("__neg", hot).alias("fp"), of("__neg", ~hot).alias("tn"), of("__pos", ~hot).alias("fn"),
                            F.sum("__n").alias("n"), (F.sum("__loss") / F.nullif(F.sum("__losses"), F.lit(0))).alias("loss"), F.lit(float(t)).alias("threshold")))
    rows = counts.agg(F.array(*one).alias("g"), F.sum("__n").alias("__any")).where("__any > 0").select(F.explode("g").alias("g")).select("g.*")
    return _rates(rows, stride_seconds)
