"""Arg-max selection: lexicographic keys, grids of parameters, rankings of runs.

NaN is turned into null before any comparison, and nulls rank last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import blend, parse_fraction
from ..scratch import materialize
from .metrics import alert_metrics, confusion_metrics, event_metrics
from .ranking import budget_thresholds, lowest_alarm, roc_auc, score_counts
from .windows import causal_mean


def no_nan(c: Column) -> Column:
    return F.when(~F.isnan(c.cast("double")), c)


def ranked(df: DataFrame, key: Sequence[Column], first: str) -> DataFrame:
    """Rows by the key's parts, each descending, nulls last; equals keep the order of ``first``."""
    return df.orderBy(*(k.desc_nulls_last() for k in key), first)


def best(df: DataFrame, key: Sequence[Column], first: str) -> DataFrame:
    """The first row of `ranked` (a top-1, not a sort)."""
    return ranked(df, key, first).limit(1)


def allocation_key() -> list[Column]:
    """Standard against extended allocation: no loss of events, recall and balance first, then gains."""
    gain = lambda c: F.col(f"pro_{c}") - F.col(f"std_{c}")
    ev, rec, bal = gain("event_sensitivity"), gain("recall"), gain("balanced_accuracy")
    return [
        ev >= 0, ev, rec >= 0, bal >= 0, F.col("pro_recall"), rec, bal, no_nan(gain("auc")),
        F.col("std_false_alarms_per_hour") - F.col("pro_false_alarms_per_hour"), F.col("std_recall"),
    ]


def product_key() -> list[Column]:
    """Ranking of experiments by viability, events, recall, balance, false alarms and AUC."""
    viable = (F.col("std_events") >= 3) & (F.col("std_recall") > 0) & (F.col("std_false_alarms_per_hour") <= 30)
    return [
        viable, F.col("pro_events") - F.col("std_events"), F.col("pro_recall") - F.col("std_recall"), F.col("std_events"),
        F.col("std_recall"), -F.col("std_false_alarms_per_hour"), no_nan(F.col("pro_auc")),
    ]


def archive_key() -> list[Column]:
    return [no_nan(F.col("pro_auc") - F.col("std_auc")), no_nan(F.col("pro_pr_auc")), F.col("pro_recall"), -F.col("pro_false_alarms_per_hour")]


def promotion_key() -> list[Column]:
    """Promotion: viable with an event and bounded alarms, then every gain of extended over standard."""
    viable = (F.col("std_events") >= 1) & (F.col("std_false_alarms_per_hour") <= 40)
    gain = lambda c: F.col(f"pro_{c}") - F.col(f"std_{c}")
    fewer = F.col("std_false_alarms_per_hour") - F.col("pro_false_alarms_per_hour")
    return [
        viable, gain("events") >= 0, gain("events"), gain("recall") >= 0, gain("recall"), fewer >= 0, fewer, no_nan(gain("auc")),
        F.col("pro_events"), F.col("pro_recall"), -F.col("pro_false_alarms_per_hour"), no_nan(F.col("pro_auc")),
        F.col("std_events"), F.col("std_recall"), -F.col("std_false_alarms_per_hour"), no_nan(F.col("std_auc")), no_nan(F.col("pro_pr_auc")), no_nan(F.col("std_pr_auc")),
    ]


def best_baseline(rows: DataFrame) -> DataFrame:
    return best(rows, [F.col("detected_events"), F.col("recall"), -F.col("false_alarms_per_hour"), no_nan(F.col("auc"))], "name")


def best_ablation(rows: DataFrame, without: str = "ACC") -> DataFrame:
    """The variant of greatest PR-AUC, AUC and F1 (NaN counts as -1), the bare one left out."""
    worst = lambda c: F.coalesce(no_nan(F.col(c)), F.lit(-1.0))
    return best(rows.where(F.col("variant") != without), [worst("pr_auc"), worst("auc"), worst("f1")], "variant")


def events_of(text: Column) -> Column:
    return parse_fraction(text)["detected"]


def fusion_grid(rows: DataFrame, standard: str, extended: str, label: str, threshold: float, weights: Sequence[float] = DEFAULT.fusion_weights) -> DataFrame:
    """`confusion_metrics` for every blend of two scores, in one pass."""
    grid = F.explode(F.array(*(F.lit(float(w)) for w in weights))).alias("weight")
    blended = rows.select("*", grid).withColumn("__p", blend(F.col(standard), F.col(extended), F.col("weight")))
    return confusion_metrics(blended, "__p", label, threshold, groups=["weight"])


def select_fusion(grid: DataFrame) -> DataFrame:
    """The weight of greatest recall, balance, fewest alarms; the earliest of equals."""
    return best(grid, [F.col("recall"), F.col("balanced_accuracy"), -F.col("false_alarms_per_hour")], "weight")


def smoothing_score(detected: Column, sensitivity: Column, recall: Column, balanced: Column, auc: Column, alarms: Column) -> Column:
    return 200.0 * detected + 40.0 * sensitivity + 20.0 * recall + 5.0 * balanced + F.coalesce(no_nan(auc), F.lit(0.0)) - 0.05 * alarms


def repeated(df: DataFrame, name: str, values: Sequence[float]) -> DataFrame:
    """Each row once for each value of a parameter."""
    return df.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))


def by_value(name: str, of: dict) -> Column:
    """A double for each value of a parameter."""
    out = F.lit(None).cast("double")
    for value, x in of.items():
        out = F.when(F.col(name) == value, float(x)).otherwise(out)
    return out


def smoothing_grid(windows: DataFrame, events: DataFrame, keys: Sequence[str], score: str, label: str, budget: float = DEFAULT.alarm_budget_per_hour, ks: Sequence[int] = DEFAULT.smoothing_windows, stride_seconds: float = 5.0) -> DataFrame:
    """(k, threshold, detected_events, event_sensitivity, recall, balanced_accuracy, false_alarms_per_hour, auc, value) per smoothing.

    Each smoothed score has its own threshold, by `budget_thresholds` at ``budget`` alarms per hour.  All
    smoothings are made in one pass and measured in one grouping.
    """
    smooth = windows.select(*keys, "window_idx", "start_s", "end_s", F.col(label).alias("__y"), F.col(score).alias("__p"))
    for k in ks:
        smooth = causal_mean(smooth, keys, ["window_idx"], "__p", k, f"__s{k}")
    each = F.explode(F.array(*(F.struct(F.lit(int(k)).alias("k"), F.col(f"__s{k}").alias("__s")) for k in ks))).alias("__x")
    rows = materialize(smooth.select(*keys, "window_idx", "start_s", "end_s", "__y", each).select(*keys, "window_idx", "start_s", "end_s", "__y", "__x.*"), "smoothed")
    hours = max(rows.count() / max(len(ks), 1) * stride_seconds / 3600.0, 1e-9)
    counts = score_counts(rows, "__s", "__y", ("k",))
    found = budget_thresholds(counts.withColumnRenamed("k", "smoothing"), (budget,), hours, groups=("smoothing",)).collect()
    rows = rows.withColumn("__t", by_value("k", {r.smoothing: lowest_alarm(r) for r in found}))
    ev = event_metrics(rows, repeated(events, "k", [int(k) for k in ks]), [*keys, "k"], "__s", "__y", F.col("__t"), ["k"])
    cm = confusion_metrics(rows, "__s", "__y", F.col("__t"), stride_seconds, ["k"])
    out = cm.select("k", "threshold", "recall", "balanced_accuracy", "false_alarms_per_hour").join(F.broadcast(ev.select("k", "detected_events", "event_sensitivity")), "k").join(F.broadcast(roc_auc(counts, ("k",))), "k")
    value = smoothing_score(F.col("detected_events"), F.col("event_sensitivity"), F.col("recall"), F.col("balanced_accuracy"), F.col("auc"), F.col("false_alarms_per_hour"))
    return out.withColumn("value", value)


def select_smoothing(grid: DataFrame) -> DataFrame:
    """The smoothing of greatest value; k = 1 unless another is strictly better."""
    return best(grid, [F.col("value")], "k")


def refractory_grid(windows: DataFrame, events: DataFrame, keys: Sequence[str], score: str, threshold: float, minutes: Sequence[float] = DEFAULT.refractory_minutes, stride_seconds: float = 5.0) -> DataFrame:
    """`alert_metrics` for every refractory time, with the selection value; one pass."""
    times = [float(m) for m in minutes]
    rows = repeated(windows.select(*keys, "window_idx", "start_s", "end_s", score), "minutes", times)
    locks = by_value("minutes", {m: round(m * 60.0 / stride_seconds) for m in times})
    out = alert_metrics(rows, repeated(events, "minutes", times), [*keys, "minutes"], score, threshold, locks, stride_seconds, ["minutes"])
    value = 100.0 * F.col("event_sensitivity") + F.col("detected_events") - 0.2 * F.col("false_alerts_per_hour")
    return out.withColumn("value", value)


def select_refractory(grid: DataFrame) -> DataFrame:
    return best(grid, [F.col("value")], "minutes")


