"""Rankings of scores: ROC-AUC, average precision, thresholds and top shares.

Rows are first counted by distinct score, so ties are one row and the sort is as large as the set of
distinct scores.  Running counts over many of them are those of `prefix.running`: parts of about equal
size, cut by Spark's own sampling, so no task sorts everything, however the scores are spread.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.scalars import bankers_round
from ..scratch import materialize
from . import prefix


def score_counts(df: DataFrame, score: str, label: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """(groups, s, pos, neg): positives and negatives of each distinct score; null and NaN scores are left out.

    The counts are kept in the shared folder, so that all rankings of them share one pass over the rows.
    """
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    return materialize(rows.groupBy(*groups, F.col(score).cast("double").alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")), "score-counts")


def running(counts: DataFrame, groups: tuple[str, ...] = (), config: EngineConfig = DEFAULT) -> DataFrame:
    """``counts`` with the sums over lower scores, pos_below and neg_below, and the totals pos_all and neg_all."""
    below = prefix.running(counts, groups, ["s"], {f"{c}_below": prefix.Running("sum", F.col(c), inclusive=False) for c in ("pos", "neg")}, config)
    totals = F.broadcast(_group(counts, groups).agg(F.sum("pos").alias("pos_all"), F.sum("neg").alias("neg_all")))  # a row per group
    if not groups:
        return below.join(totals, F.lit(True))
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups]
    return below.join(totals.withColumnsRenamed({g: f"__{g}" for g in groups}), same).drop(*(f"__{g}" for g in groups))


def _group(df: DataFrame, groups: tuple[str, ...]):
    return df.groupBy(*groups) if groups else df.groupBy()


def _d(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def roc_auc(counts: DataFrame, groups: tuple[str, ...] = (), config: EngineConfig = DEFAULT) -> DataFrame:
    """(groups, auc): the chance that a positive outranks a negative, ties half; null with one class."""
    r = running(counts, groups, config)
    wins = F.sum(_d("pos") * (_d("neg_below") + 0.5 * _d("neg")))
    pairs = F.sum(_d("pos")) * F.sum(_d("neg"))
    return _group(r, groups).agg((wins / F.nullif(pairs, F.lit(0.0))).alias("auc"))


def _cut_points(counts: DataFrame, groups: tuple[str, ...], config: EngineConfig) -> DataFrame:
    """For each distinct score as threshold (>=): true and false positives."""
    r = running(counts, groups, config)
    return r.withColumns({"tp": F.col("pos_all") - F.col("pos_below"), "fp": F.col("neg_all") - F.col("neg_below")})


def average_precision(counts: DataFrame, groups: tuple[str, ...] = (), config: EngineConfig = DEFAULT) -> DataFrame:
    """(groups, average_precision): precision weighted by recall steps, ties together; null with one class."""
    c = _cut_points(counts, groups, config)
    ap = F.sum(_d("pos") / F.nullif(_d("pos_all"), F.lit(0.0)) * _d("tp") / F.nullif(_d("tp") + _d("fp"), F.lit(0.0)))
    both = (F.sum("pos") > 0) & (F.sum("neg") > 0)
    return _group(c, groups).agg(F.when(both, ap).alias("average_precision"))


def roc_points(counts: DataFrame, groups: tuple[str, ...] = (), config: EngineConfig = DEFAULT) -> DataFrame:
    c = _cut_points(counts, groups, config)
    return c.select(*groups, F.col("s").alias("threshold"), (_d("fp") / F.nullif(_d("neg_all"), F.lit(0.0))).alias("fpr"), (_d("tp") / F.nullif(_d("pos_all"), F.lit(0.0))).alias("tpr"))


def pr_points(counts: DataFrame, groups: tuple[str, ...] = (), config: EngineConfig = DEFAULT) -> DataFrame:
    c = _cut_points(counts, groups, config)
    return c.select(*groups, F.col("s").alias("threshold"), (_d("tp") / F.nullif(_d("tp") + _d("fp"), F.lit(0.0))).alias("precision"), (_d("tp") / F.nullif(_d("pos_all"), F.lit(0.0))).alias("recall"))


def f1_threshold(counts: DataFrame, groups: tuple[str, ...] = (), config: EngineConfig = DEFAULT) -> DataFrame:
    """(groups, threshold, f1): the score that maximises F1, the lowest of equals; 0.5 with one class."""
    pr = pr_points(counts, groups, config).withColumn("f1", 2.0 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-8))
    best = _group(pr, groups).agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("t"), F.max("f1").alias("f1"))
    classes = _group(counts, groups).agg(((F.sum("pos") > 0) & (F.sum("neg") > 0)).alias("both"))
    joined = best.join(classes, list(groups)) if groups else best.join(F.broadcast(classes), F.lit(True))
    return joined.select(*groups, F.when(F.col("both"), F.col("t")).otherwise(0.5).alias("threshold"), F.when(F.col("both"), F.col("f1")).alias("f1"))


def budget_thresholds(counts: DataFrame, budgets: tuple[float, ...], hours: float, config: EngineConfig = DEFAULT, strict_ties: bool = False, groups: tuple[str, ...] = ()) -> DataFrame:
    """(groups, budget, k, threshold, strict): the threshold that lets k = floor(budget * hours) negatives alarm.

    The k-th largest negative score; the least one where k covers all; 0.5 without negatives.  For k = 0 the
    threshold is the greatest negative score with ``strict`` true: alarms need a score above it.  Ties may
    exceed the budget (predicate >=); ``strict_ties`` then asks for a score above the tied one.
    """
    reach = F.col("neg_all") - F.col("neg_below")  # negatives at or above s
    neg = running(counts, groups, config).withColumns({"reach": reach, "s": F.when(F.col("neg") > 0, F.col("s"))})
    ks = [(float(b), int(max(b, 0.0) * hours)) for b in budgets]
    one = []
    for budget, k in ks:
        n = F.coalesce(F.max("neg_all"), F.lit(0))
        enough = F.max(F.when(F.col("reach") >= k, F.col("s")))
        over = F.max(F.when((F.col("reach") >= k) & F.col("s").isNotNull(), F.struct(F.col("s"), F.col("reach"))))["reach"] > k
        t = F.when(n == 0, 0.5).when(F.lit(k) <= 0, F.max("s")).when(F.lit(k) >= n, F.min("s")).otherwise(enough)
        strict = F.when(n == 0, False).when(F.lit(k) <= 0, True).when(F.lit(k) >= n, False).otherwise(over if strict_ties else F.lit(False))
        one.append(F.struct(F.lit(budget).alias("budget"), F.lit(k).cast("long").alias("k"), t.alias("threshold"), strict.alias("strict")))
    return _group(neg, groups).agg(F.array(*one).alias("b")).select(*groups, F.explode("b").alias("b")).select(*groups, "b.*")


def lowest_alarm(row: Row) -> float:
    """The threshold of a row of `budget_thresholds` for alarms at or above it: the next double where ``strict``."""
    return math.nextafter(row["threshold"], math.inf) if row["strict"] else row["threshold"]


def top_share(df: DataFrame, score: str, label: str, tie: str, shares: tuple[float, ...], groups: tuple[str, ...] = (), config: EngineConfig = DEFAULT) -> DataFrame:
    """(groups, share, k, captured, precision, recall) of the k = max(1, round(n share)) highest scores, ties by ``tie``.

    Rows are counted by score; only those that tie with the k-th are put in order.  Null and NaN scores are lowest.
    """
    value = F.col(score).cast("double")
    rows = df.select(*groups, F.col(tie).alias("__tie"), F.coalesce(F.col(label).cast("long"), F.lit(0).cast("long")).alias("__y"), F.when(value.isNull() | F.isnan(value), float("-inf")).otherwise(value).alias("s"))
    counts = materialize(rows.groupBy(*groups, "s").agg(F.sum("__y").alias("pos"), (F.count(F.lit(1)) - F.sum("__y")).alias("neg")), "score-counts")
    r = running(counts, groups, config).withColumns({"own": F.col("pos") + F.col("neg"), "all": F.col("pos_all") + F.col("neg_all")})
    r = r.withColumn("above", F.col("all") - F.col("pos_below") - F.col("neg_below") - F.col("own"))
    r = r.select("*", F.explode(F.array(*(F.lit(float(x)) for x in shares))).alias("share"))
    r = r.withColumn("k", F.greatest(F.lit(1), bankers_round(F.col("all") * F.col("share"))).cast("long")).where("above < k and k <= above + own")
    edge = materialize(r.select(*groups, "share", "s", "k", "above", "pos_all", (F.col("pos_all") - F.col("pos_below") - F.col("pos")).alias("pos_above")), "edges")
    tied = rows.join(F.broadcast(edge), [*groups, "s"])  # a row per group and share
    place = F.row_number().over(Window.partitionBy(*groups, "share").orderBy("__tie"))
    tied = tied.withColumn("place", place).where("place <= k - above").groupBy(*groups, "share").agg(F.sum("__y").alias("tied"))
    out = edge.join(F.broadcast(tied), [*groups, "share"]).withColumn("captured", F.col("pos_above") + F.col("tied"))
    return out.select(*groups, "share", "k", "captured", (_d("captured") / _d("k")).alias("precision"), (_d("captured") / F.greatest(_d("pos_all"), F.lit(1.0))).alias("recall"))
