"""Grouped summaries: health, labels, splits, feature statistics, robustness, latency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import second_field_class
from ..scratch import materialize
from . import prefix

REQUIRED, OPTIONAL = ("acc", "bvp", "eda", "temp"), ("hr", "ibi", "tags", "info")


def session_flags(sessions: DataFrame) -> DataFrame:
    """``sessions`` (has_* booleans) with is_valid (the required four) and is_complete (HR and IBI too)."""
    valid = F.lit(True)
    for c in REQUIRED:
        valid = valid & F.coalesce(F.col(f"has_{c}"), F.lit(False))
    complete = valid & F.coalesce(F.col("has_hr"), F.lit(False)) & F.coalesce(F.col("has_ibi"), F.lit(False))
    return sessions.withColumns({"is_valid": valid, "is_complete": complete})


def health_rollup(sessions: DataFrame, patient: str = "patient_id") -> DataFrame:
    """(patient or null for all, sessions, valid, complete, hours): hours of valid sessions only."""
    hours = F.sum(F.when(F.col("is_valid"), (F.col("end_s") - F.col("start_s")) / 3600.0).otherwise(0.0))
    return sessions.rollup(patient).agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if("is_valid").alias("valid"), F.count_if("is_complete").alias("complete"), hours.alias("hours"))


def rate_check(sessions: DataFrame, expected: dict[str, float]) -> DataFrame:
    """(sensor, rates, status): distinct rates seen against the expected one; sensors never seen are left out."""
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("sensor"), F.col(f"{s}_rate").cast("double").alias("rate"), F.lit(float(r)).alias("expected")) for s, r in expected.items())))
    seen = sessions.select(pairs.alias("p")).select("p.*").where(F.col("rate").isNotNull())
    g = seen.groupBy("sensor", "expected").agg(F.sort_array(F.collect_set("rate")).alias("rates"))
    return g.select("sensor", "rates", F.when(F.col("rates") == F.array("expected"), "OK").otherwise("WARN").alias("status"))


def label_audit(label_rows: DataFrame, patients: DataFrame | None = None, patient: str = "patient_id") -> DataFrame:
    """Counts of second-field classes per patient; patients without labels are listed with zeros."""
    classes = ("onset_only", "duration_or_invalid", "usable_offset", "implausible_offset")
    c = label_rows.withColumn("__c", second_field_class(F.col("onset_s"), F.col("second_s")))
    g = c.groupBy(patient).agg(F.count(F.lit(1)).alias("label_rows"), *(F.count_if(F.col("__c") == k).alias(k) for k in classes))
    if patients is None:
        return g
    return patients.select(patient).distinct().join(g, patient, "left").na.fill(0, ["label_rows", *classes])


def label_totals(audited: DataFrame) -> DataFrame:
    """One row of sums over `label_audit`: patients without a label row are listed there but not counted here."""
    classes = ("label_rows", "onset_only", "duration_or_invalid", "usable_offset", "implausible_offset")
    return audited.agg(F.count_if(F.col("label_rows") > 0).alias("patients"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in classes))


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of each key in an explicit order."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def split_composition(sessions: DataFrame, events: DataFrame, split: str = "split") -> DataFrame:
    """(split, sessions, positive_sessions, episodes): episodes are distinct by start and end to the millisecond."""
    key = ["patient_id", "session_id"]
    per = events.groupBy(*key).agg(F.collect_set(F.struct(F.bround("start_s", 3).alias("a"), F.bround("end_s", 3).alias("b"))).alias("eps"))
    s = sessions.join(per, key, "left")
    counts = s.groupBy(split).agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.size("eps") > 0).alias("positive_sessions"))
    eps = s.select(split, F.explode("eps").alias("e")).groupBy(split).agg(F.count_distinct("e").alias("episodes"))
    return counts.join(eps, split, "left").na.fill(0, ["episodes"])


def split_patients(sessions: DataFrame, split: str = "split") -> DataFrame:
    """(split, patient_id, sessions): what each patient gives to a split, a row each rather than a map."""
    return sessions.groupBy(split, "patient_id").agg(F.count(F.lit(1)).alias("sessions"))


def label_counts(rows: DataFrame, label: str, split: str = "split") -> DataFrame:
    """(split, n, positives, percent)."""
    g = rows.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("positives"))
    return g.withColumn("percent", 100.0 * F.col("positives") / F.col("n"))


def feature_stats(vectors: DataFrame, vector: str) -> DataFrame:
    """(channel, mean, sd): population statistics of each component, sd + 1e-8; fit on training rows."""
    flat = vectors.select(F.posexplode(vector).alias("channel", "x"))
    return flat.groupBy("channel").agg(F.avg(F.col("x").cast("double")).alias("mean"), (F.stddev_pop(F.col("x").cast("double")) + 1e-8).alias("sd"))


def session_zscore(rows: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Channels centred and scaled by their session's mean and population deviation + 1e-8."""
    w = Window.partitionBy(*keys)
    return rows.withColumns({c: (F.col(c) - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + 1e-8) for c in channels})


def group_mean_sd(rows: DataFrame, group: str, metrics: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of each metric per group, NaN left out: one value has deviation 0, none null."""
    aggs = []
    for m in metrics:
        v = F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double"))
        aggs += [F.avg(v).alias(f"{m}_mean"), F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias(f"{m}_sd")]
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("runs"), *aggs)


def paired_gain(a: str, b: str) -> Column:
    """b - a where neither is NaN or null."""
    ok = ~F.isnan(F.col(a).cast("double")) & ~F.isnan(F.col(b).cast("double"))
    return F.when(ok, F.col(b) - F.col(a))


def robustness_group(name: Column) -> Column:
    """struct<family, base> of ``robust_seed42_base`` or ``robust_label300s_base``; null family elsewhere."""
    family = F.regexp_extract(name, r"^robust_(seed|label)[^_]*_(.+)$", 1)
    return F.struct(F.when(family != "", family).alias("family"), F.regexp_extract(name, r"^robust_(?:seed|label)[^_]*_(.+)$", 1).alias("base"))


def percentiles(rows: DataFrame, groups: Sequence[str], value: str, shares: dict[str, float], config: EngineConfig = DEFAULT) -> DataFrame:
    """(groups, a column for each of ``shares``): exact percentiles, linear between the two nearest ranks; nulls are left out.

    Equal values are counted first, before the shuffle.  Running counts then tell which values hold the ranks
    in question, so no group's values are ever held together.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    counts = materialize(counts, "value-counts")
    below = prefix.running(counts, groups, ["__v"], {"__below": prefix.Running("sum", F.col("__c"), inclusive=False)}, config)
    sizes = counts.groupBy(*groups).agg(F.sum("__c").alias("__n")).withColumnsRenamed({g: f"__{g}" for g in groups})
    on = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups] or F.lit(True)
    placed = below.join(sizes, on)
    out = []
    for name, share in shares.items():
        at = (F.col("__n") - 1) * float(share)
        here = lambda k: F.max(F.when((F.col("__below") <= k) & (k < F.col("__below") + F.col("__c")), F.col("__v")))
        low, high = here(F.floor(at)), here(F.ceil(at))
        out.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return placed.groupBy(*groups).agg(*out)


def latency(rows: DataFrame, groups: Sequence[str], ms: str, config: EngineConfig = DEFAULT) -> DataFrame:
    """Mean, exact linear-interpolated p50 and p95, least and most."""
    plain = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("runs"), F.avg(ms).alias("mean_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"))
    ranked = percentiles(rows, groups, ms, {"p50_ms": 0.5, "p95_ms": 0.95}, config).withColumnsRenamed({g: f"__{g}" for g in groups})
    on = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups] or F.lit(True)
    return plain.join(ranked, on, "left").select(*groups, "runs", "mean_ms", "p50_ms", "p95_ms", "min_ms", "max_ms")


def tensor_bytes(shape: Column, item_size: Column) -> Column:
    """Bytes of a tensor: product of its shape times the size of an item."""
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x.cast("long")) * item_size.cast("long")


def op_histogram(ops: DataFrame, groups: Sequence[str], op: str) -> DataFrame:
    return ops.groupBy(*groups, op).agg(F.count(F.lit(1)).alias("n"))


def mc_summary(samples: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
    """Mean, population deviation and confidence mean (1 - sd) of repeated scores."""
    g = samples.groupBy(*keys).agg(F.avg(p).alias("mean"), F.stddev_pop(p).alias("sd"))
    return g.withColumn("confidence", F.col("mean") * (1.0 - F.col("sd")))
