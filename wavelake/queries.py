"""The engine's queries on the shipped tables and the SQL that must give the same rows.

Stand-ins: ``events.user_id`` is a session, its rows by (ts, event_id) the samples, ``value`` the signal,
value / 400 a score, and ``event_type = 'error'`` an onset.  Doubles that come from sums are rounded to
six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import blend, format_elapsed, format_or_na, log_loss, magnitude, offset_policy, parse_fraction, patient_id, quantize_int8, second_field_class, wilson, zscore
from .functions.scalars import bankers_round, channel_mask, dequantize_int8, feature_names, select_channels
from .operators import audit, dsp, intervals, metrics, ranking, refractory, resample, selection, splits, states, summary, windows
from .operators.scoring import FeatureScorer, LowRankScorer
from .plans import detection, figures, prediction
from .scratch import materialize, scratch
from .sinks import writers
from .sources import archives, labels, listing, sensors
from .streaming import online

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

KEY = ["user_id"]
SIZE, SECONDS, HOT, LOCK = 4, 600.0, 0.25, 5


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# -- stand-in tables ---------------------------------------------------------------------------


def samples(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return e.select("user_id", "event_id", "event_type", "value", at.alias("t_s"), (F.col("value") / 400.0).alias("p"))


def indexed(spark: SparkSession, sf: str) -> DataFrame:
    return windows.index_rows(samples(spark, sf), KEY, ["t_s", "event_id"])


def onsets(spark: SparkSession, sf: str) -> DataFrame:
    s = samples(spark, sf).where("event_type = 'error'")
    return s.select("user_id", F.col("t_s").alias("onset_s"), F.when(F.col("event_id") % 3 == 0, F.col("t_s") + 900.0).when(F.col("event_id") % 3 == 1, F.col("t_s") - 1.0).alias("second_s"))


def merged(spark: SparkSession, sf: str, gap: float = 0.0) -> DataFrame:
    rows = samples(spark, sf).where("event_type = 'error'").select("user_id", F.col("t_s").alias("start_s"), (F.col("t_s") + SECONDS).alias("end_s"))
    return intervals.merge_intervals(rows, KEY, gap=gap)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return detection.scored_windows(samples(spark, sf), KEY, ["t_s", "event_id"], "p", merged(spark, sf), SIZE)


def days(spark: SparkSession, sf: str) -> DataFrame:
    s = samples(spark, sf).withColumn("day", F.floor(F.col("t_s") / 86400.0).cast("long"))
    return s.groupBy("user_id", "day").agg(F.min("t_s").alias("start_s"), F.max("t_s").alias("end_s"), F.max((F.col("event_type") == "error").cast("int")).alias("positive"), F.avg("value").alias("mean_value"))


def sql(*parts: str) -> str:
    """A query from common table expressions, named parts first."""
    *named, last = parts
    return "WITH " + ",\n".join(CTE[p] for p in named) + ("" if last.startswith(",") else "\n") + last


CTE = {
    "s": "s AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) / 1e6 AS t_s, value / CAST(400 AS DOUBLE) AS p FROM events)",
    "x": "x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_s, event_id) - 1 AS i FROM s)",
    "iv": "iv AS (SELECT user_id, t_s AS start_s, t_s + 600 AS end_s FROM s WHERE event_type = 'error')",
    "ev": """f AS (SELECT *, CASE WHEN start_s <= max(end_s) OVER (PARTITION BY user_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM iv),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS island FROM f),
ev AS (SELECT user_id, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS merged, CAST(island - 1 AS BIGINT) AS event_index FROM g GROUP BY user_id, island)""",
    "l": "l AS (SELECT x.*, CASE WHEN EXISTS (SELECT 1 FROM ev WHERE ev.user_id = x.user_id AND x.t_s BETWEEN ev.start_s AND ev.end_s) THEN 1 ELSE 0 END AS label FROM x)",
    "w": """w AS (SELECT user_id, i // 4 AS window_idx, min(t_s) AS start_s, max(t_s) AS end_s, max(p) AS p, max(label) AS label
FROM l GROUP BY user_id, i // 4 HAVING count(*) = 4)""",
    "d": "d AS (SELECT user_id, CAST(floor(t_s / 86400.0) AS BIGINT) AS day, min(t_s) AS start_s, max(t_s) AS end_s, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS positive, avg(value) AS mean_value FROM s GROUP BY 1, 2)",
    "hit": """hit AS (SELECT ev.user_id, ev.event_index, ev.start_s, ev.end_s, count(w.p) AS overlapping, coalesce(bool_or(w.p >= 0.25), false) AS detected, max(w.p) AS max_score
FROM ev LEFT JOIN w ON w.user_id = ev.user_id AND ev.start_s <= w.end_s AND ev.end_s >= w.start_s GROUP BY 1, 2, 3, 4)""",
    "al": """hot AS (SELECT user_id, window_idx FROM w WHERE p >= 0.25),
nxt AS (SELECT a.user_id, a.window_idx, min(b.window_idx) AS nx FROM hot a LEFT JOIN hot b ON a.user_id = b.user_id AND b.window_idx > a.window_idx + 5 GROUP BY 1, 2),
al AS (SELECT user_id, min(window_idx) AS window_idx FROM hot GROUP BY user_id
  UNION ALL SELECT al.user_id, nxt.nx FROM al JOIN nxt ON al.user_id = nxt.user_id AND al.window_idx = nxt.window_idx WHERE nxt.nx IS NOT NULL)""",
    "c": "c AS (SELECT p AS s, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM w GROUP BY p)",
    "r": """r AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM c)""",
}
W = ("s", "x", "iv", "ev", "l", "w")


def rsql(*parts: str) -> str:
    return sql(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


# -- intervals -----------------------------------------------------------------------------------


@query("interval_merge", sql("s", "iv", "ev", "SELECT * FROM ev"))
def _(spark, sf):
    return merged(spark, sf)


@query("interval_merge_gap", sql("s", "iv", "ev", "SELECT user_id, count(*) AS n, sum(merged) AS rows_merged FROM ev GROUP BY user_id").replace("ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3600 THEN").replace("sum(merged)", "CAST(sum(merged) AS BIGINT)"))
def _(spark, sf):
    return merged(spark, sf, 3600.0).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("merged").alias("rows_merged"))


@query("interval_overlap_strict", sql("s", "iv", "ev", "d", "SELECT d.user_id, d.day, count(*) AS n FROM d JOIN ev ON d.user_id = ev.user_id AND d.start_s < ev.end_s AND d.end_s > ev.start_s GROUP BY 1, 2"))
def _(spark, sf):
    return intervals.overlap_join(days(spark, sf), merged(spark, sf), KEY, closed=False).groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))


@query("interval_overlap_closed", sql("s", "iv", "ev", "d", "SELECT d.user_id, d.day, count(*) AS n FROM d JOIN ev ON d.user_id = ev.user_id AND d.start_s <= ev.end_s AND d.end_s >= ev.start_s GROUP BY 1, 2"))
def _(spark, sf):
    return intervals.overlap_counts(days(spark, sf), merged(spark, sf), KEY, closed=True).where("n > 0").select("user_id", "day", "n")


@query("points_in_intervals", sql("s", "x", "iv", "ev", "l", "SELECT user_id, event_id, label FROM l"))
def _(spark, sf):
    return intervals.label_points(samples(spark, sf), merged(spark, sf), KEY, "t_s").select("user_id", "event_id", "label")


@query("label_policy", """WITH s AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'error'),
o AS (SELECT user_id, t AS onset_s, CASE WHEN event_id % 3 = 0 THEN t + 900 WHEN event_id % 3 = 1 THEN t - 1 END AS second_s FROM s)
SELECT user_id, onset_s, CASE WHEN second_s IS NULL THEN 'onset_only' WHEN second_s <= onset_s THEN 'duration_or_invalid' WHEN second_s - onset_s <= 86400 THEN 'usable_offset' ELSE 'implausible_offset' END AS kind,
CASE WHEN second_s > onset_s AND second_s - onset_s <= 86400 THEN second_s ELSE onset_s + 300 END AS end_s FROM o""")
def _(spark, sf):
    o = onsets(spark, sf)
    return o.select("user_id", "onset_s", second_field_class(F.col("onset_s"), F.col("second_s")).alias("kind"), offset_policy(F.col("onset_s"), F.col("second_s")).alias("end_s"))


# -- windows and frames --------------------------------------------------------------------------


@query("windows_tumbling", sql(*W, "SELECT user_id, window_idx, start_s, end_s, p, label FROM w"))
def _(spark, sf):
    return scored(spark, sf)


@query("windows_sliding", sql("s", "x", """SELECT user_id, k AS window_idx, min(t_s) AS start_s, max(t_s) AS end_s, max(value) AS most
FROM (SELECT *, unnest(range(greatest(0, CAST(ceil((i - 7) / 3.0) AS BIGINT)), i // 3 + 1)) AS k FROM x) GROUP BY 1, 2 HAVING count(*) = 8"""))
def _(spark, sf):
    return windows.count_windows(indexed(spark, sf), KEY, 8, 3, {"start_s": windows.Pane("first", F.col("t_s")), "end_s": windows.Pane("last", F.col("t_s")), "most": windows.Pane("max", F.col("value"))})


@query("causal_mean", sql("s", "SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY t_s, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS smoothed FROM s"))
def _(spark, sf):
    return rounded(windows.causal_mean(samples(spark, sf), KEY, ["t_s", "event_id"], "value", 5).select("user_id", "event_id", "smoothed"), "smoothed")


@query("centred_energy", sql("s", "SELECT user_id, event_id, round(sqrt(sum(value * value) OVER (PARTITION BY user_id ORDER BY t_s, event_id ROWS BETWEEN 16 PRECEDING AND 15 FOLLOWING) / 32.0 + 1e-8), 6) AS energy FROM s"))
def _(spark, sf):
    return rounded(windows.energy(samples(spark, sf), KEY, ["t_s", "event_id"], "value", 32).select("user_id", "event_id", "energy"), "energy")


@query("window_stats", sql("s", "x", """SELECT user_id, i // 8 AS window_idx, round(avg(value), 6) AS mean, round(sqrt(greatest(var_pop(value), 1e-6)), 6) AS sd, min(value) AS least, max(value) AS most,
round(arg_max(value, i) - arg_min(value, i), 6) AS change FROM x GROUP BY 1, 2 HAVING count(*) = 8"""))
def _(spark, sf):
    return rounded(windows.window_stats(indexed(spark, sf), KEY, 8, "value"), "mean", "sd", "change")


SEQ = """q AS (SELECT user_id, k AS seq_idx, min(window_idx) AS first_window, max(window_idx) AS last_window, (arg_max(start_s, window_idx) + arg_max(end_s, window_idx)) / 2.0 AS anchor_s
FROM (SELECT *, unnest(range(greatest(0, CAST(ceil((window_idx - 5) / 3.0) AS BIGINT)), window_idx // 3 + 1)) AS k FROM w) GROUP BY 1, 2 HAVING count(*) = 6)"""
CTE["q"] = SEQ


@query("risk_windows", sql(*W, "q", "SELECT * FROM q"))
def _(spark, sf):
    return windows.sequences(scored(spark, sf), KEY, 6)


STATE = """cand AS (SELECT q.*, ev.event_index, ev.start_s AS a, ev.end_s AS b FROM q LEFT JOIN ev ON q.user_id = ev.user_id),
one AS (SELECT user_id, seq_idx, anchor_s,
  arg_min(CASE WHEN a <= anchor_s AND anchor_s <= b THEN 2 ELSE 3 END, event_index) FILTER (WHERE anchor_s >= a AND anchor_s <= b + 1800) AS rule1,
  min(a - anchor_s) FILTER (WHERE a > anchor_s AND anchor_s >= a - 1800) AS nx, max(b) FILTER (WHERE b < anchor_s) AS ended FROM cand GROUP BY 1, 2, 3),
st AS (SELECT *, CASE WHEN rule1 IS NOT NULL THEN rule1 WHEN nx IS NOT NULL AND anchor_s - ended < 3600 THEN 3 WHEN nx <= 300 THEN 1 ELSE 0 END AS state_300,
 CASE WHEN rule1 IS NOT NULL THEN rule1 WHEN nx IS NOT NULL AND anchor_s - ended < 3600 THEN 3 WHEN nx <= 900 THEN 1 ELSE 0 END AS state_900,
 CASE WHEN rule1 IS NOT NULL THEN rule1 WHEN nx IS NOT NULL AND anchor_s - ended < 3600 THEN 3 WHEN nx <= 1800 THEN 1 ELSE 0 END AS state_1800 FROM one)"""
CTE["st"] = STATE


@query("state_labels", sql(*W, "q", "st", "SELECT user_id, seq_idx, anchor_s, state_300, state_900, state_1800, CASE WHEN state_300 = 1 THEN 1 ELSE 0 END AS label_300, CASE WHEN state_1800 = 1 THEN 1 ELSE 0 END AS label_1800, state_300 IN (2, 3) OR state_900 IN (2, 3) OR state_1800 IN (2, 3) AS blocked FROM st"))
def _(spark, sf):
    q = windows.sequences(scored(spark, sf), KEY, 6)
    return states.state_labels(q, merged(spark, sf), KEY, ["seq_idx"]).select("user_id", "seq_idx", "anchor_s", "state_300", "state_900", "state_1800", "label_300", "label_1800", "blocked")


# -- alerts --------------------------------------------------------------------------------------


@query("refractory_alerts", rsql(*W, "al", "SELECT user_id, window_idx FROM al"))
def _(spark, sf):
    return refractory.refractory_alerts(scored(spark, sf), KEY, "p", HOT, LOCK)


@query("alert_metrics", rsql(*W, "al", """, aw AS (SELECT w.* FROM w JOIN al ON w.user_id = al.user_id AND w.window_idx = al.window_idx),
t AS (SELECT (SELECT count(*) FROM w) AS windows, (SELECT count(*) FROM aw) AS alerts,
 (SELECT count(*) FROM aw WHERE EXISTS (SELECT 1 FROM ev WHERE ev.user_id = aw.user_id AND aw.start_s <= ev.end_s AND aw.end_s >= ev.start_s)) AS true_alerts,
 (SELECT count(*) FROM ev) AS event_count, (SELECT count(*) FROM ev WHERE EXISTS (SELECT 1 FROM aw WHERE ev.user_id = aw.user_id AND aw.start_s <= ev.end_s AND aw.end_s >= ev.start_s)) AS detected_events)
SELECT *, alerts - true_alerts AS false_alerts, round(CAST(detected_events AS DOUBLE) / greatest(event_count, 1), 6) AS event_sensitivity, round(CAST(alerts - true_alerts AS DOUBLE) / (windows * 5.0 / 3600.0), 6) AS false_alerts_per_hour FROM t"""))
def _(spark, sf):
    events = materialize(merged(spark, sf), "events")  # read three times, and merged apart from the making of windows
    made = detection.scored_windows(samples(spark, sf), KEY, ["t_s", "event_id"], "p", events, SIZE)
    return rounded(metrics.alert_metrics(made, events, KEY, "p", HOT, LOCK), "event_sensitivity", "false_alerts_per_hour")


@query("alerts_per_event", rsql(*W, "al", ", aw AS (SELECT w.* FROM w JOIN al ON w.user_id = al.user_id AND w.window_idx = al.window_idx) SELECT ev.user_id, ev.event_index, count(aw.p) AS alert_count FROM ev LEFT JOIN aw ON ev.user_id = aw.user_id AND aw.start_s <= ev.end_s AND aw.end_s >= ev.start_s GROUP BY 1, 2"))
def _(spark, sf):
    return metrics.alerts_per_event(scored(spark, sf), merged(spark, sf), KEY, "p", HOT, LOCK)


# -- metrics -------------------------------------------------------------------------------------

CM = """count(*) FILTER (WHERE label = 1 AND hot) AS tp, count(*) FILTER (WHERE label = 0 AND hot) AS fp, count(*) FILTER (WHERE label = 0 AND NOT hot) AS tn, count(*) FILTER (WHERE label = 1 AND NOT hot) AS fn, count(*) AS n,
avg(-(label * ln(greatest(least(p, 1 - 1e-7), 1e-7)) + (1 - label) * ln(1 - greatest(least(p, 1 - 1e-7), 1e-7)))) AS loss"""
CM2 = """SELECT {g} tp, fp, tn, fn, n, round(loss, 6) AS loss, round((tp + tn) / CAST(n AS DOUBLE), 6) AS accuracy, round(tp / CAST(greatest(tp + fp, 1) AS DOUBLE), 6) AS precision, round(tp / CAST(greatest(tp + fn, 1) AS DOUBLE), 6) AS recall,
round(tn / CAST(greatest(tn + fp, 1) AS DOUBLE), 6) AS specificity, round(2.0 * tp / greatest(2.0 * tp + fp + fn, 1), 6) AS f1, round(fp / (n * 5.0 / 3600.0), 6) AS false_alarms_per_hour FROM m"""
CM_COLUMNS = ("tp", "fp", "tn", "fn", "n", "loss", "accuracy", "precision", "recall", "specificity", "f1", "false_alarms_per_hour")


@query("confusion_metrics", sql(*W, f", m AS (SELECT {CM} FROM (SELECT *, p >= 0.25 AS hot FROM w)) " + CM2.format(g="")))
def _(spark, sf):
    return rounded(metrics.confusion_metrics(scored(spark, sf), "p", "label", HOT).select(*CM_COLUMNS), *CM_COLUMNS[5:])


@query("threshold_grid", sql(*W, f", m AS (SELECT name, {CM} FROM (SELECT w.*, t.name, p >= t.t AS hot FROM w, (VALUES ('low', 0.1), ('mid', 0.3), ('high', 0.5)) t(name, t)) GROUP BY name) " + CM2.format(g="name,")))
def _(spark, sf):
    return rounded(metrics.over_thresholds(scored(spark, sf), {"low": 0.1, "mid": 0.3, "high": 0.5}, "name", "p", "label").select("name", *CM_COLUMNS), *CM_COLUMNS[5:])


@query("roc_auc", sql(*W, "c", ", b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c) SELECT round(CAST(sum(pos * (below + 0.5 * neg)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 6) AS auc FROM b"))
def _(spark, sf):
    return rounded(ranking.roc_auc(ranking.score_counts(scored(spark, sf), "p", "label")), "auc")


@query("average_precision", sql(*W, "c", "r", "SELECT round(sum(CAST(pos AS DOUBLE) / CAST(np AS DOUBLE) * CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE)), 6) AS average_precision FROM r"))
def _(spark, sf):
    return rounded(ranking.average_precision(ranking.score_counts(scored(spark, sf), "p", "label")), "average_precision")


@query("roc_points", sql(*W, "c", "r", "SELECT s AS threshold, round(CAST(fp AS DOUBLE) / CAST(nn AS DOUBLE), 6) AS fpr, round(CAST(tp AS DOUBLE) / CAST(np AS DOUBLE), 6) AS tpr FROM r"))
def _(spark, sf):
    return rounded(ranking.roc_points(ranking.score_counts(scored(spark, sf), "p", "label")), "fpr", "tpr")


@query("pr_points", sql(*W, "c", "r", "SELECT s AS threshold, round(CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE), 6) AS precision, round(CAST(tp AS DOUBLE) / CAST(np AS DOUBLE), 6) AS recall FROM r"))
def _(spark, sf):
    return rounded(ranking.pr_points(ranking.score_counts(scored(spark, sf), "p", "label")), "precision", "recall")


@query("f1_threshold", sql(*W, "c", "r", """, y AS (SELECT s, CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) AS pr, CAST(tp AS DOUBLE) / CAST(np AS DOUBLE) AS re FROM r),
z AS (SELECT s, 2.0 * pr * re / (pr + re + 1e-8) AS f1 FROM y) SELECT s AS threshold, round(f1, 6) AS f1 FROM z ORDER BY z.f1 DESC, s LIMIT 1"""))
def _(spark, sf):
    return rounded(ranking.f1_threshold(ranking.score_counts(scored(spark, sf), "p", "label")), "f1")


@query("budget_thresholds", sql(*W, """, n AS (SELECT p, row_number() OVER (ORDER BY p DESC) AS rn, count(*) OVER () AS total FROM w WHERE label = 0), k AS (SELECT * FROM (VALUES (0.0, 0), (1.0, 20), (5.0, 100), (25.0, 500)) v(budget, k))
SELECT CAST(budget AS DOUBLE) AS budget, CAST(k.k AS BIGINT) AS k, CASE WHEN k.k <= 0 THEN (SELECT max(p) FROM n) WHEN k.k >= (SELECT count(*) FROM n) THEN (SELECT min(p) FROM n) ELSE (SELECT p FROM n WHERE rn = k.k) END AS threshold, k.k <= 0 AS strict FROM k"""))
def _(spark, sf):
    return ranking.budget_thresholds(ranking.score_counts(scored(spark, sf), "p", "label"), (0.0, 1.0, 5.0, 25.0), 20.0)


@query("top_share", sql(*W, """, o AS (SELECT label, row_number() OVER (ORDER BY p DESC, user_id, window_idx) AS rn, count(*) OVER () AS n, sum(label) OVER () AS np FROM w),
k AS (SELECT share, greatest(1, CAST(round_even((SELECT count(*) FROM w) * share, 0) AS BIGINT)) AS k FROM (VALUES (0.01), (0.05), (0.1)) v(share))
SELECT CAST(share AS DOUBLE) AS share, k, CAST(sum(label) AS BIGINT) AS captured, round(CAST(sum(label) AS DOUBLE) / k, 6) AS precision, round(CAST(sum(label) AS DOUBLE) / max(np), 6) AS recall FROM k JOIN o ON rn <= k GROUP BY share, k"""))
def _(spark, sf):
    w = scored(spark, sf).withColumn("tie", F.struct("user_id", "window_idx"))
    return rounded(ranking.top_share(w, "p", "label", "tie", (0.01, 0.05, 0.1)), "precision", "recall")


@query("event_hits", sql(*W, "hit", "SELECT * FROM hit"))
def _(spark, sf):
    return metrics.event_hits(scored(spark, sf), merged(spark, sf), KEY, "p", HOT)


WILSON = "round(greatest(0, ({p} + 3.8416 / (2.0 * {n})) / (1 + 3.8416 / {n}) - 1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4.0 * {n} * {n})) / (1 + 3.8416 / {n})), 6) AS ci95_low, round(least(1, ({p} + 3.8416 / (2.0 * {n})) / (1 + 3.8416 / {n}) + 1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4.0 * {n} * {n})) / (1 + 3.8416 / {n})), 6) AS ci95_high"


@query("event_metrics", sql(*W, "hit", """, a AS (SELECT count(*) AS event_count, count(*) FILTER (WHERE detected) AS detected_events, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE detected) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS q FROM hit)
SELECT event_count, detected_events, round(q, 6) AS event_sensitivity, """ + WILSON.format(p="q", n="n") + ", (SELECT count(*) FROM w WHERE p >= 0.25) AS positive_windows, (SELECT count(*) FROM w WHERE p >= 0.25 AND label = 1) AS true_positive_windows, (SELECT count(*) FROM w WHERE p >= 0.25 AND label = 0) AS false_positive_windows FROM a"))
def _(spark, sf):
    return rounded(metrics.event_metrics(scored(spark, sf), merged(spark, sf), KEY, "p", "label", HOT), "event_sensitivity", "ci95_low", "ci95_high")


@query("weighted_losses", sql(*W, """, y AS (SELECT label, p, -(label * ln(greatest(least(p, 1 - 1e-7), 1e-7)) + (1 - label) * ln(1 - greatest(least(p, 1 - 1e-7), 1e-7))) AS loss FROM w)
SELECT round(0.9 * avg(loss) FILTER (WHERE label = 1) + 0.1 * avg(loss) FILTER (WHERE label = 0), 6) AS sswce, round(avg(pow(1 - CASE WHEN label = 1 THEN p ELSE 1 - p END, 2) * loss), 6) AS focal FROM y"""))
def _(spark, sf):
    w = scored(spark, sf)
    a, b = metrics.sswce(w, "p", "label"), metrics.focal_loss(w, "p", "label")
    return rounded(a.withColumnRenamed("loss", "sswce").join(F.broadcast(b.withColumnRenamed("loss", "focal")), F.lit(True)), "sswce", "focal")


@query("text_length_auc", """WITH c AS (SELECT n_chars AS s, count(*) FILTER (WHERE quality = 1) AS pos, count(*) FILTER (WHERE quality = 0) AS neg FROM documents JOIN labels USING (doc_id) GROUP BY n_chars),
b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c) SELECT round(CAST(sum(pos * (below + 0.5 * neg)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 6) AS auc FROM b""")
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    return rounded(ranking.roc_auc(ranking.score_counts(d, "n_chars", "quality")), "auc")


# -- selection -----------------------------------------------------------------------------------


@query("fusion_grid", sql(*W, """, m AS (SELECT weight, count(*) FILTER (WHERE label = 1 AND q >= 0.25) AS tp, count(*) FILTER (WHERE label = 0 AND q >= 0.25) AS fp FROM (SELECT w.*, v.weight, (1 - v.weight) * p + v.weight * (p * p) AS q FROM w, (SELECT unnest([0.05, 0.1, 0.15, 0.2, 0.25, 0.35, 0.5, 0.75, 1.0])::DOUBLE AS weight) v) GROUP BY weight) SELECT * FROM m"""))
def _(spark, sf):
    w = scored(spark, sf).withColumn("p2", F.col("p") * F.col("p"))
    return selection.fusion_grid(w, "p", "p2", "label", HOT).select("weight", "tp", "fp")


@query("select_fusion", sql(*W, """, m AS (SELECT weight, count(*) FILTER (WHERE label = 1 AND q >= 0.25) AS tp, count(*) FILTER (WHERE label = 0 AND q >= 0.25) AS fp, count(*) FILTER (WHERE label = 0 AND q < 0.25) AS tn, count(*) FILTER (WHERE label = 1) AS np FROM (SELECT w.*, v.weight, (1 - v.weight) * p + v.weight * (p * p) AS q FROM w, (SELECT unnest([0.05, 0.1, 0.15, 0.2, 0.25, 0.35, 0.5, 0.75, 1.0])::DOUBLE AS weight) v) GROUP BY weight)
SELECT weight, tp, fp FROM m ORDER BY CAST(tp AS DOUBLE) / greatest(np, 1) DESC, (CAST(tp AS DOUBLE) / greatest(np, 1) + CAST(tn AS DOUBLE) / greatest(tn + fp, 1)) / 2 DESC, fp, weight LIMIT 1"""))
def _(spark, sf):
    w = scored(spark, sf).withColumn("p2", F.col("p") * F.col("p"))
    return selection.select_fusion(selection.fusion_grid(w, "p", "p2", "label", HOT)).select("weight", "tp", "fp")


SMOOTHING = """, sm AS (SELECT w.user_id, window_idx, start_s, end_s, label, 1 AS k, p AS s FROM w
  UNION ALL SELECT user_id, window_idx, start_s, end_s, label, 3, avg(p) OVER (PARTITION BY user_id ORDER BY window_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) FROM w
  UNION ALL SELECT user_id, window_idx, start_s, end_s, label, 5, avg(p) OVER (PARTITION BY user_id ORDER BY window_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) FROM w),
hours AS (SELECT count(*) * 5.0 / 3600.0 AS h FROM w),
ng AS (SELECT k, s, row_number() OVER (PARTITION BY k ORDER BY s DESC) AS rn, count(*) OVER (PARTITION BY k) AS n FROM sm WHERE label = 0),
th AS (SELECT k, max(s) FILTER (WHERE rn = least(n, CAST(floor({budget} * (SELECT h FROM hours)) AS BIGINT))) AS t FROM ng GROUP BY k),
ho AS (SELECT sm.*, t, s >= t - 1e-12 AS hot FROM sm JOIN th USING (k)),
cm AS (SELECT k, max(t) AS t, count(*) FILTER (WHERE hot AND label = 1) / CAST(greatest(count(*) FILTER (WHERE label = 1), 1) AS DOUBLE) AS recall, count(*) FILTER (WHERE NOT hot AND label = 0) / CAST(greatest(count(*) FILTER (WHERE label = 0), 1) AS DOUBLE) AS spec, count(*) FILTER (WHERE hot AND label = 0) AS fp FROM ho GROUP BY k),
de AS (SELECT k, count(*) AS detected FROM (SELECT DISTINCT k, ev.user_id, ev.event_index FROM ho JOIN ev ON ho.user_id = ev.user_id AND ev.start_s <= ho.end_s AND ev.end_s >= ho.start_s WHERE hot) GROUP BY k),
sc AS (SELECT k, s, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM sm GROUP BY k, s),
ra AS (SELECT k, pos, neg, coalesce(sum(neg) OVER (PARTITION BY k ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM sc),
au AS (SELECT k, CAST(sum(pos * (below + 0.5 * neg)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS auc FROM ra GROUP BY k),
al AS (SELECT cm.k, t, recall, (recall + spec) / 2 AS balanced, fp / (SELECT h FROM hours) AS fa, coalesce(detected, 0) AS detected, coalesce(detected, 0) / CAST(greatest((SELECT count(*) FROM ev), 1) AS DOUBLE) AS sens, auc FROM cm LEFT JOIN de USING (k) LEFT JOIN au USING (k))
SELECT CAST(k AS INTEGER) AS k, round(t, 6) AS threshold, CAST(detected AS BIGINT) AS detected_events, round(sens, 6) AS event_sensitivity, round(recall, 6) AS recall, round(balanced, 6) AS balanced_accuracy, round(fa, 4) AS false_alarms_per_hour,
 round(auc, 4) AS auc, round(200.0 * detected + 40.0 * sens + 20.0 * recall + 5.0 * balanced + coalesce(auc, 0) - 0.05 * fa, 3) AS value FROM al"""


def _smoothing(spark, sf):
    # six digits: a mean summed in another order may differ in the last place, which must not decide
    w = scored(spark, sf)
    g = selection.smoothing_grid(w, merged(spark, sf), KEY, "p", "label", 500.0, (1, 3, 5))
    g = rounded(g, "threshold", "event_sensitivity", "recall", "balanced_accuracy")
    return g.withColumns({"false_alarms_per_hour": F.round("false_alarms_per_hour", 4), "auc": F.round("auc", 4), "value": F.round("value", 3)})


@query("smoothing_grid", sql(*W, SMOOTHING.format(budget=500.0)))
def _(spark, sf):
    return _smoothing(spark, sf)


@query("select_smoothing", sql(*W, SMOOTHING.format(budget=500.0) + " ORDER BY value DESC, k LIMIT 1"))
def _(spark, sf):
    return selection.select_smoothing(_smoothing(spark, sf))


REFRACTORY = """, hot AS (SELECT user_id, window_idx, start_s, end_s, m.minutes, m.r FROM w, (VALUES (0.0, 0), (1.0, 12), (5.0, 60)) m(minutes, r) WHERE p >= 0.25),
nxt AS (SELECT a.minutes, a.user_id, a.window_idx, min(b.window_idx) AS nx FROM hot a LEFT JOIN hot b ON a.user_id = b.user_id AND a.minutes = b.minutes AND b.window_idx > a.window_idx + a.r GROUP BY 1, 2, 3),
al AS (SELECT minutes, user_id, min(window_idx) AS window_idx FROM hot GROUP BY 1, 2
  UNION ALL SELECT al.minutes, al.user_id, nxt.nx FROM al JOIN nxt ON al.minutes = nxt.minutes AND al.user_id = nxt.user_id AND al.window_idx = nxt.window_idx WHERE nxt.nx IS NOT NULL),
aw AS (SELECT hot.* FROM hot JOIN al USING (minutes, user_id, window_idx)),
hi AS (SELECT aw.minutes, aw.user_id, window_idx, event_index FROM aw JOIN ev ON aw.user_id = ev.user_id AND aw.start_s <= ev.end_s AND aw.end_s >= ev.start_s),
t AS (SELECT minutes, (SELECT count(*) FROM w) AS windows, count(*) AS alerts, (SELECT count(*) FROM ev) AS event_count, (SELECT count(DISTINCT (user_id, window_idx)) FROM hi WHERE hi.minutes = aw.minutes) AS true_alerts, (SELECT count(DISTINCT (user_id, event_index)) FROM hi WHERE hi.minutes = aw.minutes) AS detected_events FROM aw GROUP BY minutes),
u AS (SELECT *, alerts - true_alerts AS false_alerts, detected_events / CAST(greatest(event_count, 1) AS DOUBLE) AS sens, (alerts - true_alerts) / (windows * 5.0 / 3600.0) AS fa FROM t)
SELECT CAST(minutes AS DOUBLE) AS minutes, windows, alerts, event_count, true_alerts, detected_events, false_alerts, round(sens, 6) AS event_sensitivity, round(fa, 6) AS false_alerts_per_hour, round(100.0 * sens + detected_events - 0.2 * fa, 4) AS value FROM u"""


def _refractory(spark, sf):
    g = selection.refractory_grid(scored(spark, sf), merged(spark, sf), KEY, "p", HOT, (0.0, 1.0, 5.0))
    return rounded(g, "event_sensitivity", "false_alerts_per_hour").withColumn("value", F.round("value", 4))


@query("refractory_grid", rsql(*W, REFRACTORY))
def _(spark, sf):
    return _refractory(spark, sf)


@query("select_refractory", rsql(*W, REFRACTORY + " ORDER BY value DESC, minutes LIMIT 1"))
def _(spark, sf):
    return selection.select_refractory(_refractory(spark, sf))


RUNS = """runs AS (SELECT 'run_' || l_suppkey % 12 AS name, l_suppkey % 12 AS id, avg(l_discount) AS std_recall, avg(l_tax) AS pro_recall, CAST(count(*) % 7 AS INTEGER) AS std_events, CAST(count(*) % 5 AS INTEGER) AS pro_events,
avg(l_quantity) AS std_false_alarms_per_hour, avg(l_quantity) - 1 AS pro_false_alarms_per_hour, avg(l_discount) * 10 AS std_auc, avg(l_tax) * 20 AS pro_auc FROM lineitem GROUP BY 1, 2)"""
CTE["runs"] = RUNS


def runs(spark: SparkSession, sf: str) -> DataFrame:
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    k = F.col("l_suppkey") % 12
    return li.groupBy(F.concat(F.lit("run_"), k).alias("name"), k.alias("id")).agg(
        F.avg("l_discount").alias("std_recall"), F.avg("l_tax").alias("pro_recall"), (F.count(F.lit(1)) % 7).cast("int").alias("std_events"), (F.count(F.lit(1)) % 5).cast("int").alias("pro_events"),
        F.avg("l_quantity").alias("std_false_alarms_per_hour"), (F.avg("l_quantity") - 1).alias("pro_false_alarms_per_hour"), (F.avg("l_discount") * 10).alias("std_auc"), (F.avg("l_tax") * 20).alias("pro_auc"))


def rounded_runs(spark: SparkSession, sf: str) -> DataFrame:
    r = runs(spark, sf).withColumns({c: F.round(c, 9) for c in ("std_recall", "pro_recall", "std_auc", "pro_auc", "std_false_alarms_per_hour", "pro_false_alarms_per_hour")})
    # a run in four has no AUC
    nan = lambda c: F.when(F.col("id") % 4 == 3, float("nan")).otherwise(F.col(c))
    return r.withColumns({"std_auc": nan("std_auc"), "pro_auc": nan("pro_auc")}).withColumns({"std_pr_auc": F.col("std_auc") / 2, "pro_pr_auc": F.col("pro_auc") / 4})


CTE["rr"] = """rr AS (SELECT name, id, round(std_recall, 9) AS std_recall, round(pro_recall, 9) AS pro_recall, std_events, pro_events, round(std_false_alarms_per_hour, 9) AS std_fa, round(pro_false_alarms_per_hour, 9) AS pro_fa,
CASE WHEN id % 4 <> 3 THEN round(std_auc, 9) END AS std_auc, CASE WHEN id % 4 <> 3 THEN round(pro_auc, 9) END AS pro_auc, CASE WHEN id % 4 <> 3 THEN round(std_auc, 9) / 2 END AS std_pr, CASE WHEN id % 4 <> 3 THEN round(pro_auc, 9) / 4 END AS pro_pr FROM runs)"""


def _places(rows: DataFrame, key) -> DataFrame:
    return rows.select("name", F.row_number().over(Window.orderBy(*(k.desc_nulls_last() for k in key), "name")).alias("place"))


@query("experiment_ranking", sql("runs", "rr", """SELECT name, row_number() OVER (ORDER BY (std_events >= 3 AND std_recall > 0 AND std_fa <= 30) DESC, pro_events - std_events DESC, pro_recall - std_recall DESC, std_events DESC, std_recall DESC, std_fa, pro_auc DESC NULLS LAST, name) AS place FROM rr"""))
def _(spark, sf):
    return _places(rounded_runs(spark, sf), selection.product_key())


@query("archive_ranking", sql("runs", "rr", "SELECT name, row_number() OVER (ORDER BY pro_auc - std_auc DESC NULLS LAST, pro_pr DESC NULLS LAST, pro_recall DESC, pro_fa, name) AS place FROM rr"))
def _(spark, sf):
    return _places(rounded_runs(spark, sf), selection.archive_key())


@query("best_baseline", sql("runs", "rr", "SELECT name, std_events AS detected_events FROM rr ORDER BY std_events DESC, std_recall DESC, std_fa, std_auc DESC NULLS LAST, name LIMIT 1"))
def _(spark, sf):
    r = rounded_runs(spark, sf).select("name", F.col("std_events").alias("detected_events"), F.col("std_recall").alias("recall"), F.col("std_false_alarms_per_hour").alias("false_alarms_per_hour"), F.col("std_auc").alias("auc"))
    return selection.best_baseline(r).select("name", "detected_events")


@query("best_ablation", sql("runs", "rr", "SELECT name AS variant FROM rr WHERE name <> 'run_1' ORDER BY coalesce(pro_pr, -1) DESC, coalesce(pro_auc, -1) DESC, coalesce(pro_recall, -1) DESC, name LIMIT 1"))
def _(spark, sf):
    r = rounded_runs(spark, sf).select(F.col("name").alias("variant"), F.col("pro_pr_auc").alias("pr_auc"), F.col("pro_auc").alias("auc"), F.col("pro_recall").alias("f1"))
    return selection.best_ablation(r, "run_1").select("variant")


@query("allocation_ranking", sql("runs", "rr", """, g AS (SELECT *, round(std_events / 7.0, 9) AS se, round(pro_events / 5.0, 9) AS pe, round((std_recall + 1) / 2, 9) AS sb, round((pro_recall + 1) / 2, 9) AS pb FROM rr)
SELECT name, row_number() OVER (ORDER BY (pe - se >= 0) DESC, pe - se DESC, (pro_recall - std_recall >= 0) DESC, (pb - sb >= 0) DESC, pro_recall DESC, pro_recall - std_recall DESC, pb - sb DESC, pro_auc - std_auc DESC NULLS LAST, std_fa - pro_fa DESC, std_recall DESC, name) AS place FROM g"""))
def _(spark, sf):
    r = rounded_runs(spark, sf).withColumns({"std_event_sensitivity": F.round(F.col("std_events") / 7.0, 9), "pro_event_sensitivity": F.round(F.col("pro_events") / 5.0, 9), "std_balanced_accuracy": F.round((F.col("std_recall") + 1) / 2, 9), "pro_balanced_accuracy": F.round((F.col("pro_recall") + 1) / 2, 9)})
    return _places(r, selection.allocation_key())


@query("promotion", sql("runs", "rr", """SELECT name FROM rr ORDER BY (std_events >= 1 AND std_fa <= 40) DESC, (pro_events - std_events >= 0) DESC, pro_events - std_events DESC, (pro_recall - std_recall >= 0) DESC, pro_recall - std_recall DESC, (std_fa - pro_fa >= 0) DESC, std_fa - pro_fa DESC,
pro_auc - std_auc DESC NULLS LAST, pro_events DESC, pro_recall DESC, pro_fa, pro_auc DESC NULLS LAST, std_events DESC, std_recall DESC, std_fa, std_auc DESC NULLS LAST, pro_pr DESC NULLS LAST, std_pr DESC NULLS LAST, name LIMIT 1"""))
def _(spark, sf):
    return selection.best(rounded_runs(spark, sf), selection.promotion_key(), "name").select("name")


# -- resampling ----------------------------------------------------------------------------------


@query("downsample", sql("s", "x", "SELECT user_id, i // 2 AS i, round(avg(value), 6) AS value FROM x GROUP BY 1, 2 HAVING count(*) = 2"))
def _(spark, sf):
    return rounded(resample.downsample_mean(indexed(spark, sf), KEY, "value", 2), "value")


def _target(spark, sf, times: int):
    return resample.lengths(indexed(spark, sf), KEY).select("user_id", (F.col("n") * times + 5).alias("n"))


@query("hold", sql("s", "x", ", c AS (SELECT user_id, count(*) AS n FROM x GROUP BY 1), g AS (SELECT user_id, n, unnest(range(n * 8 + 5)) AS i FROM c) SELECT g.user_id, g.i, x.value FROM g JOIN x ON g.user_id = x.user_id AND x.i = least(g.i // 8, g.n - 1)"))
def _(spark, sf):
    return resample.hold(indexed(spark, sf).select("user_id", "i", "value"), KEY, "value", _target(spark, sf, 8), 8)


LERP = """, c AS (SELECT user_id, count(*) AS n FROM x GROUP BY 1), g AS (SELECT user_id, n, unnest(range(n * 4 + 5)) AS i FROM c), h AS (SELECT *, i / 4.0 AS z, greatest(0, least(CAST(floor(i / 4.0) AS BIGINT), n - 2)) AS lo FROM g)
SELECT h.user_id, h.i, round(coalesce(a.value + (b.value - a.value) * {part}, a.value), 6) AS value FROM h JOIN x a ON h.user_id = a.user_id AND a.i = h.lo LEFT JOIN x b ON h.user_id = b.user_id AND b.i = h.lo + 1"""


@query("interpolate_clamped", sql("s", "x", LERP.format(part="greatest(0, least(1, z - lo))")))
def _(spark, sf):
    return rounded(resample.interpolate(indexed(spark, sf).select("user_id", "i", "value"), KEY, "value", 1.0, _target(spark, sf, 4), 4.0), "value")


@query("interpolate_extrapolated", sql("s", "x", LERP.format(part="(z - lo)")))
def _(spark, sf):
    return rounded(resample.interpolate(indexed(spark, sf).select("user_id", "i", "value"), KEY, "value", 1.0, _target(spark, sf, 4), 4.0, extrapolate=True), "value")


@query("fill_gaps", sql("s", """, y AS (SELECT user_id, event_id, t_s, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM s)
SELECT user_id, event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t_s, event_id ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t_s, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS v FROM y"""))
def _(spark, sf):
    s = samples(spark, sf).withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    return resample.fill_gaps(s, KEY, ["t_s", "event_id"], "v").select("user_id", "event_id", "v")


# -- splits and samples --------------------------------------------------------------------------

SPLIT_SQL = """WITH p AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS stratum FROM customer), r AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS n, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || c_custkey), c_custkey) AS rn FROM p)
SELECT c_custkey, stratum, CASE WHEN rn <= {a} THEN '{x}' WHEN rn <= {b} THEN '{y}' ELSE 'train' END AS split FROM r"""


@query("patient_split", SPLIT_SQL.format(a="greatest(1, round_even(n * 0.2, 0))", x="test", b="greatest(1, round_even(n * 0.2, 0)) + greatest(1, round_even(n * 0.1, 0))", y="val"))
def _(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", (F.col("c_acctbal") < 0).alias("positive"))
    return splits.patient_split(c, "c_custkey", "positive")


@query("session_split", SPLIT_SQL.format(a="greatest(1, round_even(n * 0.25, 0))", x="val", b="0", y=""))
def _(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", (F.col("c_acctbal") < 0).alias("positive"))
    return splits.session_split(c, "c_custkey", "positive")


@query("select_sessions", """WITH p AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS y FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || c_custkey), c_custkey) AS rn FROM p)
SELECT c_custkey FROM r ORDER BY CASE WHEN rn > CASE WHEN y = 1 THEN 84 ELSE 36 END THEN 1 ELSE 0 END, y DESC, rn, c_custkey LIMIT 120""")
def _(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", (F.col("c_acctbal") < 0).alias("positive"))
    return splits.select_sessions(c, "c_custkey", "positive", 120).select("c_custkey")


@query("downsample_negatives", """WITH p AS (SELECT doc_id, toxic, sum(toxic) OVER () AS pos, count(*) OVER () - sum(toxic) OVER () AS neg FROM labels), r AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM p)
SELECT doc_id, toxic FROM r WHERE toxic = 1 OR rn <= greatest(1, least(neg, pos * 2, 600000 - pos))""")
def _(spark, sf):
    return splits.downsample_negatives(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "toxic", ["doc_id"], ratio=2.0)


@query("multi_horizon_subset", """WITH p AS (SELECT doc_id, greatest(toxic, 1 - quality) AS y FROM labels), r AS (SELECT *, count(*) FILTER (WHERE y = 1) OVER () AS pos, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM p)
SELECT doc_id FROM r WHERE CASE WHEN y = 1 THEN rn <= 150 ELSE rn <= 150 - pos END""")
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/labels.parquet").withColumn("bad", 1 - F.col("quality"))
    return splits.multi_horizon_subset(rows, ["toxic", "bad"], ["doc_id"], 150).select("doc_id")


@query("normal_sample", "SELECT doc_id FROM labels WHERE toxic = 0 ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def _(spark, sf):
    return splits.normal_sample(spark.read.parquet(f"{sf}/labels.parquet"), "toxic", ["doc_id"], 100).select("doc_id")


@query("experiment_grid", """WITH b AS (SELECT r_name AS base FROM region WHERE r_regionkey < 2)
SELECT base, 'robust_seed' || s || '_' || base AS name, s AS seed, CAST(300 AS DOUBLE) AS event_seconds FROM b, (VALUES (7), (42), (123)) v(s)
UNION ALL SELECT base, 'robust_label' || d || 's_' || base, 42, CAST(d AS DOUBLE) FROM b, (VALUES (120), (300), (600)) v(d)""")
def _(spark, sf):
    b = spark.read.parquet(f"{sf}/region.parquet").where("r_regionkey < 2").select(F.col("r_name").alias("base"))
    return splits.experiment_grid(b, (7, 42, 123), (120.0, 300.0, 600.0))


@query("class_weights", "SELECT quality, count(*) AS count, CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)) AS weight FROM labels GROUP BY quality")
def _(spark, sf):
    return splits.class_weights(spark.read.parquet(f"{sf}/labels.parquet"), "quality")


# -- summaries -----------------------------------------------------------------------------------


@query("health_rollup", """WITH o AS (SELECT o_custkey % 20 AS patient_id, o_orderkey % 7 <> 0 AS has_acc, o_orderkey % 11 <> 0 AS has_bvp, o_orderkey % 13 <> 0 AS has_hr, o_totalprice AS end_s FROM orders), v AS (SELECT *, has_acc AND has_bvp AS is_valid, has_acc AND has_bvp AND has_hr AS is_complete FROM o)
SELECT patient_id, count(*) AS sessions, count(*) FILTER (WHERE is_valid) AS valid, count(*) FILTER (WHERE is_complete) AS complete, round(sum(CASE WHEN is_valid THEN end_s / 3600.0 ELSE 0 END), 4) AS hours FROM v GROUP BY ROLLUP (patient_id)""")
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    has = lambda m: F.col("o_orderkey") % m != 0
    s = o.select((F.col("o_custkey") % 20).alias("patient_id"), has(7).alias("has_acc"), has(11).alias("has_bvp"), F.lit(True).alias("has_eda"), F.lit(True).alias("has_temp"), has(13).alias("has_hr"), F.lit(True).alias("has_ibi"), F.lit(0.0).alias("start_s"), F.col("o_totalprice").alias("end_s"))
    return summary.health_rollup(summary.session_flags(s)).withColumn("hours", F.round("hours", 4))


@query("rate_check", """WITH r AS (SELECT 'acc' AS sensor, 32.0 AS rate, 32.0 AS want FROM orders UNION ALL SELECT 'bvp', CASE WHEN o_orderkey % 2 = 0 THEN 64.0 ELSE 60.0 END, 64.0 FROM orders UNION ALL SELECT 'eda', CASE WHEN o_orderkey % 2 = 0 THEN 4.0 END, 4.0 FROM orders UNION ALL SELECT 'hr', NULL, 1.0 FROM orders)
SELECT sensor, list_sort(list(DISTINCT CAST(rate AS DOUBLE)))[1] AS least, CASE WHEN count(DISTINCT rate) = 1 AND min(rate) = min(want) THEN 'OK' ELSE 'WARN' END AS status FROM r WHERE rate IS NOT NULL GROUP BY sensor""")
def _(spark, sf):
    even = F.col("o_orderkey") % 2 == 0
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.lit(32.0).alias("acc_rate"), F.when(even, 64.0).otherwise(60.0).alias("bvp_rate"), F.when(even, 4.0).alias("eda_rate"), F.lit(None).cast("double").alias("hr_rate"))
    return summary.rate_check(o, {"acc": 32.0, "bvp": 64.0, "eda": 4.0, "hr": 1.0}).select("sensor", F.array_min("rates").alias("least"), "status")


@query("label_audit", """WITH s AS (SELECT user_id AS patient_id, event_id FROM events WHERE event_type = 'error'), p AS (SELECT DISTINCT user_id AS patient_id FROM events)
SELECT p.patient_id, count(event_id) AS label_rows, count(*) FILTER (WHERE event_id % 3 = 2) AS onset_only, count(*) FILTER (WHERE event_id % 3 = 1) AS duration_or_invalid, count(*) FILTER (WHERE event_id % 3 = 0) AS usable_offset, CAST(0 AS BIGINT) AS implausible_offset FROM p LEFT JOIN s ON p.patient_id = s.patient_id GROUP BY 1""")
def _(spark, sf):
    o = onsets(spark, sf).withColumnRenamed("user_id", "patient_id")
    return summary.label_audit(o, samples(spark, sf).select(F.col("user_id").alias("patient_id")))


@query("label_totals", """WITH s AS (SELECT user_id, event_id FROM events WHERE event_type = 'error')
SELECT count(DISTINCT user_id) AS patients, count(*) AS label_rows, count(*) FILTER (WHERE event_id % 3 = 2) AS onset_only, count(*) FILTER (WHERE event_id % 3 = 1) AS duration_or_invalid, count(*) FILTER (WHERE event_id % 3 = 0) AS usable_offset, CAST(0 AS BIGINT) AS implausible_offset FROM s""")
def _(spark, sf):
    return summary.label_totals(QUERIES["label_audit"](spark, sf))


@query("split_patients", sql("s", "d", "SELECT CASE WHEN user_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, user_id AS patient_id, count(*) AS sessions FROM d GROUP BY 1, 2"))
def _(spark, sf):
    return summary.split_patients(days(spark, sf).select(F.col("user_id").alias("patient_id"), F.col("day").alias("session_id"), F.when(F.col("user_id") % 5 == 0, "test").otherwise("train").alias("split")))


@query("split_composition", sql("s", "iv", "ev", "d", """, k AS (SELECT DISTINCT d.user_id, d.day, CASE WHEN d.user_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM d), j AS (SELECT k.*, ev.start_s, ev.end_s FROM k LEFT JOIN ev ON k.user_id = ev.user_id AND CAST(floor(ev.start_s / 86400.0) AS BIGINT) = k.day)
SELECT split, count(DISTINCT (user_id, day)) AS sessions, count(DISTINCT (user_id, day)) FILTER (WHERE start_s IS NOT NULL) AS positive_sessions, count(DISTINCT (round(start_s, 3), round(end_s, 3))) FILTER (WHERE start_s IS NOT NULL) AS episodes FROM j GROUP BY split"""))
def _(spark, sf):
    d = days(spark, sf).select(F.col("user_id").alias("patient_id"), F.col("day").alias("session_id"), F.when(F.col("user_id") % 5 == 0, "test").otherwise("train").alias("split"))
    e = merged(spark, sf).select(F.col("user_id").alias("patient_id"), F.floor(F.col("start_s") / 86400.0).cast("long").alias("session_id"), "start_s", "end_s")
    return summary.split_composition(d, e)


@query("label_counts", "SELECT CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS positives, round(100.0 * count(*) FILTER (WHERE toxic = 1) / count(*), 6) AS percent FROM labels GROUP BY 1")
def _(spark, sf):
    return rounded(summary.label_counts(spark.read.parquet(f"{sf}/labels.parquet").withColumn("split", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train")), "toxic"), "percent")


@query("feature_stats", "SELECT CAST(i - 1 AS INTEGER) AS channel, round(avg(x), 5) AS mean, round(stddev_pop(x) + 1e-8, 5) AS sd FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i")
def _(spark, sf):
    e = summary.feature_stats(spark.read.parquet(f"{sf}/embeddings.parquet"), "embedding")
    return e.select("channel", F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd"))


@query("session_zscore", sql("s", "SELECT user_id, event_id, round((value - avg(value) OVER (PARTITION BY user_id)) / (stddev_pop(value) OVER (PARTITION BY user_id) + 1e-8), 5) AS value FROM s"))
def _(spark, sf):
    z = summary.session_zscore(samples(spark, sf), KEY, ["value"])
    return z.select("user_id", "event_id", F.round("value", 5).alias("value"))


@query("group_mean_sd", "SELECT l_returnflag, count(*) AS runs, round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_samp(l_quantity), 6) AS l_quantity_sd, round(avg(l_tax), 6) AS l_tax_mean, round(stddev_samp(l_tax), 6) AS l_tax_sd FROM lineitem GROUP BY 1")
def _(spark, sf):
    return rounded(summary.group_mean_sd(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_returnflag", ["l_quantity", "l_tax"]), "l_quantity_mean", "l_quantity_sd", "l_tax_mean", "l_tax_sd")


@query("latency", "SELECT l_shipmode, count(*) AS runs, round(avg(ms), 6) AS mean_ms, round(quantile_cont(ms, 0.5), 6) AS p50_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms, min(ms) AS min_ms, max(ms) AS max_ms FROM (SELECT l_linestatus AS l_shipmode, l_extendedprice AS ms FROM lineitem) GROUP BY 1")
def _(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_linestatus").alias("l_shipmode"), "l_extendedprice")
    return rounded(summary.latency(li, ["l_shipmode"], "l_extendedprice"), "mean_ms", "p50_ms", "p95_ms")


@query("robustness_groups", "SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'seed' ELSE 'label' END AS family, n_name AS base FROM nation")
def _(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.concat(F.when(F.col("n_nationkey") % 2 == 0, "robust_seed42_").otherwise("robust_label300s_"), F.col("n_name")).alias("name"))
    return n.select(summary.robustness_group(F.col("name")).alias("g")).select("g.*")


@query("op_histogram", "SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    return summary.op_histogram(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_linestatus"], "l_returnflag")


@query("mc_summary", "SELECT l_orderkey, round(avg(l_tax), 6) AS mean, round(stddev_pop(l_tax), 6) AS sd, round(avg(l_tax) * (1 - stddev_pop(l_tax)), 6) AS confidence FROM lineitem GROUP BY 1")
def _(spark, sf):
    return rounded(summary.mc_summary(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_orderkey"], "l_tax"), "mean", "sd", "confidence")


@query("first_rows", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'error') WHERE rn <= 5")
def _(spark, sf):
    return summary.first_rows(samples(spark, sf).where("event_type = 'error'"), KEY, ["t_s", "event_id"], 5).select("user_id", "event_id")


# -- scalar functions ----------------------------------------------------------------------------


@query("scalars", """SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity * l_quantity + l_tax * l_tax + l_discount * l_discount), 6) AS length, CAST(greatest(-128, least(127, round(l_quantity / 0.3) + 3)) AS INTEGER) AS q8,
round((greatest(-128, least(127, round(l_quantity / 0.3) + 3)) - 3) * 0.3, 6) AS back, round(0.75 * l_tax + 0.25 * l_discount, 6) AS blended, round((l_quantity - 25.0) / 14.0, 6) AS z, CAST(round_even(l_quantity / 2.0, 0) AS BIGINT) AS even,
round(-ln(greatest(least(l_discount, 1 - 1e-7), 1e-7)), 6) AS loss, printf('%.2f', l_extendedprice) AS shown, CASE WHEN l_linenumber % 2 = 0 THEN l_tax ELSE 0 END AS masked FROM lineitem""")
def _(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    q8 = quantize_int8(F.col("l_quantity"), 0.3, 3)
    return li.select(
        "l_orderkey", "l_linenumber", F.round(magnitude(F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")), 6).alias("length"), q8.alias("q8"), F.round(dequantize_int8(q8, 0.3, 3), 6).alias("back"),
        F.round(blend(F.col("l_tax"), F.col("l_discount"), 0.25), 6).alias("blended"), F.round(zscore(F.col("l_quantity"), 25.0, 14.0), 6).alias("z"), bankers_round(F.col("l_quantity") / 2.0).cast("long").alias("even"),
        F.round(log_loss(F.lit(1), F.col("l_discount")), 6).alias("loss"), format_or_na(F.col("l_extendedprice"), 2).alias("shown"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax")).otherwise(0.0).alias("masked"))


@query("channel_mask", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS eda, CAST(0 AS DOUBLE) AS bvp, CAST(embedding[3] AS DOUBLE) AS temp FROM embeddings")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return e.select("vec_id", *channel_mask({"eda": at(0), "bvp": at(1), "temp": at(2)}, ["eda", "temp"]))


@query("text_fields", """SELECT o_orderkey, CAST(o_orderkey % 7 AS BIGINT) AS detected, CAST(7 AS BIGINT) AS total, CASE WHEN o_custkey % 2 = 0 THEN 'Mayo_' || o_custkey ELSE 'unknown' END AS patient, CASE WHEN o_orderkey >= 3600 THEN (o_orderkey // 3600) || 'h ' || lpad(CAST(o_orderkey % 3600 // 60 AS VARCHAR), 2, '0') || 'm ' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || 's' WHEN o_orderkey >= 60 THEN (o_orderkey // 60) || 'm ' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || 's' ELSE o_orderkey || 's' END AS elapsed FROM orders""")
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    f = parse_fraction(F.concat((F.col("o_orderkey") % 7).cast("string"), F.lit("/7")))
    path = F.concat(F.when(F.col("o_custkey") % 2 == 0, "/data/Mayo_").otherwise("/data/Other_"), F.col("o_custkey").cast("string"), F.lit("/x_1/ACC.csv"))
    return o.select("o_orderkey", f["detected"].alias("detected"), f["total"].alias("total"), patient_id(path).alias("patient"), format_elapsed(F.col("o_orderkey")).alias("elapsed"))


@query("wilson_interval", "WITH g AS (SELECT l_suppkey, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE l_returnflag = 'R') / CAST(count(*) AS DOUBLE) AS q FROM lineitem GROUP BY 1) SELECT l_suppkey, " + WILSON.format(p="q", n="n") + " FROM g")
def _(spark, sf):
    g = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count(F.lit(1)).alias("n"))
    return rounded(g.select("l_suppkey", wilson(F.col("k"), F.col("n")).alias("w")).select("l_suppkey", F.col("w.low").alias("ci95_low"), F.col("w.high").alias("ci95_high")), "ci95_low", "ci95_high")


@query("pooled_embeddings", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding), 5) AS mean, round(CAST(list_max(embedding) AS DOUBLE), 5) AS most, CAST(len(embedding) // 8 AS INTEGER) AS n_patches FROM embeddings")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").withColumns({"pool": windows.pooled(F.col("embedding")), "n_patches": F.size(windows.patches(F.col("embedding"), 8))})
    return e.select("vec_id", F.round("pool.mean", 5).alias("mean"), F.round("pool.most", 5).alias("most"), "n_patches")


@query("reconstruction_error", """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT i, avg(x) AS m FROM e WHERE label <= 0.5 GROUP BY i) SELECT vec_id, round(avg((x - m) * (x - m)), 5) AS error FROM e JOIN m USING (i) GROUP BY vec_id""")
def _(spark, sf):
    # label 0 is normal; every vector is rebuilt as the mean of the normal ones
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    model = LowRankScorer("embedding", 0).fit(splits.normal_sample(e, "label", ["vec_id"]))
    return model.score(e).select("vec_id", F.round("error", 5).alias("error"))


@query("low_rank_error")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    model = LowRankScorer("embedding", 8).fit(splits.normal_sample(e, "label", ["vec_id"]))
    return model.score(e).select("vec_id", "label", "error")


@query("interpolate_irregular", """WITH s AS (SELECT user_id, event_id, value, epoch_us(ts) / 1e6 AS t FROM events), p AS (SELECT u.user_id, 1704067200.0 + 21600 * k.k AS t FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest(range(120)) AS k) k),
a AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id, t ORDER BY event_id DESC) = 1), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id, t ORDER BY event_id) = 1),
pa AS (SELECT p.user_id, p.t, a.t AS ta, a.value AS va FROM p ASOF LEFT JOIN a ON p.user_id = a.user_id AND p.t >= a.t), pb AS (SELECT pa.*, b.t AS tb, b.value AS vb FROM pa ASOF LEFT JOIN b ON pa.user_id = b.user_id AND pa.t < b.t),
n AS (SELECT user_id, t, CASE WHEN t - ta <= 43200 THEN ta END AS ta, CASE WHEN t - ta <= 43200 THEN va END AS va, CASE WHEN tb - t <= 43200 THEN tb END AS tb, CASE WHEN tb - t <= 43200 THEN vb END AS vb FROM pb)
SELECT user_id, t AS t_s, round(CASE WHEN ta IS NOT NULL AND tb IS NOT NULL THEN va + (vb - va) * ((t - ta) / (tb - ta)) ELSE coalesce(va, vb) END, 5) AS value FROM n""")
def _(spark, sf):
    # a point every six hours; samples over twelve hours away are no neighbours
    s = samples(spark, sf)
    users = s.select("user_id").distinct()
    points = users.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(119))).alias("k")).select("user_id", (F.lit(1704067200.0) + 21600.0 * F.col("k")).alias("t_s"))
    return resample.interpolate_at(s, points, KEY, "t_s", "value", "event_id", 43_200.0).select("user_id", "t_s", F.round("value", 5).alias("value"))


# -- audits and figures --------------------------------------------------------------------------


@query("audit_checks", """WITH f AS (SELECT c_nationkey AS k, count(*) AS patients, avg(c_acctbal) AS bal FROM customer GROUP BY 1)
SELECT k, 'patients' AS "check", CASE WHEN patients >= 5 THEN 'pass' ELSE 'fail' END AS status FROM f UNION ALL SELECT k, 'balance', CASE WHEN bal > 4500 THEN 'pass' ELSE 'warn' END FROM f""")
def _(spark, sf):
    f = spark.read.parquet(f"{sf}/customer.parquet").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("patients"), F.avg("c_acctbal").alias("bal"))
    return audit.evaluate(f, [("patients", F.col("patients") >= 5, "fail"), ("balance", F.col("bal") > 4500, "warn")], ["k"])


@query("audit_overall", """WITH f AS (SELECT c_nationkey AS k, count(*) AS patients, avg(c_acctbal) AS bal FROM customer GROUP BY 1) SELECT k, CASE WHEN patients < 5 THEN 'fail' WHEN bal > 4500 THEN 'pass' ELSE 'warn' END AS status FROM f""")
def _(spark, sf):
    return audit.overall(QUERIES["audit_checks"](spark, sf), ["k"])


@query("missing_files", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 20 = 0) ORDER BY 1 LIMIT 10")
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 20 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return audit.missing_files(spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey"), o, ["c_custkey"])


@query("latest_runs", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)")
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.concat(F.date_format("o_orderdate", "yyyyMMdd_HHmmss"), F.lit("_run")).alias("name"))
    return audit.in_window_or_latest(o.withColumn("stamp", audit.run_stamp(F.col("name"))), "stamp", None, None).select("o_orderkey")


# Result documents: a nation is a run, its key decides what the document says.
_DOC = """d AS (SELECT n_nationkey AS k, n_nationkey % 4 AS a, n_nationkey % 3 AS b, n_nationkey % 5 AS c FROM nation)"""
CTE["docs"] = _DOC


def result_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as JSON files, one a run, and read back by the schema that the rules need."""
    k = F.col("n_nationkey")
    a, b, c = k % 4, k % 3, k % 5
    level = lambda x, ci: F.struct(F.lit(5).alias("event_count"), x.cast("long").alias("detected_events"), (x / 5.0).alias("event_sensitivity"), F.when(ci, 0.1).alias("event_sensitivity_ci95_low"), F.when(ci, 0.9).alias("event_sensitivity_ci95_high"))
    tier = lambda x, ci: F.struct((0.9 + x / 100.0).alias("accuracy"), F.lit(0.92).alias("all_normal_baseline_accuracy"), (0.5 + x / 10.0).alias("auc"), (x / 10.0).alias("recall"), F.when(c != 4, level(x, ci)).alias("event_level"))
    doc = F.struct(
        F.lit("v5").alias("pipeline_version"), F.when(a == 0, "running").otherwise("completed").alias("status"), F.when(b == 0, "random").otherwise(audit.HELD_OUT).alias("split_strategy"),
        F.when(c != 1, audit.SCOPE).alias("evaluation_scope"), F.when(c != 2, F.lit("A Prototype, not a clinically validated detector")).alias("claim_scope"),
        tier(a, b > 0).alias("standard_mode"), tier(c, a > 0).alias("pro_mode"), F.struct(F.when(a == 1, "test").otherwise("validation").alias("selection_split")).alias("product_allocation_selection"),
        F.when(c != 3, F.create_map(F.lit("name"), F.lit("x"))).alias("best_science_model"), F.create_map(F.lit("name"), F.lit("y")).alias("best_product_model"),
        F.when(b != 1, F.struct(F.when(b == 2, 10.0).alias("validation_alarm_budget"), F.when(a == 0, F.array(F.lit(1.0), F.lit(5.0))).alias("fixed_validation_alarm_budgets"))).alias("matched_false_alarm_operating_point"),
        F.struct(F.when(a == 2, " ").otherwise("onset plus duration").alias("offset_policy"), F.lit(300.0).alias("seizure_duration_seconds"), F.lit(0.0).alias("merge_gap_seconds"), F.lit(5.0).alias("detection_window_seconds"), F.lit(5.0).alias("detection_stride_seconds")).alias("label_policy"),
        F.struct(F.lit(False).alias("synthetic_signals")).alias("sensor_policy"), F.struct(F.lit(80).alias("selected_session_count")).alias("run_config"),
        F.struct((c == 0).alias("retrained_from_scratch_all_variants"), F.create_map(F.lit("v"), F.struct(F.concat(F.lit("/m/"), c).alias("checkpoint_path"), F.lit(True).alias("resumed_from_checkpoint"))).alias("variants")).alias("model_provenance"))
    folder = scratch(spark, "documents")
    writers.write_documents(spark.read.parquet(f"{sf}/nation.parquet").select(k.alias("k"), doc.alias("d")).select("k", "d.*"), folder, "k")
    read = archives.read_json(spark, folder, audit.DETECTION_SCHEMA)
    return read.withColumn("k", F.regexp_extract("file", r"/k=(\d+)/", 1).cast("int"))


_RULES = [
    ("detection_status", "a <> 0", "fail"), ("split_strategy", "b <> 0", "fail"), ("evaluation_scope", "c <> 1", "warn"), ("claim_scope_disclosed", "c <> 2", "warn"), ("raw_accuracy_not_primary", "0.92 >= greatest(0.9 + a / 100.0, 0.9 + c / 100.0)", "warn"),
    ("pro_signal_gain", "c >= a", "warn"), ("pro_event_sensitivity_gain", "c = 4 OR c >= a", "warn"), ("event_level_disclosed", "c <> 4", "warn"), ("checkpoint_provenance_disclosed", "true", "warn"), ("allocation_selected_on_validation", "a <> 1", "fail"),
    ("science_product_split_present", "c <> 3", "warn"), ("uncertainty_estimates", "c <> 4 AND b > 0 AND a > 0", "warn"), ("operating_point_documented", "b = 2 OR (b <> 1 AND a = 0)", "warn"), ("label_policy_documented", "a <> 2", "warn")]


@query("audit_detection", sql("docs", " UNION ALL ".join(f"""SELECT CAST(k AS INTEGER) AS k, '{name}' AS "check", CASE WHEN {good} THEN 'pass' ELSE '{bad}' END AS status FROM d""" for name, good, bad in _RULES)))
def _(spark, sf):
    return audit.evaluate(result_documents(spark, sf), audit.detection_rules(), ["k"])


@query("valid_results", sql("docs", "SELECT CAST(k AS INTEGER) AS k, a <> 0 AND b = 2 AND c <> 3 AND c IN (0, 1, 2) AS valid FROM d"))
def _(spark, sf):
    known = F.array(F.lit("/m/1"), F.lit("/m/2"))
    return result_documents(spark, sf).select("k", audit.valid_detection("v5", 80, present=known).alias("valid"))


@query("valid_predictions", "SELECT n_nationkey AS k, n_nationkey % 4 <> 0 AND n_nationkey % 3 <> 0 AND n_nationkey % 5 <> 0 AS valid FROM nation")
def _(spark, sf):
    k = F.col("n_nationkey")
    measured = F.map_from_arrays(F.array(*(F.lit(str(h)) for h in (300, 900, 1800))), F.array(*(F.struct(F.lit("full_validation").alias("evaluation_split"), F.when((k % 3 == 0) & (h == 900), 7).otherwise(9).alias("n_val")) for h in (F.lit(300), F.lit(900), F.lit(1800)))))
    doc = F.struct(F.lit("v5").alias("pipeline_version"), F.lit("completed").alias("status"), F.lit(audit.HELD_OUT).alias("split_strategy"), F.array(F.lit("a"), F.lit("b")).alias("train_sessions"), F.when(k % 4 == 0, F.array(F.lit("c"), F.lit("d"))).otherwise(F.array(F.lit("c"))).alias("val_sessions"),
                   F.struct((k % 5 != 0).alias("final_metrics_use_full_validation"), F.struct(F.lit(9).alias("val_sequences")).alias("full_dataset_counts")).alias("dataset_usage"), measured.alias("metrics"))
    read = spark.read.parquet(f"{sf}/nation.parquet").select(k.alias("k"), F.from_json(F.to_json(doc), audit.PREDICTION_SCHEMA).alias("d")).select("k", "d.*")
    return read.select("k", audit.valid_prediction("v5", 3).alias("valid"))


_PREFLIGHT = [("patient_dirs", "n >= 5"), ("session_dirs", "n > 0"), ("complete_sensor_sessions", "rich > 0"), ("patient_label_files", "n = rich"), ("required_sensor_files", "n - rich = 0"), ("clean_generated_artifacts", "k % 2 = 0 OR k % 3 = 0"), ("edge_benchmark", "k % 5 <> 0")]


@query("preflight", "WITH i AS (SELECT c_nationkey AS k, count(*) AS n, count(*) FILTER (WHERE c_acctbal > 0) AS rich FROM customer GROUP BY 1) " + " UNION ALL ".join(f"""SELECT k, '{name}' AS "check", CASE WHEN {good} THEN 'pass' ELSE 'fail' END AS status FROM i""" for name, good in _PREFLIGHT))
def _(spark, sf):
    k = F.col("c_nationkey").alias("k")
    i = spark.read.parquet(f"{sf}/customer.parquet").groupBy(k).agg(F.count(F.lit(1)).alias("patients"), F.count_if(F.col("c_acctbal") > 0).alias("label_files"))
    i = i.withColumns({"sessions": F.col("patients"), "complete_sessions": F.col("label_files"), "incomplete_sessions": F.col("patients") - F.col("label_files"), "generated": F.col("k") % 3, "resume": F.col("k") % 2 == 0, "settings": F.create_map(F.lit("EDGE_BENCHMARK"), F.when(F.col("k") % 5 != 0, "1").otherwise("0"))})
    return audit.evaluate(i, audit.preflight_rules(settings={"EDGE_BENCHMARK": "1"}), ["k"])


@query("edge_checks", """WITH i AS (SELECT n_nationkey AS k, n_nationkey * 25.0 AS kb, n_nationkey % 3 AS t FROM nation)
SELECT k, 'standard_tflite_size' AS "check", CASE WHEN kb > 0 AND kb < 512 THEN 'pass' ELSE 'warn' END AS status FROM i UNION ALL SELECT k, 'standard_tflite_io_dtype_disclosed', CASE WHEN t < 2 THEN 'pass' ELSE 'warn' END FROM i""")
def _(spark, sf):
    k = F.col("n_nationkey")
    kinds = F.when(k % 3 == 0, F.array(F.lit("int8"), F.lit("int8"))).when(k % 3 == 1, F.array(F.lit("float32"))).otherwise(F.array(F.lit("int8"), F.lit("float32")))
    i = spark.read.parquet(f"{sf}/nation.parquet").select(k.alias("k"), (k * 25.0).alias("standard_size_kb"), kinds.alias("standard_inputs"), F.array(F.lit("int8")).alias("standard_outputs"))
    return audit.evaluate(i, audit.edge_rules(["standard"]), ["k"])


@query("unknown_names", "SELECT DISTINCT trim(n_name) || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE '?' END AS name FROM nation WHERE n_nationkey % 2 = 1")
def _(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    wanted = n.select(F.concat(F.lit(" "), "n_name", F.when(F.col("n_nationkey") % 2 == 0, "").otherwise("?")).alias("name")).unionByName(spark.range(1).select(F.lit("  ").alias("name")))
    return audit.unknown_names(wanted, n.select(F.col("n_name").alias("name")))


@query("known_rows", "SELECT n_name AS name, n_nationkey FROM nation WHERE n_nationkey % 4 = 0")
def _(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    return audit.known_rows(n.select(F.col("n_name").alias("name"), "n_nationkey"), n.where("n_nationkey % 4 = 0").select(F.concat("n_name", F.lit(" ")).alias("name")))


@query("run_status", """WITH r AS (SELECT o_orderkey, o_orderkey % 4 AS v, o_orderkey % 3 AS s, o_orderkey % 2 AS e, o_orderkey % 5 AS x FROM orders)
SELECT o_orderkey, CASE WHEN v = 0 THEN 'pipeline_version_mismatch' WHEN s = 1 AND e = 0 THEN 'completed' WHEN s = 1 THEN 'detection_completed' WHEN s = 2 THEN 'running' WHEN x = 0 AND e = 0 THEN 'completed' WHEN x = 0 THEN 'detection_completed' ELSE 'detection_failed' END AS status,
v <> 0 AND s = 2 AS is_current FROM r""")
def _(spark, sf):
    k = F.col("o_orderkey")
    r = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.when(k % 4 == 0, "v4").otherwise("v5").alias("pipeline_version"), F.when(k % 3 == 1, "detection_completed").when(k % 3 == 2, "running").alias("status"), F.when(k % 2 == 0, "completed").alias("edge_status"), (k % 5).alias("detection_exit_code"))
    done = audit.current(r.withColumn("status", F.when(F.col("status") == "running", "completed")), "v5").select("o_orderkey", F.lit(True).alias("is_current"))
    return r.select("o_orderkey", audit.run_status("v5").alias("status")).join(done, "o_orderkey", "left").fillna(False, ["is_current"])


@query("latest_by_modification", "SELECT o_custkey AS run, max(o_orderdate) AS modified, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS file FROM orders GROUP BY 1")
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("run"), F.col("o_orderdate").alias("modified"), F.col("o_orderkey").alias("file"))
    return audit.latest_by_modification(o, ["run"])


# -- sources and sinks: tables written as the files that a source reads -----------------------------

def sensor_files(spark: SparkSession, sf: str, spoilt: bool = False) -> str:
    """A folder of sensor files, one a user: start, rate, then a value and whether it is known; if ``spoilt``, values alone, of which a user in three has blank and broken ones.

    A file that must have numbers only has no word for null, so an unknown value is a NaN marked 0.
    """
    s = indexed(spark, sf)
    broken = (F.col("user_id") % 3 == 0) & (F.col("i") % 4 == 1)
    text, known = F.col("value").cast("string"), F.col("value").isNotNull().cast("int")
    if spoilt:
        line = F.when(broken, F.when(F.col("i") % 8 == 1, "").otherwise("NaN")).otherwise(F.coalesce(text, F.lit("")))
    else:
        line = F.concat_ws(",", F.coalesce(text, F.lit("NaN")), known)
    rows = s.select("user_id", "i", line.alias("value"))
    first = s.groupBy("user_id").agg(F.min("t_s").cast("string").alias("start"))
    head = first.select("user_id", F.posexplode(F.array("start", F.lit("4.0"))).alias("at", "value")).select("user_id", (F.col("at") - 2).cast("long").alias("i"), "value")
    folder = scratch(spark, "sensors")
    listing.write_lines(rows.unionByName(head).select(_file(), "i", "value"), ["i"], folder)
    return folder


def _file():
    return F.concat(F.lit("user_id="), F.coalesce(F.col("user_id").cast("string"), F.lit("null")), F.lit("/data.txt")).alias("path")


def _user(path: str = "path"):
    return F.regexp_extract(path, r"/user_id=(-?\d+|null)/", 1).try_cast("long").alias("user_id")


SENSORS = sql("s", "x", f"SELECT user_id, i AS sample_idx, value, min(t_s) OVER (PARTITION BY user_id) AS start_s, CAST(4 AS DOUBLE) AS rate_hz FROM x")


@query("read_sensors", SENSORS)
def _(spark, sf):
    r = sensors.read_sensors(spark, sensor_files(spark, sf), "fast", "*.txt")
    value = F.when(F.get("v", F.lit(1)) == 1, F.get("v", F.lit(0)))
    return r.select(_user(), "sample_idx", value.alias("value"), "start_s", "rate_hz")


@query("read_sensors_tolerant", sql("s", "x", f""", y AS (SELECT *, CASE WHEN user_id % 3 = 0 AND i % 4 = 1 THEN NULL ELSE value END AS v FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS j FROM y WHERE v IS NOT NULL) SELECT user_id, j AS sample_idx, v AS value FROM k"""))
def _(spark, sf):
    # lines of nothing but blanks and NaN are left out
    r = sensors.read_sensors(spark, sensor_files(spark, sf, spoilt=True), "tolerant", "*.txt")
    return r.select(_user(), "sample_idx", F.get("v", F.lit(0)).alias("value"))


@query("read_sensors_strict", sql("s", "x", f"SELECT user_id, count(*) AS n FROM x GROUP BY 1 HAVING count(*) >= 1"))
def _(spark, sf):
    return sensors.read_sensors(spark, sensor_files(spark, sf), "strict", "*.txt").groupBy(_user()).agg(F.count(F.lit(1)).alias("n"))


@query("probe_sensors", sql("s", f"SELECT user_id, min(t_s) AS start_s, CAST(4 AS DOUBLE) AS rate_hz, count(*) AS n FROM s GROUP BY 1"))
def _(spark, sf):
    return sensors.probe_sensors(spark, sensor_files(spark, sf), "*.txt", count_rows=True).select(_user(), "start_s", "rate_hz", "n")


@query("read_labels", sql("s", "SELECT user_id, t_s AS onset_s, CASE WHEN event_id % 3 = 0 THEN t_s + 900 WHEN event_id % 3 = 1 THEN t_s - 1 END AS second_s FROM s WHERE event_type = 'error'"))
def _(spark, sf):
    o = onsets(spark, sf).select("user_id", F.concat_ws(", ", F.col("onset_s").cast("string"), F.col("second_s").cast("string")).alias("value"))
    folder = scratch(spark, "label-files")
    listing.write_lines(o.unionByName(o.select("user_id", F.lit("# a comment").alias("value")).distinct()).select(_file(), "value"), ["value"], folder)
    return labels.read_labels(spark, folder).select(_user(), "onset_s", "second_s")


def data_folder(spark: SparkSession, files: DataFrame, name: str) -> str:
    """A folder in the shared one with a file of one line for each ``path``; tasks make the files."""
    folder = scratch(spark, name)
    listing.write_lines(files.select("path", F.lit("0").alias("value")), [], folder)  # Spark passes over files without any bytes
    return folder


@query("list_sessions", "SELECT 'Mayo_' || c_custkey % 9 AS patient_id, (1000 + c_custkey) || '_dev' AS session_id, c_custkey % 2 = 0 AS has_hr, c_custkey % 3 <> 0 AS is_valid FROM customer")
def _(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.explode(F.array(*map(F.lit, ("ACC", "BVP", "EDA", "TEMP", "HR")))).alias("sensor"))
    c = c.where("not (sensor = 'TEMP' and c_custkey % 3 = 0) and not (sensor = 'HR' and c_custkey % 2 = 1)")
    path = F.concat(F.lit("Mayo_"), F.col("c_custkey") % 9, F.lit("/sessions/"), 1000 + F.col("c_custkey"), F.lit("_dev/"), "sensor", F.lit(".csv"))
    return sensors.list_sessions(spark, data_folder(spark, c.select(path.alias("path")), "sessions")).select("patient_id", "session_id", "has_hr", "is_valid")


@query("find_label_files", "SELECT 'Mayo_' || s_nationkey AS patient_id, CASE WHEN min(s_suppkey) FILTER (WHERE s_suppkey % 2 = 0) IS NULL THEN 'sessions/' ELSE '' END || 'times' || lpad(CAST(coalesce(min(s_suppkey) FILTER (WHERE s_suppkey % 2 = 0), min(s_suppkey)) AS VARCHAR), 9, '0') || '.txt' AS file FROM supplier GROUP BY s_nationkey")
def _(spark, sf):
    # a patient's files lie in its folder or one deeper, beside files that are no labels
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    home = F.concat(F.lit("Mayo_"), F.col("s_nationkey"), F.lit("/"))
    at = F.when(F.col("s_suppkey") % 2 == 0, "").otherwise("sessions/")
    name = F.concat(F.lit("times"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.lit(".txt"))
    files = s.select(F.explode(F.array(F.concat(home, at, name), F.concat(home, F.lit("a_ReadMe.txt")), F.concat(home, F.lit("Info.txt")), F.concat(home, F.lit("a.csv")))).alias("path")).distinct()
    found = labels.find_label_files(spark, data_folder(spark, files, "label-folders"))
    return found.select("patient_id", F.regexp_extract("path", r"/Mayo_\d+/(.*)$", 1).alias("file"))


@query("runs_between", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-10' AND TIMESTAMP '1996-02-10'")
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    return audit.in_window_or_latest(o, "at", "1995-01-10 00:00:00", "1996-02-10 00:00:00").select("o_orderkey")


@query("markdown_report", "SELECT r_regionkey + 2 AS line, '| ' || r_name || ' | ' || printf('%.4f', CAST(avg(n_nationkey) AS DOUBLE)) || ' |' AS value FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
def _(spark, sf):
    # the report's lines below its head, read back from a file
    r, n = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("region", "nation"))
    report = r.join(n, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", F.col("r_name").alias("region")).agg(F.avg("n_nationkey").cast("double").alias("mean"))
    lines = writers.markdown(report.orderBy("r_regionkey").select("region", "mean")).splitlines()
    return spark.range(len(lines), numPartitions=1).select(F.col("id").alias("line"), F.get(F.array(*map(F.lit, lines)), F.col("id").cast("int")).alias("value")).where("line >= 2")


@query("position_join", sql("s", "x", "SELECT a.user_id, a.i, a.value AS one, b.p AS other FROM x a JOIN x b ON a.user_id = b.user_id AND a.i = b.i WHERE a.event_type <> 'click'"))
def _(spark, sf):
    # two tables of a session's values, joined by their positions
    one, other = indexed(spark, sf).where("event_type <> 'click'").select("user_id", "i", F.col("value").alias("one")), indexed(spark, sf).select("user_id", "i", F.col("p").alias("other"))
    return one.join(other, ["user_id", "i"])


@query("prediction_csv", sql(*W, "SELECT CAST(label AS INTEGER) AS y_true, p AS y_prob, CASE WHEN p >= 0.25 THEN 1 ELSE 0 END AS y_pred FROM w"))
def _(spark, sf):
    folder = scratch(spark, "predictions")
    writers.write_csv(scored(spark, sf).select(F.col("label").cast("int").alias("y_true"), F.col("p").alias("y_prob"), (F.col("p") >= HOT).cast("int").alias("y_pred")), folder)
    return archives.read_predictions(spark, folder)


@query("log_windows", "SELECT r_regionkey AS run, CASE WHEN r_regionkey % 2 = 0 THEN TIMESTAMP '2026-07-01 10:00:00' + r_regionkey * INTERVAL 1 HOUR END AS \"start\", TIMESTAMP '2026-07-03 00:30:00' + r_regionkey * INTERVAL 1 HOUR AS \"end\" FROM region")
def _(spark, sf):
    k = F.col("r_regionkey")
    r = spark.read.parquet(f"{sf}/region.parquet")
    at = lambda day: F.date_format(F.lit(day).cast("timestamp") + F.make_interval(hours=k.cast("int")), "yyyy-MM-dd'T'HH:mm:ss")
    start = F.when(k % 2 == 0, F.concat(F.lit("START TSMIXER "), at("2026-07-01 10:00:00"))).otherwise("START TSMIXER soon")
    lines = r.select(k.alias("run"), F.explode(F.array(F.lit("noise"), start, F.concat(F.lit("END TSMIXER exit=0 "), at("2026-07-03 00:30:00")))).alias("value"))
    folder = scratch(spark, "logs")
    lines.repartition(1, "run").write.partitionBy("run").text(folder)
    w = audit.status_windows(archives.read_log(spark, folder, "*.txt"), "TSMIXER")
    return w.select(F.regexp_extract("file", r"/run=(\d+)/", 1).cast("int").alias("run"), F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"))


@query("cached_table", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def _(spark, sf):
    build = lambda: spark.read.parquet(f"{sf}/nation.parquet").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    folder, config, inputs = scratch(spark, "cache"), {"table": "nation", "version": 1}, [f"{sf}/nation.parquet"]
    writers.cached(spark, folder, config, build, inputs)
    return writers.cached(spark, folder, config, lambda: build().where("false"), inputs)  # found, so not built again


# -- what remains of the smaller operators ----------------------------------------------------------


@query("false_alarm_rate", sql(*W, "SELECT user_id, round(CAST(count(*) FILTER (WHERE label = 0 AND p >= 0.25) AS DOUBLE) / (count(*) * 5.0 / 3600.0), 5) AS rate FROM w GROUP BY 1"))
def _(spark, sf):
    hours = F.count(F.lit(1)) * 5.0 / 3600.0
    return scored(spark, sf).groupBy("user_id").agg(F.round(metrics.false_alarm_rate("p", "label", HOT, hours), 5).alias("rate"))


@query("tensor_bytes", "SELECT l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT) * l_linenumber * CASE WHEN l_linenumber % 2 = 0 THEN 4 ELSE 1 END) AS BIGINT) AS bytes FROM lineitem GROUP BY 1")
def _(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    one = summary.tensor_bytes(F.array(F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")), F.when(F.col("l_linenumber") % 2 == 0, 4).otherwise(1))
    return li.groupBy("l_linestatus").agg(F.sum(one).alias("bytes"))


@query("select_sessions_half", """WITH p AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS y FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || c_custkey), c_custkey) AS rn FROM p)
SELECT c_custkey FROM r ORDER BY CASE WHEN rn > 20 THEN 1 ELSE 0 END, y DESC, rn, c_custkey LIMIT 40""")
def _(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", (F.col("c_acctbal") < 0).alias("positive"))
    return splits.select_sessions(c, "c_custkey", "positive", 40, share=0.5).select("c_custkey")


@query("positive_first", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal < 0 DESC, c_name) - 1 AS place FROM customer")
def _(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_name", (F.col("c_acctbal") < 0).alias("positive"))
    return splits.positive_first(c, "positive", "c_name").select("c_custkey", "place")


@query("paired_gain", sql("runs", "rr", "SELECT name, round(pro_auc - std_auc, 6) AS auc_gain, round(pro_recall - std_recall, 6) AS recall_gain FROM rr"))
def _(spark, sf):
    r = rounded_runs(spark, sf)
    return r.select("name", F.round(summary.paired_gain("std_auc", "pro_auc"), 6).alias("auc_gain"), F.round(summary.paired_gain("std_recall", "pro_recall"), 6).alias("recall_gain"))


@query("select_channels", "SELECT vec_id, round(CAST(embedding[3] AS DOUBLE), 6) AS temp, round(CAST(embedding[1] AS DOUBLE), 6) AS eda FROM embeddings")
def _(spark, sf):
    wanted = feature_names(" temp, ,eda ")
    e = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("v", select_channels(F.col("embedding"), ("EDA", "BVP", "TEMP"), wanted))
    return e.select("vec_id", *(F.round(F.get("v", F.lit(i)).cast("double"), 6).alias(n.lower()) for i, n in enumerate(wanted)))


@query("confusion_matrix", sql(*W, """, m AS (SELECT count(*) FILTER (WHERE label = 1 AND p >= 0.25) AS tp, count(*) FILTER (WHERE label = 0 AND p >= 0.25) AS fp, count(*) FILTER (WHERE label = 0 AND p < 0.25) AS tn, count(*) FILTER (WHERE label = 1 AND p < 0.25) AS fn FROM w)
SELECT 'normal' AS truth, 'normal' AS guess, tn AS n, round(CAST(tn AS DOUBLE) / (tn + fp), 6) AS share FROM m UNION ALL SELECT 'normal', 'event', fp, round(CAST(fp AS DOUBLE) / (tn + fp), 6) FROM m UNION ALL SELECT 'event', 'normal', fn, round(CAST(fn AS DOUBLE) / (tp + fn), 6) FROM m UNION ALL SELECT 'event', 'event', tp, round(CAST(tp AS DOUBLE) / (tp + fn), 6) FROM m"""))
def _(spark, sf):
    m = metrics.confusion_metrics(scored(spark, sf), "p", "label", HOT).select(F.lit(1).alias("model"), "tp", "fp", "tn", "fn")
    return rounded(figures.confusion_matrix(m, ["model"]).drop("model"), "share")


@query("timeline", sql(*W, "SELECT user_id, window_idx, CASE WHEN p >= 0.25 AND label = 1 THEN 'tp' WHEN p >= 0.25 THEN 'fp' WHEN label = 1 THEN 'fn' ELSE 'tn' END AS outcome FROM w"))
def _(spark, sf):
    return figures.timeline(scored(spark, sf), KEY, "p", "label", HOT)


@query("missed_events", sql(*W, "hit", "SELECT user_id, count(*) AS missed, max(max_score) AS best_score FROM hit WHERE NOT detected GROUP BY 1"))
def _(spark, sf):
    return figures.missed_events(metrics.event_hits(scored(spark, sf), merged(spark, sf), KEY, "p", HOT), KEY)


@query("side_by_side", "SELECT a.l_linestatus, a.q AS std_q, b.q AS pro_q, b.q - a.q AS gain_q FROM (SELECT l_linestatus, sum(l_quantity) AS q FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) a JOIN (SELECT l_linestatus, sum(l_quantity) AS q FROM lineitem WHERE l_linenumber = 2 GROUP BY 1) b ON a.l_linestatus = b.l_linestatus")
def _(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    part = lambda k: li.where(F.col("l_linenumber") == k).groupBy("l_linestatus").agg(F.sum("l_quantity").alias("q"))
    return figures.side_by_side(part(1), part(2), ["l_linestatus"], ["q"])


@query("figure_bars", sql("runs", "rr", "SELECT name, 'std_recall' AS metric, std_recall AS value FROM rr UNION ALL SELECT name, 'pro_recall', pro_recall FROM rr"))
def _(spark, sf):
    return figures.unpivot(rounded_runs(spark, sf), ["name"], ["std_recall", "pro_recall"])


@query("ablation_gains", sql("runs", "rr", "SELECT a.name, round(a.pro_recall - b.pro_recall, 6) AS pro_recall_gain, a.pro_events - b.pro_events AS pro_events_gain FROM rr a, (SELECT * FROM rr WHERE name = 'run_1') b WHERE a.name <> 'run_1'"))
def _(spark, sf):
    return rounded(figures.gains_over(rounded_runs(spark, sf), "name", "run_1", ["pro_recall", "pro_events"]), "pro_recall_gain")


ALLOCATIONS = (("bare", "run_1", "run_9"), ("eda", "run_2", "run_9"), ("temp", "run_3", "run_9"), ("both", "run_4", "run_9"))


@query("allocation_pairs", sql("runs", "rr", f""", p(allocation, s, e) AS (VALUES {", ".join(map(str, ALLOCATIONS))})
SELECT allocation, a.std_recall AS std_recall, b.std_recall AS pro_recall, round(b.std_recall - a.std_recall, 6) AS gain_recall FROM p JOIN rr a ON a.name = p.s JOIN rr b ON b.name = p.e"""))
def _(spark, sf):
    r = rounded_runs(spark, sf).select("name", F.col("std_recall").alias("recall"))
    return rounded(figures.paired_allocations(r, "name", ALLOCATIONS, ["recall"]), "gain_recall")


@query("kpi_row", sql(*W, "hit", """SELECT (SELECT count(*) FROM w) AS windows, count(*) AS events, round(count(*) FILTER (WHERE detected) / CAST(count(*) AS DOUBLE), 6) AS event_sensitivity, round((SELECT count(*) FROM w WHERE label = 0 AND p >= 0.25) / ((SELECT count(*) FROM w) * 5.0 / 3600.0), 4) AS false_alarms_per_hour FROM hit"""))
def _(spark, sf):
    w, ev = scored(spark, sf), merged(spark, sf)
    k = figures.kpis(metrics.confusion_metrics(w, "p", "label", HOT), metrics.event_metrics(w, ev, KEY, "p", "label", HOT))
    return k.select("windows", "events", F.round("event_sensitivity", 6).alias("event_sensitivity"), F.round("false_alarms_per_hour", 4).alias("false_alarms_per_hour"))


# -- plans, streams, kernels ---------------------------------------------------------------------


BUDGETS = """, us AS (SELECT user_id, max(label) AS stratum FROM w GROUP BY user_id),
ur AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS n, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || user_id), user_id) AS rn FROM us),
sp AS (SELECT user_id, CASE WHEN rn <= greatest(1, round_even(n * 0.2, 0)) THEN 'test' WHEN rn <= greatest(1, round_even(n * 0.2, 0)) + greatest(1, round_even(n * 0.1, 0)) THEN 'val' ELSE 'train' END AS split FROM ur),
va AS (SELECT w.* FROM w JOIN sp USING (user_id) WHERE split = 'val'), te AS (SELECT w.* FROM w JOIN sp USING (user_id) WHERE split = 'test'), tv AS (SELECT ev.* FROM ev JOIN sp USING (user_id) WHERE split = 'test'),
ng AS (SELECT p, row_number() OVER (ORDER BY p DESC) AS rn FROM va WHERE label = 0),
bu AS (SELECT CAST(b AS DOUBLE) AS budget, CAST(floor(b * (SELECT count(*) FROM va) * 5.0 / 3600.0) AS BIGINT) AS k FROM (VALUES (1.0), (5.0), (10.0), (25.0), (50.0)) v(b)),
th AS (SELECT budget, k, CASE WHEN k = 0 THEN (SELECT max(p) FROM ng) WHEN k >= (SELECT count(*) FROM ng) THEN (SELECT min(p) FROM ng) ELSE (SELECT p FROM ng WHERE rn = k) END AS t FROM bu),
ho AS (SELECT te.*, budget, t, CASE WHEN k = 0 THEN p > t ELSE p >= t END AS hot FROM te, th),
cm AS (SELECT budget, max(t) AS t, count(*) FILTER (WHERE label = 1 AND hot) AS tp, count(*) FILTER (WHERE label = 0 AND hot) AS fp, count(*) FILTER (WHERE label = 0 AND NOT hot) AS tn, count(*) FILTER (WHERE label = 1 AND NOT hot) AS fn, count(*) AS n FROM ho GROUP BY budget),
de AS (SELECT budget, count(DISTINCT (ho.user_id, event_index)) AS d FROM ho JOIN tv ON ho.user_id = tv.user_id AND tv.start_s <= ho.end_s AND tv.end_s >= ho.start_s WHERE hot GROUP BY budget),
hh AS (SELECT budget, user_id, window_idx, start_s, end_s FROM ho WHERE hot),
nxt AS (SELECT a.budget, a.user_id, a.window_idx, min(b.window_idx) AS nx FROM hh a LEFT JOIN hh b ON a.user_id = b.user_id AND a.budget = b.budget AND b.window_idx > a.window_idx + 12 GROUP BY 1, 2, 3),
al AS (SELECT budget, user_id, min(window_idx) AS window_idx FROM hh GROUP BY 1, 2 UNION ALL SELECT al.budget, al.user_id, nxt.nx FROM al JOIN nxt ON al.budget = nxt.budget AND al.user_id = nxt.user_id AND al.window_idx = nxt.window_idx WHERE nxt.nx IS NOT NULL),
aw AS (SELECT hh.* FROM hh JOIN al USING (budget, user_id, window_idx)),
ac AS (SELECT budget, count(*) AS alerts FROM aw GROUP BY budget),
ah AS (SELECT budget, count(DISTINCT (aw.user_id, window_idx)) AS good, count(DISTINCT (aw.user_id, event_index)) AS d FROM aw JOIN tv ON aw.user_id = tv.user_id AND aw.start_s <= tv.end_s AND aw.end_s >= tv.start_s GROUP BY budget)
SELECT cm.budget, round(t, 6) AS threshold, tp, fp, tn, fn, n, (SELECT count(*) FROM tv) AS event_count, coalesce(de.d, 0) AS detected_events, round(coalesce(de.d, 0) / CAST(greatest((SELECT count(*) FROM tv), 1) AS DOUBLE), 6) AS event_sensitivity, round(fp / (n * 5.0 / 3600.0), 4) AS false_alarms_per_hour,
 coalesce(alerts, 0) AS alerts, coalesce(good, 0) AS true_alerts, coalesce(alerts, 0) - coalesce(good, 0) AS false_alerts, coalesce(ah.d, 0) AS alert_detected_events, round((coalesce(alerts, 0) - coalesce(good, 0)) / (n * 5.0 / 3600.0), 4) AS false_alerts_per_hour
FROM cm LEFT JOIN de USING (budget) LEFT JOIN ac USING (budget) LEFT JOIN ah USING (budget)"""


@query("budget_report", rsql(*W, BUDGETS))
def _(spark, sf):
    w, ev = scored(spark, sf), merged(spark, sf)
    users = splits.patient_split(w.select("user_id", "label"), "user_id", "label")
    of = lambda rows, part: rows.join(users.where(F.col("split") == part).hint("merge"), KEY, "left_semi")
    r = detection.budget_report(of(w, "val"), of(w, "test"), of(ev, "test"), KEY, refractory_minutes=1.0)
    r = r.select("budget", F.round("threshold", 6).alias("threshold"), "tp", "fp", "tn", "fn", "n", "event_count", "detected_events", F.round("event_sensitivity", 6).alias("event_sensitivity"), F.round("false_alarms_per_hour", 4).alias("false_alarms_per_hour"),
                 "alerts", "true_alerts", "false_alerts", "alert_detected_events", F.round("false_alerts_per_hour", 4).alias("false_alerts_per_hour"))
    return r


HORIZONS = """, hz AS (SELECT 300 AS horizon, user_id, seq_idx, CASE WHEN state_300 = 1 THEN 1 ELSE 0 END AS y FROM st WHERE NOT (state_300 IN (2, 3) OR state_900 IN (2, 3) OR state_1800 IN (2, 3))
  UNION ALL SELECT 1800, user_id, seq_idx, CASE WHEN state_1800 = 1 THEN 1 ELSE 0 END FROM st WHERE NOT (state_300 IN (2, 3) OR state_900 IN (2, 3) OR state_1800 IN (2, 3))),
hp AS (SELECT *, ((user_id * 31 + seq_idx * 17) % 97) / 97.0 AS p FROM hz),
hc AS (SELECT horizon, p AS s, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM hp GROUP BY 1, 2),
hr AS (SELECT *, sum(pos) OVER (PARTITION BY horizon ORDER BY s DESC) AS tp, sum(neg) OVER (PARTITION BY horizon ORDER BY s DESC) AS fp, sum(pos) OVER (PARTITION BY horizon) AS np, sum(neg) OVER (PARTITION BY horizon) AS nn FROM hc),
ha AS (SELECT horizon, sum(CAST(pos AS DOUBLE) * (nn - fp + 0.5 * neg)) / nullif(CAST(max(np) AS DOUBLE) * CAST(max(nn) AS DOUBLE), 0) AS auc, CASE WHEN max(np) > 0 AND max(nn) > 0 THEN sum(CAST(pos AS DOUBLE) / np * CAST(tp AS DOUBLE) / (tp + fp)) END AS ap FROM hr GROUP BY horizon),
hf AS (SELECT horizon, s, np, nn, 2.0 * (tp / CAST(tp + fp AS DOUBLE)) * (tp / CAST(np AS DOUBLE)) / (tp / CAST(tp + fp AS DOUBLE) + tp / CAST(np AS DOUBLE) + 1e-8) AS f1 FROM hr),
hb AS (SELECT horizon, CASE WHEN np > 0 AND nn > 0 THEN s ELSE 0.5 END AS best FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY f1 DESC, s) AS rn FROM hf) WHERE rn = 1),
hm AS (SELECT horizon, count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn, count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn FROM hp GROUP BY horizon),
ho AS (SELECT horizon, y, row_number() OVER (PARTITION BY horizon ORDER BY p DESC, user_id, seq_idx) AS rn, count(*) OVER (PARTITION BY horizon) AS n FROM hp),
ht AS (SELECT horizon, sum(y) FILTER (WHERE rn <= greatest(1, round_even(n * 0.01, 0))) AS c1, sum(y) FILTER (WHERE rn <= greatest(1, round_even(n * 0.05, 0))) AS c5, sum(y) FILTER (WHERE rn <= greatest(1, round_even(n * 0.1, 0))) AS c10, greatest(sum(y), 1) AS np FROM ho GROUP BY horizon)
SELECT CAST(hm.horizon AS INTEGER) AS horizon, hm.tp, hm.fp, hm.tn, hm.fn, round(auc, 6) AS auc, round(ap, 6) AS average_precision, round(best, 6) AS best_threshold, round(c1 / CAST(np AS DOUBLE), 6) AS top_1, round(c5 / CAST(np AS DOUBLE), 6) AS top_5, round(c10 / CAST(np AS DOUBLE), 6) AS top_10
FROM hm JOIN ha USING (horizon) JOIN hb USING (horizon) JOIN ht USING (horizon)"""


def _horizons(spark, sf):
    q = prediction.risk_sequences(scored(spark, sf), merged(spark, sf), KEY, length=6).withColumn("p", (F.col("user_id") * 31 + F.col("seq_idx") * 17) % 97 / 97.0)
    return prediction.horizon_report(q, (300, 1800), "p", KEY)


@query("horizon_report", sql(*W, "q", "st", HORIZONS))
def _(spark, sf):
    r = _horizons(spark, sf)
    tops = {f"top_{n}": F.round(F.col("captured")[x], 6) for n, x in ((1, 0.01), (5, 0.05), (10, 0.1))}
    return r.select("horizon", "tp", "fp", "tn", "fn", F.round("auc", 6).alias("auc"), F.round("average_precision", 6).alias("average_precision"), F.round("best_threshold", 6).alias("best_threshold"), *(c.alias(n) for n, c in tops.items()))


@query("prediction_document", sql(*W, "q", "st", HORIZONS.replace("SELECT CAST(hm.horizon AS INTEGER)", "SELECT 'completed' AS status, CAST(NULL AS VARCHAR) AS reason, hm.horizon, hm.tp FROM hm UNION ALL SELECT 'skipped', 'no sequences to evaluate', NULL, NULL --").replace("\nFROM hm JOIN ha", " --")))
def _(spark, sf):
    found = _horizons(spark, sf)
    both = prediction.report_document(found).unionByName(prediction.report_document(found.where("false")))
    read = both.select(F.from_json("document", "status string, reason string, horizons array<struct<horizon:int,tp:long>>").alias("d")).select("d.status", "d.reason", F.explode_outer("d.horizons").alias("h"))
    return read.select("status", "reason", F.col("h.horizon").alias("horizon"), F.col("h.tp").alias("tp"))


#: The stand-in for a stream: events arrive in slices of ten days, some of them one or two slices late.
ARRIVALS = """sl AS (SELECT *, least(2, CAST(floor((epoch(ts) - 1704067200) / 864000.0) AS BIGINT)) AS slice FROM events),
fl AS (SELECT *, slice + CASE WHEN event_id % 10 = 0 THEN 1 WHEN event_id % 10 = 1 THEN {late} ELSE 0 END AS file FROM sl),
mx AS (SELECT file, epoch_ms(max(ts)) AS most FROM fl GROUP BY file),
ar AS (SELECT fl.*, coalesce((SELECT max(most) FROM mx WHERE mx.file <= fl.file - 2) - 86400000, 0) * 1000 AS late_us, ((SELECT max(most) FROM mx) - 86400000) * 1000 AS end_us FROM fl)"""
DELAY = "1 day"


def _arrivals(spark: SparkSession, sf: str, late: int) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    slices = F.least(F.lit(2), F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000) / 864_000e6))
    last = F.col("event_id") % 10
    return e.withColumn("file", slices + F.when(last == 0, 1).when(last == 1, late).otherwise(0))


def _stream(spark: SparkSession, sf: str, late: int = 2) -> DataFrame:
    """The events as they arrive: a trigger for each of several files, written one after the other."""
    rows, folder = _arrivals(spark, sf, late), scratch(spark, "arrivals")
    for i in sorted(r.file for r in rows.select("file").distinct().collect()):  # five at most
        rows.where(F.col("file") == i).drop("file").coalesce(1).write.mode("append").parquet(folder)
    return online.read_stream(spark, folder, "*.parquet", rows.drop("file").schema)


@query("stream_windows", "WITH " + ARRIVALS.format(late=2) + """ SELECT user_id, date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS "end", count(*) AS n, round(sum(value), 4) AS total FROM ar
WHERE epoch_us(date_trunc('day', ts) + INTERVAL 1 DAY) > late_us AND epoch_us(date_trunc('day', ts) + INTERVAL 1 DAY) <= end_us GROUP BY 1, 2, 3""")
def _(spark, sf):
    w = online.drain(online.windowed(_stream(spark, sf), "ts", KEY, "value", "1 day", delay=DELAY), scratch(spark, "stream"))
    return w.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", F.round("total", 4).alias("total"))


@query("stream_sessions", "WITH " + ARRIVALS.format(late=1) + """, a AS (SELECT user_id, ts, end_us, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM ar), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM b GROUP BY user_id, k HAVING epoch_us(max(ts) + INTERVAL 2 HOUR) <= max(end_us)""")
def _(spark, sf):
    # rows one slice late are never too late, and sessions that are closed by then lie before their slice
    w = online.drain(online.sessions(_stream(spark, sf, late=1), "ts", KEY, "2 hours", delay=DELAY), scratch(spark, "stream"))
    return w.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("stream_refractory", "WITH RECURSIVE " + ARRIVALS.format(late=2) + """, hot AS (SELECT user_id, ts FROM ar WHERE value >= 100 AND epoch_us(ts) > late_us AND epoch_us(ts) <= end_us), nxt AS (SELECT a.user_id, a.ts, min(b.ts) AS nx FROM hot a LEFT JOIN hot b ON a.user_id = b.user_id AND b.ts > a.ts + INTERVAL 15 MINUTE GROUP BY 1, 2),
al AS (SELECT user_id, min(ts) AS ts FROM hot GROUP BY user_id UNION ALL SELECT al.user_id, nxt.nx FROM al JOIN nxt ON al.user_id = nxt.user_id AND al.ts = nxt.ts WHERE nxt.nx IS NOT NULL) SELECT user_id, ts FROM al""")
def _(spark, sf):
    out = online.drain(online.refractory(_stream(spark, sf), "user_id", "ts", "value", 100.0, 900.0, DELAY), scratch(spark, "stream"))
    return out.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("stream_ring_windows", "WITH " + ARRIVALS.format(late=2) + """, x0 AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 DAY THEN 1 ELSE 0 END AS anew FROM ar WHERE epoch_us(ts) > late_us AND epoch_us(ts) <= end_us),
x1 AS (SELECT *, sum(anew) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS part FROM x0), x2 AS (SELECT *, row_number() OVER (PARTITION BY user_id, part ORDER BY ts, event_id) - 1 AS i FROM x1),
h AS (SELECT user_id, part, i + 1 AS seen FROM x2 WHERE (i + 1) % 8 = 0 AND i + 1 >= 16) SELECT h.user_id, h.seen, CAST(sum(greatest(-128, least(127, round((x.value - 50) / 25.0 / 0.05)))) AS BIGINT) AS q_sum FROM h JOIN x2 x ON x.user_id = h.user_id AND x.part = h.part AND x.i >= h.seen - 16 AND x.i < h.seen GROUP BY h.user_id, h.part, h.seen""")
def _(spark, sf):
    out = online.ring_windows(_stream(spark, sf), "user_id", "ts", "value", 16, 8, 50.0, 25.0, 0.05, delay=DELAY, idle_seconds=172_800.0, tie="event_id")
    return online.drain(out, scratch(spark, "stream")).select("user_id", "seen", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("q_sum"))


@query("band_pass")
def _(spark, sf):
    return dsp.per_session(indexed(spark, sf), KEY, "i", "value", dsp.band_pass(32.0), "filtered")


@query("high_pass")
def _(spark, sf):
    return dsp.per_session(indexed(spark, sf), KEY, "i", "value", dsp.high_pass(4.0), "filtered")


@query("heart_rate")
def _(spark, sf):
    return dsp.per_session(indexed(spark, sf), KEY, "i", "value", lambda x: dsp.heart_rate(x, 4.0), "hr")


@query("fft_resample")
def _(spark, sf):
    n = resample.lengths(indexed(spark, sf), KEY).select("user_id", (F.col("n") * 2).alias("n"))
    return dsp.resample_sessions(indexed(spark, sf), KEY, "i", "value", n)


@query("logistic_scorer")
def _(spark, sf):
    st = windows.window_stats(indexed(spark, sf), KEY, SIZE, "value").join(scored(spark, sf).select("user_id", "window_idx", "label"), ["user_id", "window_idx"])
    return FeatureScorer(["mean", "sd", "least", "most", "change"]).fit(st).score(st).select("user_id", "window_idx", "label", "p")
