"""From windows to labelled risk sequences and their report per horizon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..operators import metrics, ranking, states, windows
from ..scratch import materialize


def risk_sequences(tumbling: DataFrame, events: DataFrame, keys: Sequence[str], config: EngineConfig = DEFAULT, length: int | None = None) -> DataFrame:
    """Sequences with their labels per horizon; those anchored during or after an event are dropped."""
    seq = windows.sequences(tumbling, keys, length or config.sequence_length)
    return states.state_labels(seq, events, keys, ["seq_idx"], "anchor_s", config).where("not blocked")


def horizon_report(scored: DataFrame, horizons: Sequence[int], score: str, keys: Sequence[str], shares: tuple[float, ...] = (0.01, 0.05, 0.10)) -> DataFrame:
    """One row per horizon: metrics at 0.5, AUC, average precision, best threshold, capture of the top shares.

    ``keys`` name a sequence together with seq_idx; they decide between equal scores.
    """
    each = F.explode(F.array(*(F.struct(F.lit(int(h)).alias("horizon"), F.col(f"label_{h}").alias("y")) for h in horizons))).alias("x")
    rows = materialize(scored.select(F.struct(*keys, "seq_idx").alias("tie"), F.col(score).alias("p"), each).select("tie", "p", "x.*"), "horizons")
    by = ("horizon",)
    counts = ranking.score_counts(rows, "p", "y", by)
    top = ranking.top_share(rows, "p", "y", "tie", shares, by).groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("share", "recall")))).alias("captured"))
    out = metrics.confusion_metrics(rows, "p", "y", 0.5, groups=by)
    for part in (ranking.roc_auc(counts, by), ranking.average_precision(counts, by), ranking.f1_threshold(counts, by).select(*by, F.col("threshold").alias("best_threshold")), top):
        out = out.join(F.broadcast(part), list(by))  # a row per horizon
    return out


def report_document(rows: DataFrame) -> DataFrame:
    """(document): a report of few rows, such as `horizon_report`'s, as one JSON text with ``status`` and ``reason``.

    Without rows the run ended early: there was nothing to report on.
    """
    columns = [F.map_entries(c).alias(c) if kind.startswith("map") else F.col(c) for c, kind in rows.dtypes]  # maps have no order
    whole = rows.agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("horizons"))
    some = F.size("horizons") > 0
    text = F.struct(F.when(some, "completed").otherwise("skipped").alias("status"), F.when(~some, "no sequences to evaluate").alias("reason"), "horizons")
    return whole.select(F.to_json(text, {"ignoreNullFields": "false"}).alias("document"))
