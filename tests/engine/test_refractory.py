"""Refractory alerts against a loop, with islands folded and jumped."""

import random

import pytest
from pyspark.sql import functions as F
from wavelake.config import EngineConfig
from wavelake.operators import metrics, refractory


def loop(positions, r):
    out, last = [], None
    for p in sorted(positions):
        if last is None or p - last > r:
            out.append(p)
            last = p
    return out


@pytest.mark.parametrize(("island", "config"), [(4096, EngineConfig()), (3, EngineConfig()), (3, EngineConfig(one_task_bytes=0))])
def test_against_a_loop(spark, monkeypatch, island, config):
    monkeypatch.setattr(refractory, "ISLAND", island)
    rng = random.Random(4)
    rows = [(k, i, rng.random()) for k in (1, 2, None) for i in range(300)] + [(3, i, 1.0) for i in range(200)] + [(4, 7, 1.0), (5, 0, 0.0)]
    df = spark.createDataFrame(rows, "k int, window_idx long, p double").repartition(3)
    for r in (0, 2, 6):
        got = sorted(map(tuple, refractory.refractory_alerts(df, ["k"], "p", 0.4, r, config=config).collect()), key=repr)
        assert got == sorted(((k, p) for k in (1, 2, 3, 4, None) for p in loop([i for key, i, x in rows if key == k and x >= 0.4], r)), key=repr)


def test_a_long_hot_session(spark):
    df = spark.range(100_000).select(F.lit(1).alias("k"), F.col("id").alias("window_idx"), F.lit(1.0).alias("p"))
    got = refractory.refractory_alerts(df, ["k"], "p", 0.5, 4)
    assert got.where("window_idx % 5 != 0").count() == 0 and got.count() == 20_000


def test_lock_by_row_and_no_rows(spark):
    df = spark.createDataFrame([(r, i, 1.0) for r in (1, 3) for i in range(12)], "r int, window_idx long, p double")
    got = refractory.refractory_alerts(df, ["r"], "p", 0.5, F.col("r"))
    assert sorted(map(tuple, got.collect())) == [(1, i) for i in range(0, 12, 2)] + [(3, i) for i in range(0, 12, 4)]
    assert refractory.refractory_alerts(df.where("false"), ["r"], "p", 0.5, 1).count() == 0


def test_windows_are_made_once_for_their_metrics(spark):
    made = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            made.add(len(f))
            yield f

    schema = "k int, window_idx long, start_s double, end_s double, p double"
    windows = spark.createDataFrame([(k, i, 5.0 * i, 5.0 * i + 5.0, (i % 7) / 7) for k in (1, 2) for i in range(50)], schema).mapInPandas(count, schema)
    events = spark.createDataFrame([(1, 0, 23.0, 24.0), (2, 0, 900.0, 901.0)], "k int, event_index long, start_s double, end_s double")
    got = metrics.alert_metrics(windows, events, ["k"], "p", 0.5, 2).collect()[0]
    fired = loop([i for i in range(50) if (i % 7) / 7 >= 0.5], 2)
    assert (got.windows, got.alerts, got.true_alerts, got.event_count, got.detected_events) == (100, 2 * len(fired), 4 in fired, 2, 4 in fired)
    assert made.value == 100
