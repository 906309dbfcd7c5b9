"""Overlapping windows from panes against each window by itself, sessions that span blocks."""

import pytest
from pyspark.sql import functions as F
from wavelake.config import EngineConfig
from wavelake.operators import windows

def aggs():
    return {"a": windows.Pane("first", F.col("v")), "b": windows.Pane("last", F.col("v")), "lo": windows.Pane("min", F.col("v")), "hi": windows.Pane("max", F.col("v")), "s": windows.Pane("sum", F.col("v")), "c": windows.Pane("count", F.col("v"))}


@pytest.mark.parametrize(("size", "stride"), [(8, 3), (12, 4), (6, 6), (5, 9), (7, 1), (9, 6)])
def test_windows_from_panes(spark, monkeypatch, size, stride):
    monkeypatch.setattr(windows, "PANES", 3)
    values = {k: [None if i % 11 == 5 else (i * 37 + (k or 0)) % 101 for i in range(n)] for k, n in ((1, 200), (2, size), (3, size - 1), (None, 60))}
    df = spark.createDataFrame([(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)], "k int, i long, v long").repartition(3)
    got = sorted(map(tuple, windows.count_windows(df, ["k"], size, stride, aggs()).collect()), key=repr)
    want = []
    for k, vs in values.items():
        for w in range((len(vs) - size) // stride + 1 if len(vs) >= size else 0):
            part = vs[w * stride : w * stride + size]
            real = [x for x in part if x is not None]
            want.append((k, w, part[0], part[-1], min(real), max(real), sum(real), len(real)))
    assert got == sorted(want, key=repr)
    plain = {n: windows._part(a, "i") for n, a in aggs().items()}
    assert sorted(map(tuple, windows.count_windows(df, ["k"], size, stride, plain).collect()), key=repr) == got


def test_one_session_spans_tasks_and_shuffles_little(spark):
    df = spark.range(100_000).select(F.lit(1).alias("k"), F.col("id").alias("t"), (F.col("id") % 100).alias("v"))
    indexed = windows.index_rows(df, ["k"], ["t"], config=EngineConfig(one_task_bytes=0))
    out = windows.count_windows(indexed, ["k"], 1000, 10, {"s": windows.Pane("sum", F.col("v"))})
    assert out.where("s != 49500").count() == 0 and out.count() == 9901  # every row is in a hundred windows
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the panes alone would fit one task
    assert out.groupBy(F.spark_partition_id()).count().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
