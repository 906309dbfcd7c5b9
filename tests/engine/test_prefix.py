"""Running values and numbers over keys that span many tasks."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F
from wavelake.config import EngineConfig
from wavelake.operators import prefix
from wavelake.operators.prefix import Running, number_rows, running
from wavelake.scratch import materialize


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running(spark, many_parts):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), i, rng.choice([None, rng.randint(-9, 9)])) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, t long, v int")
    got = running(df, ["k"], ["t"], {"total": Running("sum", F.col("v")), "before": Running("sum", F.col("v"), False), "most": Running("max", F.col("v")), "held": Running("last", F.col("v"), False)})
    assert got.columns == ["k", "t", "v", "total", "before", "most", "held"]
    want = []
    for _, part in groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])), key=lambda r: r[0]):
        total, most, held = 0, None, None
        for k, t, v in part:
            was = (total, held)
            if v is not None:
                total, most, held = total + v, v if most is None else max(most, v), v
            want.append((k, t, v, total, was[0], most, was[1]))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_one_key_spans_tasks(spark, many_parts):
    df = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 20_000).alias("t"))
    out = number_rows(df, ["k"], ["t"], "i")
    assert out.where("i != t").count() == 0 and out.count() == 20_000
    assert out.groupBy(F.spark_partition_id()).count().count() >= 4  # not one task


def test_no_keys_and_no_rows(spark, many_parts):
    df = spark.range(1000).select((1000 - F.col("id")).alias("t"))
    assert number_rows(df, [], ["t"], "i", 1).where("i != t").count() == 0
    assert number_rows(df.where("false"), [], ["t"], "i").count() == 0
    assert number_rows(df.where("t = 5"), [], [F.col("t").desc()], "i").collect()[0].i == 0
    with pytest.raises(ValueError):
        running(df, [], ["t"], {"x": Running("min", F.col("t"))})


@pytest.mark.parametrize("config", [None, EngineConfig(one_task_bytes=1 << 70)])
def test_last_and_next_in_one_order(spark, many_parts, monkeypatch, config):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, rng.choice([None, None, i])) for i in range(2000)]
    held = F.col("v") + 0
    written = []
    monkeypatch.setattr(prefix, "materialize", lambda df, name: written.append(df.columns) or materialize(df, name))
    got = running(spark.createDataFrame(rows, "k int, t long, v int"), ["k"], ["t"], {"a": Running("last", held), "b": Running("next", held), "c": Running("next", held, False)}, config)
    want = []
    for k, t, v in rows:
        of = [x for kk, _, x in rows if kk == k and x is not None]
        want.append((k, t, v, max((x for x in of if x <= t), default=None), min((x for x in of if x >= t), default=None), min((x for x in of if x > t), default=None)))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    # one pass, which carries the value once
    assert written == ([] if config else [["k", "t", "v", "__run_v0", "__run_at"]])
