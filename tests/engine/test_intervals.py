"""Intervals against plain Python, and the boundaries of each join."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from wavelake.config import EngineConfig
from wavelake.operators import intervals, metrics

COLS = "k int, start_s double, end_s double"


def brute_merge(rows, gap):
    out = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 9)), max_size=25), st.sampled_from([0.0, 1.0, 3.0]))
def test_merge(spark, pairs, gap):
    rows = [(1, float(a), float(a + n)) for a, n in pairs]
    once = intervals.merge_intervals(spark.createDataFrame(rows, COLS), ["k"], gap=gap)
    got = sorted((r.start_s, r.end_s) for r in once.collect())
    assert got == brute_merge([r[1:] for r in rows], gap)
    again = intervals.merge_intervals(once.select("k", "start_s", "end_s"), ["k"], gap=gap)
    assert sorted((r.start_s, r.end_s) for r in again.collect()) == got


@pytest.mark.parametrize("closed,n", [(False, 0), (True, 1)])
def test_touching(spark, closed, n):
    a, b = spark.createDataFrame([(1, 0.0, 5.0)], COLS), spark.createDataFrame([(1, 5.0, 9.0), (2, 1.0, 2.0)], COLS)
    assert intervals.overlap_join(a, b, ["k"], closed).count() == n


def test_points_keep_their_number(spark):
    rng = random.Random(1)
    iv = [(k, float(a), float(a + rng.randint(0, 9))) for k in range(3) for a in (rng.randint(0, 60) for _ in range(12))]
    pts = [(k, float(t)) for k in range(4) for t in range(70)]
    got = intervals.label_points(spark.createDataFrame(pts, "k int, t double"), spark.createDataFrame(iv, COLS), ["k"], "t").collect()
    want = sorted((k, t, int(any(k == j and s <= t <= e for j, s, e in iv))) for k, t in pts)
    assert sorted((r.k, r.t, r.label) for r in got) == want


def test_alerts_are_split(spark):
    alerts = spark.createDataFrame([(1, 0.0, 1.0), (1, 7.0, 8.0), (2, 0.0, 1.0)], COLS)
    events = spark.createDataFrame([(1, 1.0, 3.0), (1, 0.5, 0.9)], COLS)
    inside, outside = intervals.split_alerts(alerts, events, ["k"])
    assert inside.count() == 1 and outside.count() == 2


SPREAD = EngineConfig(one_task_bytes=0)


def overlap(a, b, closed):
    if None in (*a[:3], *b[:3]) or a[0] != b[0] or a[1] > a[2] or b[1] > b[2]:
        return False
    return a[1] <= b[2] and a[2] >= b[1] if closed else a[1] < b[2] and a[2] > b[1]


def cases(seed, n):
    rng = random.Random(seed)
    out = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *map(float, range(12))] if rng.random() < 0.1 else [float(rng.randint(0, 60))]), float(rng.randint(0, 60)), f"{seed}-{i}") for i in range(n)]
    return [(k, s, s if s is not None and rng.random() < 0.2 else e, x) for k, s, e, x in out] + out[:5]


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("config", [EngineConfig(), SPREAD])
def test_overlap_joins_against_all_pairs(spark, monkeypatch, closed, config):
    monkeypatch.setattr(intervals, "RANKS", 4)
    a, b = cases(1, 90), cases(2, 110)
    left, right = spark.createDataFrame(a, "k int, start_s double, end_s double, x string"), spark.createDataFrame([(*r, i) for i, r in enumerate(b)], "k int, lo double, hi double, x string, y int")
    met = {i: [j for j, r in enumerate(b) if overlap(q, r, closed)] for i, q in enumerate(a)}
    join = lambda how: intervals.overlap_join(left, right, ["k"], closed, how, right_bounds=("lo", "hi"), config=config)
    inner = sorted(((*a[i], b[j][1], b[j][2], j) for i in met for j in met[i]), key=repr)
    assert len(inner) > 300 and join("inner").columns == ["k", "start_s", "end_s", "x", "b_start", "b_end", "y"]
    assert sorted(map(tuple, join("inner").collect()), key=repr) == inner
    alone = [a[i] for i in met if not met[i]]
    assert sorted(map(tuple, join("left").collect()), key=repr) == sorted([*inner, *((*q, None, None, None) for q in alone)], key=repr)
    assert sorted(map(tuple, join("left_anti").collect()), key=repr) == sorted(alone, key=repr)
    assert sorted(map(tuple, join("left_semi").collect()), key=repr) == sorted((a[i] for i in met if met[i]), key=repr)
    counts = intervals.overlap_counts(left, right, ["k"], closed, "k2", right_bounds=("lo", "hi"), config=config)
    assert sorted(map(tuple, counts.collect()), key=repr) == sorted(((*a[i], len(met[i])) for i in met), key=repr)


def test_merge_over_many_tasks(spark):
    rng = random.Random(3)
    rows = [(k, float(s), float(s + rng.randint(0, 5))) for k in (1, 2) for s in (rng.randint(0, 900) for _ in range(300))]
    one, many = (sorted(map(tuple, intervals.merge_intervals(spark.createDataFrame(rows, COLS), ["k"], gap=1.0, config=c).collect())) for c in (EngineConfig(), SPREAD))
    assert one == many and [r[1:3] for r in one if r[0] == 1] == brute_merge([r[1:] for r in rows if r[0] == 1], 1.0)


def test_hot_session_takes_linear_work(spark):
    # all pairs of the session would be 4 * 10^10; the pairs that overlap are about 600,000
    n = 200_000
    left = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 10.0).alias("start_s"), (F.col("id") * 10.0 + 14.0).alias("end_s"))
    right = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 10.0 + 3.0).alias("start_s"), (F.col("id") * 10.0 + 12.0).alias("end_s"))
    for config in (EngineConfig(), SPREAD):
        want = 3 * n - 2
        assert intervals.overlap_counts(left, right, ["k"], True, config=config).agg(F.sum("n")).first()[0] == want
        assert intervals.overlap_join(left, right, ["k"], True, config=config).count() == want


def test_null_and_empty_sides(spark):
    some, none = spark.createDataFrame([(1, 0.0, 5.0), (None, 0.0, 5.0)], COLS), spark.createDataFrame([], COLS)
    assert intervals.overlap_join(some, some, ["k"], True).count() == 1 and intervals.overlap_join(none, some, ["k"], True).count() == 0
    assert intervals.overlap_join(some, none, ["k"], True, "left").count() == 2 and intervals.overlap_counts(none, none, ["k"], False).count() == 0
    with pytest.raises(ValueError):
        intervals.overlap_join(some, some, ["k"], True, "full")


def test_joins_by_slices_send_no_table_through_the_driver(spark, tmp_path):
    # files of a few bytes look small to the optimizer, however many rows they hold
    spark.sql("SELECT id % 5 AS s, id AS event_index, CAST(id AS double) AS start_s, id + 2.0D AS end_s, id AS window_idx, 0.5D AS p, 1 AS label FROM range(100)").write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    w, e = rows.drop("event_index"), rows.select("s", "event_index", "start_s", "end_s")
    made = (
        intervals.overlapping_pairs(e, w.select("s", F.col("start_s").alias("a"), F.col("end_s").alias("b")), ["s"], True, right_bounds=("a", "b")),
        intervals.label_points(w, e, ["s"], "start_s"), metrics.event_hits(w, e, ["s"], "p", 0.25), metrics.alerts_per_event(w, e, ["s"], "p", 0.25, 1),
    )
    for df in made:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert made[0].count() == 100 and made[1].where("label = 1").count() == 100 and made[2].where("detected").count() == 100
