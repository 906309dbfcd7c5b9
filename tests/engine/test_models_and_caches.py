"""Low-rank reconstruction, interpolation at irregular times, threshold grids and caches against plain Python."""

import os
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F
from wavelake import queries
from wavelake.config import EngineConfig
from wavelake.operators import metrics, resample
from wavelake.operators.scoring import LowRankScorer
from wavelake.sinks import writers

SF = "/root/testdata/sf0.001"


def test_low_rank_errors(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = e.collect()
    x = np.array([r.embedding for r in rows], float)
    normal = x[[r.label <= 0.5 for r in rows]]
    mean = normal.mean(axis=0)
    directions = np.linalg.svd(normal - mean, full_matrices=False)[2][:8]
    off = x - mean
    want = ((off - off @ directions.T @ directions) ** 2).mean(axis=1)
    got = {r.vec_id: r.error for r in queries.QUERIES["low_rank_error"](spark, SF).collect()}
    assert np.allclose([got[r.vec_id] for r in rows], want, atol=1e-6) and (want < (off**2).mean(axis=1)).all()


def test_low_rank_edges(spark):
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [3.0, 2.0])], "k int, v array<double>")
    model = LowRankScorer("v", 1).fit(odd.where("k in (1, 4)"))
    assert {r.k: r.error if r.error is None else round(r.error, 9) for r in model.score(odd).collect()} == {1: 0.0, 2: None, 3: None, 4: 0.0}
    with pytest.raises(ValueError):
        LowRankScorer("v", 1).fit(odd.where("false"))


@pytest.mark.parametrize("config", [EngineConfig(), EngineConfig(one_task_bytes=0)])
def test_interpolation_at_irregular_times(spark, config):
    rng = random.Random(6)
    samples = [(k, rng.choice([float(rng.randint(0, 90)), rng.random() * 90]), rng.random(), i) for k in (1, 2, None) for i in range(40)] + [(3, 5.0, 7.0, 0), (1, None, 1.0, 99), (1, 3.0, None, 98)]
    points = [(k, t, "x") for k in (1, 2, 3, 4, None) for t in [*map(float, range(-5, 99, 4)), None]]
    s, p = spark.createDataFrame(samples, "k int, t double, v double, id int"), spark.createDataFrame(points, "k int, t double, note string")
    for tolerance in (None, 1.5):
        want = []
        for k, t, note in points:
            real = sorted((x for x in samples if x[0] == k and None not in (x[1], x[2])), key=lambda x: (x[1], x[3]))
            before = [x for x in real if t is not None and x[1] <= t and (tolerance is None or t - x[1] <= tolerance)]
            after = [x for x in real if t is not None and x[1] > t and (tolerance is None or x[1] - t <= tolerance)]
            a, b = before[-1:], after[:1]
            v = a[0][2] + (b[0][2] - a[0][2]) * (t - a[0][1]) / (b[0][1] - a[0][1]) if a and b else (a or b)[0][2] if a or b else None
            want.append((k, t, note, v if v is None else round(v, 9)))
        got = [(r.k, r.t, r.note, None if r.v is None else round(r.v, 9)) for r in resample.interpolate_at(s, p, ["k"], "t", "v", "id", tolerance, config).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_hundred_thresholds_in_one_pass(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, float("nan"), *[rng.random()] * 8]), rng.choice([0, 1, 1, None])) for _ in range(400)]
    df = spark.createDataFrame(rows, "p double, y int")
    grid = {f"t{i}": i / 100 for i in range(100)}
    out = metrics.over_thresholds(df, grid, "name", "p", "y")
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString().split("HashAggregate")[-1]  # no row is repeated before the counts
    got = {r.name: r for r in out.collect()}
    for name in ("t0", "t37", "t99"):
        one = metrics.confusion_metrics(df, "p", "y", grid[name]).first().asDict()
        assert {k: v for k, v in got[name].asDict().items() if k != "name"} == pytest.approx(one, nan_ok=True)
    assert metrics.over_thresholds(df.where("false"), grid, "name", "p", "y").count() == 0


def test_cache_follows_its_inputs(spark, tmp_path):
    at, built = str(tmp_path / "in"), []

    def table(n):
        spark.range(n).write.mode("overwrite").parquet(at)

    def build():
        built.append(1)
        return spark.read.parquet(at)

    get = lambda: writers.cached(spark, str(tmp_path / "cache"), {"v": 1}, build, [at]).count()
    table(3)
    assert (get(), get(), len(built)) == (3, 3, 1)
    table(5)
    assert (get(), get(), len(built)) == (5, 5, 2)
    # a half-written table has no name that is read
    os.makedirs(tmp_path / "cache" / ".abandoned-1")
    assert get() == 5 and writers.fingerprint(spark, [str(tmp_path / "none")]) == writers.fingerprint(spark, [])


def test_two_writers(spark, tmp_path):
    gate, got = threading.Barrier(2), []

    def build():
        gate.wait(30)
        return spark.range(4)

    def get():
        got.append(writers.cached(spark, str(tmp_path / "cache"), {"v": 2}, build).count())

    both = [threading.Thread(target=get) for _ in range(2)]
    [t.start() for t in both]
    [t.join(60) for t in both]
    assert got == [4, 4] and len([x for x in os.listdir(tmp_path / "cache")]) == 1
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/cache/*").select(F.col("id")).collect()) == [0, 1, 2, 3]
