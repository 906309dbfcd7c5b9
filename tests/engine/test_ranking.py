"""Rankings against definitions; slices give what a single sort gives."""

import random

import pytest
from wavelake.config import EngineConfig
from wavelake.operators import ranking

ONE = EngineConfig()
SLICED = EngineConfig(one_task_bytes=0)


def data(spark, seed=0, n=400):
    rng = random.Random(seed)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.3)) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "p double, y int")


def brute_auc(rows):
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def brute_ap(rows):
    total, out, before = sum(y for _, y in rows), 0.0, 0.0
    for t in sorted({p for p, _ in rows}, reverse=True):
        tp, n = sum(y for p, y in rows if p >= t), sum(p >= t for p, _ in rows)
        out += (tp / total - before) * tp / n
        before = tp / total
    return out


@pytest.mark.parametrize("config", [ONE, SLICED])
def test_auc_and_ap(spark, config):
    rows, df = data(spark)
    counts = ranking.score_counts(df, "p", "y")
    assert abs(ranking.roc_auc(counts, (), config).first().auc - brute_auc(rows)) < 1e-9
    assert abs(ranking.average_precision(counts, (), config).first().average_precision - brute_ap(rows)) < 1e-9
    flipped = ranking.score_counts(df.selectExpr("-p AS p", "y"), "p", "y")
    assert abs(ranking.roc_auc(flipped, (), config).first().auc - (1 - brute_auc(rows))) < 1e-9


def test_one_class(spark):
    counts = ranking.score_counts(spark.createDataFrame([(0.1, 0), (0.7, 0), (None, 1), (float("nan"), 1)], "p double, y int"), "p", "y")
    assert ranking.roc_auc(counts).first().auc is None
    assert ranking.average_precision(counts).first().average_precision is None
    assert ranking.f1_threshold(counts).first().threshold == 0.5


@pytest.mark.parametrize("config", [ONE, SLICED])
def test_budgets(spark, config):
    rows, df = data(spark, 3)
    neg = sorted((p for p, y in rows if not y), reverse=True)
    got = {r.budget: r for r in ranking.budget_thresholds(ranking.score_counts(df, "p", "y"), (0.0, 1.0, 4.0, 1e6), 5.0, config).collect()}
    assert (got[0.0].threshold, got[0.0].strict) == (neg[0], True)
    assert got[1.0].threshold == neg[4] and got[4.0].threshold == neg[19]
    assert got[1e6].threshold == neg[-1]
    strict = {r.budget: r for r in ranking.budget_thresholds(ranking.score_counts(df, "p", "y"), (1.0, 4.0), 5.0, config, True).collect()}
    for b, k in ((1.0, 5), (4.0, 20)):
        t = strict[b]
        assert sum(p > t.threshold if t.strict else p >= t.threshold for p in neg) <= k


def test_f1(spark):
    rows, df = data(spark, 5)
    best = max(sorted({p for p, _ in rows}), key=lambda t: (round(2 * sum(y for p, y in rows if p >= t) / (sum(p >= t for p, _ in rows) + sum(y for _, y in rows)), 9), -t))
    assert ranking.f1_threshold(ranking.score_counts(df, "p", "y")).first().threshold == best
