"""Selections against definitions."""

import math
import random

import pytest
from wavelake.operators import selection


def brute_threshold(neg, k):
    """The lowest score that alarms, if k negatives may."""
    neg = sorted(neg, reverse=True)
    if not neg:
        return 0.5
    return math.nextafter(neg[0], math.inf) if k <= 0 else neg[min(k, len(neg)) - 1]


@pytest.mark.parametrize("budget", [1.0, 40.0])
def test_smoothing_grid(spark, budget):
    # 2 sessions of 120 windows of 5 s: a third of an hour, so no negative may alarm at a budget of 1
    rng = random.Random(7)
    rows = [(s, i, 5.0 * i, 5.0 * i + 5.0, rng.random() + 0.3 * (50 <= i < 60), int(50 <= i < 60)) for s in (1, 2) for i in range(120)]
    w = spark.createDataFrame(rows, "s int, window_idx long, start_s double, end_s double, p double, y int")
    ev = spark.createDataFrame([(1, 0, 251.0, 299.0), (2, 0, 251.0, 299.0), (2, 1, 580.0, 585.0)], "s int, event_index long, start_s double, end_s double")
    got = {r.k: r for r in selection.smoothing_grid(w, ev, ["s"], "p", "y", budget, (1, 3, 9)).collect()}
    hours = len(rows) * 5.0 / 3600.0
    for k, r in got.items():
        part = {s: [x[4] for x in rows if x[0] == s] for s in (1, 2)}
        q = [sum(c := part[x[0]][max(0, x[1] - k + 1) : x[1] + 1]) / len(c) for x in rows]
        pos, neg = ([a for a, x in zip(q, rows, strict=True) if x[5] == y] for y in (1, 0))
        t = brute_threshold(neg, int(budget * hours))
        assert abs(r.threshold - t) < 1e-9
        # sums in another order may differ in the last digit, so ties with the threshold are judged by it
        recall, fp = sum(a >= t - 1e-12 for a in pos) / len(pos), 0 if budget * hours < 1 else sum(a >= t - 1e-12 for a in neg)
        hit = sum(any(a >= t - 1e-12 for a, x in zip(q, rows, strict=True) if x[0] == s and x[2] <= e and x[3] >= b) for s, _, b, e in [(1, 0, 251.0, 299.0), (2, 0, 251.0, 299.0), (2, 1, 580.0, 585.0)])
        auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
        balanced = (recall + 1 - fp / len(neg)) / 2
        value = 200 * r.detected_events + 40 * r.event_sensitivity + 20 * recall + 5 * balanced + auc - 0.05 * fp / hours
        assert abs(r.auc - auc) < 1e-9 and abs(r.recall - recall) < 1e-9 and abs(r.false_alarms_per_hour - fp / hours) < 1e-9
        if budget * hours >= 1:
            assert r.detected_events == hit
        assert abs(r.value - value) < 1e-9
    assert set(got) == {1, 3, 9}
