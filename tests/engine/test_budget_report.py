"""The alarm-budget report against definitions: thresholds of validation rows, metrics of test rows."""

import math
import random

from wavelake.config import EngineConfig
from wavelake.plans import detection


def test_budget_report(spark):
    rng = random.Random(3)

    def rows(s):
        return [(s, i, 5.0 * i, 5.0 * i + 5.0, rng.randrange(50) / 50 + 0.25 * (40 <= i < 48), int(40 <= i < 48)) for i in range(240)]

    val, test = rows(1), rows(2)
    events = [(2, 0, 201.0, 239.0), (2, 1, 1001.0, 1004.0)]
    schema = "s int, window_idx long, start_s double, end_s double, p double, label int"
    ev = spark.createDataFrame(events, "s int, event_index long, start_s double, end_s double")
    config = EngineConfig(alarm_budgets=(1.0, 30.0, 100.0))
    got = {r.budget: r for r in detection.budget_report(spark.createDataFrame(val, schema), spark.createDataFrame(test, schema), ev, ["s"], config, refractory_minutes=0.5).collect()}
    hours, neg = 240 * 5 / 3600, sorted((r[4] for r in val if not r[5]), reverse=True)
    assert set(got) == {1.0, 30.0, 100.0} and int(1.0 * hours) == 0
    for budget, r in got.items():
        k = int(budget * hours)
        t = math.nextafter(neg[0], math.inf) if k == 0 else neg[k - 1]
        hot = [x for x in test if x[4] >= t]
        over = lambda x, e: x[2] <= e[3] and x[3] >= e[2]
        alerts, last = [], -100
        for x in hot:
            if x[1] - last > 6:
                alerts.append(x)
                last = x[1]
        hits = lambda rows: sum(any(over(x, e) for x in rows) for e in events)
        false = sum(not any(over(x, e) for e in events) for x in alerts)
        assert r.threshold == t
        assert (r.tp, r.fp) == (sum(x[5] for x in hot), sum(1 - x[5] for x in hot))
        assert (r.event_count, r.detected_events, r.alert_detected_events) == (2, hits(hot), hits(alerts))
        assert (r.alerts, r.false_alerts, r.true_alerts) == (len(alerts), false, len(alerts) - false)
        assert abs(r.false_alerts_per_hour - false / hours) < 1e-9
