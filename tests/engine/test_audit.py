"""Rules on result documents: the scientific checklist, missing fields, early exits."""

import json

from pyspark.sql import functions as F
from wavelake.operators import audit


def statuses(spark, rules, schema, *documents):
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "k int, text string")
    docs = rows.select("k", F.from_json("text", schema).alias("d")).select("k", "d.*")
    out = [{} for _ in documents]
    for r in audit.evaluate(docs, rules, ["k"]).collect():
        out[r.k][r.check] = r.status
    return out


LEVEL = {"detected_events": 2, "event_count": 4}
SURE = LEVEL | {"event_sensitivity_ci95_low": 0.1, "event_sensitivity_ci95_high": 0.9}
POLICY = {"offset_policy": "onset plus fixed duration"}


def test_scientific_checklist(spark):
    bare = {"standard_mode": {"event_level": LEVEL}, "pro_mode": {"event_level": LEVEL}, "label_policy": POLICY}
    whole = {"standard_mode": {"event_level": SURE}, "pro_mode": {"event_level": SURE}, "label_policy": POLICY, "matched_false_alarm_operating_point": {"validation_alarm_budget": 10.0}}
    budgets = whole | {"matched_false_alarm_operating_point": {"fixed_validation_alarm_budgets": [1, 5]}, "label_policy": {"offset_policy": "  "}}
    a, b, c = statuses(spark, audit.scientific_rules(), audit.DETECTION_SCHEMA, bare, whole, budgets)
    assert a == {"uncertainty_estimates": "warn", "operating_point_documented": "warn", "label_policy_documented": "pass"}
    assert set(b.values()) == {"pass"}
    assert c == {"uncertainty_estimates": "pass", "operating_point_documented": "pass", "label_policy_documented": "warn"}


def test_empty_document(spark):
    (got,) = statuses(spark, audit.detection_rules(), audit.DETECTION_SCHEMA, {})
    assert {n for n, s in got.items() if s == "pass"} == {"raw_accuracy_not_primary", "pro_signal_gain", "pro_event_sensitivity_gain", "checkpoint_provenance_disclosed"}
    assert {n for n, s in got.items() if s == "fail"} == {"detection_status", "split_strategy", "allocation_selected_on_validation"}


def test_event_sensitivity_gain_is_told_apart(spark):
    doc = {"standard_mode": {"auc": 0.5, "recall": 0.1, "event_level": {"event_sensitivity": 0.75}}, "pro_mode": {"auc": 0.6, "recall": 0.2, "event_level": {"event_sensitivity": 0.5}}}
    (got,) = statuses(spark, audit.detection_rules(), audit.DETECTION_SCHEMA, doc)
    assert (got["pro_signal_gain"], got["pro_event_sensitivity_gain"]) == ("pass", "warn")


def test_latest_window(spark):
    rows = spark.createDataFrame([("a", "2026-01-01", "START TSMIXER 2026-05-01T10:00:00"), ("a", "2026-01-01", "END TSMIXER code 2026-05-02T11:00:00"), ("b", "2026-01-03", "START TSMIXER soon"), ("c", "2025-12-31", "START TSMIXER 2026-06-01T10:00:00")], "file string, modified string, value string")
    got = audit.latest_window(audit.status_windows(rows.withColumn("modified", F.to_timestamp("modified")), "TSMIXER")).first()
    assert (str(got.start), str(got.end)) == ("2026-05-01 10:00:00", "2026-05-02 11:00:00")
