"""Kernels, refractory rule, splits, sources, sinks and streams."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from wavelake import functions as fn
from wavelake.config import EngineConfig
from wavelake.operators import audit, dsp, metrics, refractory, resample, scoring, selection, sessions, splits, states, summary, windows
from wavelake.sinks import writers
from wavelake.sources import archives, labels, sensors
from wavelake.streaming import online


def gain(sections, f, rate):
    w = np.exp(-2j * np.pi * f / rate)
    return abs(np.prod([(s[0] + s[1] * w + s[2] * w * w) / (1 + s[4] * w + s[5] * w * w) for s in sections]))


def test_butterworth_gains():
    band = dsp.butterworth(3, (2.0, 8.0), 32.0, "band")
    assert abs(gain(band, 2.0, 32) - 0.5**0.5) < 1e-6 and abs(gain(band, 8.0, 32) - 0.5**0.5) < 1e-6
    assert gain(band, 0.01, 32) < 1e-4 and gain(band, 15.9, 32) < 1e-3
    high = dsp.butterworth(2, 0.05, 4.0, "high")
    assert abs(gain(high, 0.05, 4) - 0.5**0.5) < 1e-6 and abs(gain(high, 1.9, 4) - 1) < 1e-3
    low = dsp.butterworth(5, 3.0, 32.0, "low")
    assert abs(gain(low, 3.0, 32) - 0.5**0.5) < 1e-6 and abs(gain(low, 0, 32) - 1) < 1e-9


def test_zero_phase_keeps_a_passed_sine():
    t = np.arange(0, 20, 1 / 32)
    y = dsp.band_pass(32.0)(np.sin(2 * np.pi * 4 * t) + 5)
    assert np.abs(y - np.sin(2 * np.pi * 4 * t))[64:-64].max() < 0.02
    assert np.array_equal(dsp.band_pass(32.0)(np.ones(5)), np.ones(5))


def test_peaks():
    x = np.array([0, 2, 0, 3, 3, 0, 1, 0, 5, 4, 5, 0.0])
    assert dsp.find_peaks(x).tolist() == [1, 3, 6, 8, 10]
    assert dsp.find_peaks(x, distance=3).tolist() == [3, 6, 10]
    assert dsp.find_peaks(x, prominence=1.5).tolist() == [1, 3, 8, 10]


def test_fft_resample():
    t = np.arange(64) / 64
    assert np.allclose(dsp.fft_resample(np.cos(2 * np.pi * 3 * t), 128), np.cos(2 * np.pi * 3 * np.arange(128) / 128))
    assert np.allclose(dsp.fft_resample(np.cos(2 * np.pi * 3 * t), 32), np.cos(2 * np.pi * 3 * np.arange(32) / 32))


@pytest.mark.parametrize("r", [0, 1, 4])
def test_refractory(spark, r):
    rng = random.Random(r)
    rows = [(k, i, rng.random()) for k in range(3) for i in range(80)]
    got = {(x.k, x.window_idx) for x in refractory.refractory_alerts(spark.createDataFrame(rows, "k int, window_idx long, p double"), ["k"], "p", 0.6, r).collect()}
    want, last = set(), {}
    for k, i, p in rows:
        if p >= 0.6 and i - last.get(k, -r - 1) > r:
            want.add((k, i))
            last[k] = i
    assert got == want


def test_patient_split_holds_patients_out(spark):
    rows = [(p, s, p % 3 == 0) for p in range(30) for s in range(4)]
    out = splits.patient_split(spark.createDataFrame(rows, "patient int, s int, y boolean"), "patient", "y").collect()
    assert len(out) == 30 and {r.split for r in out} == {"train", "val", "test"}
    assert sum(r.split == "test" for r in out) == 6 and sum(r.split == "val" for r in out) == 3
    tiny = splits.patient_split(spark.createDataFrame([(1, True), (2, True)], "patient int, y boolean"), "patient", "y").collect()
    assert {r.split for r in tiny} == {"train"}


def test_state_labels_against_scan(spark):
    rng = random.Random(4)
    config = EngineConfig()
    ev, at = [], 0.0
    for i in range(6):
        at += rng.choice([1000, 2500, 5000, 9000])
        ev.append((1, i, at, at + 300.0))
        at += 300
    pts = [(1, i, float(rng.uniform(0, at + 6000))) for i in range(150)]

    def state(t, h):
        for _, _, s, e in ev:
            if s <= t <= e:
                return 2
            if e < t <= e + config.post_seconds:
                return 3
        for _, _, s, _e in ev:
            if s - config.pre_seconds <= t < s:
                ended = [b for *_, b in ev if b < t]
                if ended and t - max(ended) < config.recovery_seconds:
                    return 3
                if s - t <= h:
                    return 1
        return 0

    out = states.state_labels(spark.createDataFrame(pts, "k int, seq_idx int, anchor_s double"), spark.createDataFrame(ev, "k int, event_index int, start_s double, end_s double"), ["k"], ["seq_idx"], "anchor_s", config).collect()
    for r in out:
        assert [r[f"state_{h}"] for h in config.horizons_seconds] == [state(r.anchor_s, h) for h in config.horizons_seconds], r


def test_wilson_published_values(spark):
    rows = spark.createDataFrame([(1, 6), (3, 6), (0, 0)], "k int, n int").select("k", fn.wilson(F.col("k"), F.col("n")).alias("w")).collect()
    got = {r.k: (r.w.low, r.w.high) for r in rows}
    assert [round(x, 4) for x in got[1]] == [0.0301, 0.5635] and [round(x, 4) for x in got[3]] == [0.1876, 0.8124]


def test_scalar_edges(spark):
    r = spark.range(1).select(
        fn.bankers_round(F.lit(2.5)).alias("even"), fn.quantize_int8(F.lit(-0.25), 0.1, 0).alias("q"), fn.quantize_int8(F.lit(99.0), 0.1, 0).alias("most"), fn.format_or_na(F.lit(float("nan"))).alias("na"),
        fn.parse_fraction(F.lit("x")).alias("bad"), fn.patient_id(F.lit("/a/Mayo_1/Mayo_22/f")).alias("p"), fn.format_elapsed(F.lit(3723)).alias("t"), fn.offset_policy(F.lit(5.0), F.lit(None).cast("double")).alias("end")).first()
    assert (r.even, r.q, r.most, r.na, r.bad.detected, r.p, r.t, r.end) == (2.0, -3, 127, "n/a", None, "Mayo_22", "1h 02m 03s", 305.0)
    with pytest.raises(ValueError):
        fn.channel_mask({"eda": F.lit(1)}, ["hr"])


SENSOR = {"fast": "100\n4\n1,2,3\n4,5,6\n", "odd": "﻿100\n4\n1\nNA\n\n3\n", "short": "100\n4\n", "bad": "x\n4\n1\n"}


@pytest.mark.parametrize("name,mode,n", [("fast", "fast", 2), ("fast", "strict", 2), ("odd", "fast", None), ("odd", "tolerant", 2), ("short", "strict", None), ("short", "fast", None), ("bad", "tolerant", None)])
def test_sensor_modes(spark, tmp_path, name, mode, n):
    (tmp_path / "a.csv").write_bytes(SENSOR[name].encode())
    assert (sensors.read_sensors(spark, str(tmp_path), mode).count() or None) == n


def test_sources_and_sessions(spark, tmp_path):
    for p, s in (("Mayo_1", "100_a"), ("Mayo_2", "100_a")):
        d = tmp_path / p / "Empatica_Chronic" / s
        d.mkdir(parents=True)
        for k in ("ACC", "BVP", "EDA", "TEMP") if p == "Mayo_1" else ("ACC",):
            (d / f"{k}.csv").write_text("100\n4\n1\n2\n3")
    (tmp_path / "Mayo_1" / "times.txt").write_text("500, 700\nfoo\n100\n\n300\t200\n")
    (tmp_path / "Mayo_1" / "readme.txt").write_text("1\n")
    rows = sensors.read_sensors(spark, str(tmp_path)).collect()
    assert len(rows) == 15 and {r.rate_hz for r in rows} == {4.0}
    assert {r.n for r in sensors.probe_sensors(spark, str(tmp_path), count_rows=True).collect()} == {3}
    s = {r.patient_id: r for r in sensors.list_sessions(spark, str(tmp_path)).collect()}
    assert s["Mayo_1"].is_valid and not s["Mayo_2"].is_valid and s["Mayo_1"].session_id == "100_a"
    assert [r.path.rsplit("/", 1)[1] for r in labels.find_label_files(spark, str(tmp_path)).collect()] == ["times.txt"]
    assert sorted(r.onset_s for r in labels.read_labels(spark, str(tmp_path / "Mayo_1")).collect()) == [1.0, 100.0, 300.0, 500.0]
    lines = spark.createDataFrame([("f", x) for x in ("500, 700", "foo", "100", "", "300\t200")], "path string, value string")
    got = sorted((r.onset_s, r.second_s) for r in labels.parse_label_lines(lines).orderBy("onset_s").collect() if r.second_s)
    assert got == [(300.0, 200.0), (500.0, 700.0)] and labels.parse_label_lines(lines).count() == 3


def test_sinks(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert writers.cached(spark, str(tmp_path / "cache"), {"b": 1, "a": 2}, build).count() == 3
    assert len(built) == 1 and writers.cache_key({"a": 2, "b": 1}) == writers.cache_key({"b": 1, "a": 2})
    df = spark.createDataFrame([(1, 0.5), (2, None)], "k int, v double")
    writers.write_json(df, str(tmp_path / "j"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"k":1,"v":0.5}', '{"k":2,"v":null}']
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.json").write_text('{"k": 1,\n "other": 2}')
    (tmp_path / "docs" / "b.json").write_text("{broken")
    assert sorted(str(r.k) for r in archives.read_json(spark, str(tmp_path / "docs"), "k int").collect()) == ["1", "None"]
    assert "| 2 | n/a |" in writers.markdown(df)
    writers.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_audit_rollup(spark):
    facts = spark.createDataFrame([(1, 3), (2, None), (3, 9)], "k int, n int")
    checks = audit.evaluate(facts, [("many", F.col("n") > 5, "warn"), ("some", F.col("n") > 0, "fail")], ["k"])
    assert {r.k: r.status for r in audit.overall(checks, ["k"]).collect()} == {1: "warn", 2: "fail", 3: "pass"}
    lines = spark.createDataFrame([("f", "START TSMIXER 2026-07-20T01:13:40"), ("f", "END TSMIXER 2026-07-22T10:41:53"), ("f", "note")], "file string, value string")
    w = audit.status_windows(lines, "TSMIXER").first()
    assert str(w.start) == "2026-07-20 01:13:40" and str(w.end) == "2026-07-22 10:41:53"


def test_selection_keeps_first_of_equals(spark):
    grid = spark.createDataFrame([(3, 1.0), (1, 1.0), (5, 0.5)], "k int, value double")
    assert selection.select_smoothing(grid).first().k == 1
    nan = spark.createDataFrame([("a", float("nan")), ("b", 0.1)], "name string, auc double").selectExpr("name", "1 AS detected_events", "1.0D AS recall", "1.0D AS false_alarms_per_hour", "auc")
    assert selection.best_baseline(nan).first().name == "b"


def test_group_statistics(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", float("nan")), ("c", 1.0), ("c", 3.0)], "g string, v double")
    got = {r.g: (r.v_mean, r.v_sd) for r in summary.group_mean_sd(rows, "g", ["v"]).collect()}
    assert got == {"a": (1.0, 0.0), "b": (None, None), "c": (2.0, 2**0.5)}


def test_resampling_edges(spark):
    one = spark.createDataFrame([(1, 0, 7.0)], "k int, i long, v double")
    to = spark.createDataFrame([(1, 4)], "k int, n long")
    assert [r.v for r in resample.interpolate(one, ["k"], "v", 1.0, to, 2.0).collect()] == [7.0] * 4
    assert resample.downsample_mean(one, ["k"], "v").count() == 0
    assert [r.v for r in resample.hold(one, ["k"], "v", to, 8).collect()] == [7.0] * 4


def test_windows_need_full_length(spark):
    rows = windows.index_rows(spark.createDataFrame([(1, t) for t in range(9)], "k int, t int"), ["k"], ["t"])
    assert windows.count_windows(rows, ["k"], 10, 10, {"n": F.count("t")}).count() == 0
    assert sorted(r.a for r in windows.count_windows(rows, ["k"], 4, 2, {"a": F.min("t")}).collect()) == [0, 2, 4]


def test_confusion_guards(spark):
    r = metrics.confusion_metrics(spark.createDataFrame([(0.1, 0)], "p double, y int"), "p", "y", 0.5).first()
    assert (r.precision, r.recall, r.f1, r.accuracy) == (0.0, 0.0, 0.0, 1.0)


def test_stream_equals_batch_across_triggers(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted((1_700_000_000 + rng.randint(0, 40_000), k, rng.random()) for k in range(3) for _ in range(60))
    df = spark.createDataFrame([(t, k, p) for t, k, p in rows], "t long, k int, p double").select(F.timestamp_seconds("t").alias("ts"), "k", "p")
    for i in range(4):
        part = rows[i * 45 : (i + 1) * 45]
        spark.createDataFrame(part, "t long, k int, p double").select(F.timestamp_seconds("t").alias("ts"), "k", "p").coalesce(1).write.parquet(str(tmp_path / "in" / f"x={i}"))
    # alerts come when the watermark has passed them: a row two days later, of a key without alerts, closes the others
    spark.createDataFrame([(1_700_000_000 + 200_000, 9, 0.0)], "t long, k int, p double").select(F.timestamp_seconds("t").alias("ts"), "k", "p").coalesce(1).write.parquet(str(tmp_path / "in" / "x=4"))
    for i, f in enumerate(sorted((tmp_path / "in").glob("*/*.parquet"))):
        f.rename(tmp_path / f"part-{i}.parquet")
    src = online.read_stream(spark, str(tmp_path), "part-*.parquet", df.schema)
    got = {(r.k, r.ts.timestamp()) for r in online.drain(online.refractory(src, "k", "ts", "p", 0.5, 600.0, "1 day"), str(tmp_path / "out")).collect()}
    want, last = set(), {}
    for t, k, p in rows:
        if p >= 0.5 and t - last.get(k, -1e9) > 600:
            want.add((k, float(t)))
            last[k] = t
    assert got == want


def test_array_scorer(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0]), (2, [0.0, 0.0])], "k int, v array<double>")
    assert {r.k: r.p for r in scoring.ArrayScorer("v", lambda x: x.mean(axis=1)).score(df).collect()} == {1: 2.0, 2: 0.0}


def plain_run(sections, x):
    """The recursion sample by sample."""
    y = x.astype(float)
    for s in sections:
        b0, b1, b2, _, a1, a2 = map(float, s)
        z1, z2 = dsp._steady(s) * y[0]
        out = np.empty_like(y)
        for i, v in enumerate(y.tolist()):
            out[i] = b0 * v + z1
            z1, z2 = b1 * v - a1 * out[i] + z2, b2 * v - a2 * out[i]
        y = out
    return y


@pytest.mark.parametrize("n", [2, 3, 127, 128, 129, 3000])
def test_block_recursion(n):
    x = np.random.default_rng(n).normal(size=n).cumsum()
    for sections in (dsp.butterworth(3, (2.0, 8.0), 32.0, "band"), dsp.butterworth(2, 0.05, 4.0, "high")):
        assert np.abs(plain_run(sections, x) - dsp._run(sections, x)).max() < 1e-7 * (1 + np.abs(x).max())


def test_prominence_and_distance_by_definition():
    rng = np.random.default_rng(5)

    def prominent(x, p):
        left = [i for i in range(p) if x[i] > x[p]]
        right = [i for i in range(p + 1, len(x)) if x[i] > x[p]]
        return x[p] - max(x[left[-1] + 1 if left else 0 : p + 1].min(), x[p : right[0] if right else len(x)].min())

    for _ in range(100):
        x = np.round(rng.normal(size=rng.integers(3, 60)) * 2)
        every = dsp.find_peaks(x)
        kept = set()
        for k in sorted(every, key=lambda p: (-x[p], -p)):
            if all(abs(k - q) >= 4 for q in kept):
                kept.add(k)
        assert dsp.find_peaks(x, 4).tolist() == sorted(kept)
        for least in (0.5, 2.0, 3.0):
            assert dsp.find_peaks(x, 1, least).tolist() == [p for p in every if prominent(x, p) >= least]


def test_long_signals_take_seconds():
    x = np.random.default_rng(1).normal(size=1_000_000)
    began = time.time()
    dsp.band_pass(32.0)(x)
    dsp.heart_rate(x, 64.0)
    assert time.time() - began < 20


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_whole_sessions_from_frames_that_cut_them(size):
    rows = pd.DataFrame({"k": [None] * 3 + [1.0] * 5 + [2.0] + [3.0] * 9 + [4.0, 5.0], "j": ["a"] * 10 + ["b"] * 10, "i": range(20)})
    want = [g["i"].tolist() for _, g in rows.groupby(["k", "j"], sort=False, dropna=False)]
    got = []
    for frame, starts in sessions.whole_sessions((rows.iloc[a : a + size] for a in range(0, 20, size)), ["k", "j"]):
        got += [part.tolist() for part in np.split(frame["i"].to_numpy(), starts[1:])]
    assert got == want
