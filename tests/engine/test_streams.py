"""Streams over a table that is a folder of part files, a trigger for each."""

import os
import random

import pytest
from pyspark.errors import AnalysisException
from wavelake import queries
from wavelake.streaming import online

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["stream_refractory", "stream_ring_windows", "stream_windows", "stream_sessions"])
def test_folder_of_parts(spark, tmp_path, name):
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id")
    rows = events.collect()
    for at in range(0, len(rows), len(rows) // 3 + 1):
        part = spark.createDataFrame(rows[at : at + len(rows) // 3 + 1], events.schema).coalesce(1)
        part.write.mode("append").parquet(f"{tmp_path}/events.parquet")
    want, got = (sorted(map(tuple, queries.QUERIES[name](spark, sf).collect())) for sf in (SF, str(tmp_path)))
    assert want and got == want


def test_no_file(spark, tmp_path):
    (tmp_path / "events.parquet").mkdir()
    with pytest.raises(AnalysisException):
        queries.QUERIES["stream_refractory"](spark, str(tmp_path))


def test_late_rows_are_dropped(spark, tmp_path):
    # a trigger a file; rows are judged by the watermark of the trigger before: 11:50, so 10:05 is too late and 11:55 is not
    parts = [["10:00"], ["12:00"], ["12:10"], ["10:05", "11:55", "14:00"], ["18:00"]]
    schema = "k int, ts timestamp, value double"
    for i, times in enumerate(parts):
        rows = spark.createDataFrame([(1, f"2026-01-01 {t}:00", 1.0) for t in times], "k int, ts string, value double").selectExpr("k", "CAST(ts AS timestamp) AS ts", "value")
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for f in (tmp_path / "in").glob("*.parquet"):
            if f.stat().st_mtime > 1_000_000:
                os.utime(f, (1000 + i, 1000 + i))
    stream = online.read_stream(spark, f"{tmp_path}/in", "*.parquet", spark.createDataFrame([], schema).schema)
    got = online.drain(online.windowed(stream, "ts", ["k"], "value", "1 hour"), f"{tmp_path}/out").collect()
    assert {r.start.hour: r.n for r in got} == {10: 1, 11: 1, 12: 2, 14: 1}


def arrive(spark, folder, files):
    """Files of (k, second, value, id) rows, in the order they are written."""
    schema = "k int, s double, value double, id int"
    for rows in files:
        spark.createDataFrame(rows, schema).selectExpr("k", "timestamp_micros(CAST(s * 1e6 AS long)) AS ts", "value", "id").coalesce(1).write.mode("append").parquet(folder)
    return online.read_stream(spark, folder, "*.parquet", spark.createDataFrame([], schema).selectExpr("k", "timestamp_micros(CAST(s * 1e6 AS long)) AS ts", "value", "id").schema)


def rows_left(stream, folder):
    """Rows of state when all is read."""
    q = stream.writeStream.option("checkpointLocation", folder).format("noop").trigger(availableNow=True).start()
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"]]) > 3  # several triggers
    return q.lastProgress["stateOperators"][0]["numRowsTotal"]


def shuffled_files(seed=5):
    """Rows of three keys, up to 40 s out of order, over six files; the last file's row lies far ahead and closes all."""
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 2, None]), float(s), float(rng.randint(0, 9)), s) for s in range(1000, 1400)]
    rows.sort(key=lambda r: r[1] + rng.random() * 40)
    return [*(rows[i : i + 80] for i in range(0, 400, 80)), [(9, 100_000.0, 0.0, 999)]], rows


def test_alerts_out_of_order_equal_the_batch(spark, tmp_path):
    files, rows = shuffled_files()
    stream = arrive(spark, f"{tmp_path}/in", files)
    alerts = online.refractory(stream, "k", "ts", "value", 7.0, 12.0, "60 seconds")
    got = sorted(((r.k, r.s) for r in online.drain(alerts, f"{tmp_path}/out").selectExpr("k", "unix_micros(ts) / 1e6 AS s").collect()), key=repr)
    want = []
    for k in (1, 2, None):
        last = None
        for _, s, v, _ in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            if v >= 7 and (last is None or s - last > 12):
                last = s
                want.append((k, s))
    assert got == sorted(want, key=repr) and len(want) > 20
    assert rows_left(online.refractory(arrive(spark, f"{tmp_path}/again", files), "k", "ts", "value", 7.0, 12.0, "60 seconds"), f"{tmp_path}/state") <= 1


def test_rings_out_of_order_equal_the_batch(spark, tmp_path):
    files, rows = shuffled_files(8)
    size, hop = 12, 4

    def rings(folder):
        return online.ring_windows(arrive(spark, folder, files), "k", "ts", "value", size, hop, delay="60 seconds", idle_seconds=9.0, tie="id")

    got = sorted(((r.k, r.seen, tuple(r.q)) for r in online.drain(rings(f"{tmp_path}/in"), f"{tmp_path}/out").collect()), key=repr)
    want = []
    for k in (1, 2, None):
        held, seen, last = [], 0, None
        for _, s, v, _ in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            if last is not None and s - last > 9:
                held, seen = [], 0
            held, seen, last = [*held, int(v)][-size:], seen + 1, s
            if seen % hop == 0 and len(held) == size:
                want.append((k, seen, tuple(held)))
    assert got == sorted(want, key=repr) and len(want) > 15
    assert rows_left(rings(f"{tmp_path}/again"), f"{tmp_path}/state") <= 1  # the key that came last


def many_keys(spark, folder, kind="long"):
    """Four files of a hot row for each of 3,000 keys, large numbers and null among them."""
    k = f"CAST(CASE WHEN id = 7 THEN NULL ELSE 9007199254740993 + id END AS {kind})"
    for i in range(4):
        rows = spark.range(3000).selectExpr(f"{k} AS k", f"timestamp_seconds(100000 + {i} * 1000 + id % 10) AS ts", "CAST(id % 7 AS double) AS value", "CAST(id AS int) AS id")
        rows.coalesce(1).write.mode("append").parquet(folder)
    return online.read_stream(spark, folder, "*.parquet", rows.schema)


def test_keys_share_states(spark, tmp_path):
    alerts = online.refractory(many_keys(spark, f"{tmp_path}/in"), "k", "ts", "value", 0.0, 5000.0, "60 seconds")
    assert 500 < rows_left(alerts, f"{tmp_path}/state") <= 1024  # a row for a key took a call of Python for each
    rings = online.ring_windows(many_keys(spark, f"{tmp_path}/again"), "k", "ts", "value", 2, 1, delay="60 seconds")
    assert 500 < rows_left(rings, f"{tmp_path}/states") <= 1024


def test_keys_keep_their_values(spark, tmp_path):
    want = {None, *(9007199254740993 + i for i in range(3000) if i != 7)}
    for kind in ("long", "string", "decimal(20,0)"):
        rings = online.ring_windows(many_keys(spark, f"{tmp_path}/in-{kind}", kind), "k", "ts", "value", 2, 1, delay="60 seconds")
        got = online.drain(rings, f"{tmp_path}/out-{kind}").collect()
        assert {None if r.k is None else int(r.k) for r in got} == want and len(got) == 2 * len(want), kind
