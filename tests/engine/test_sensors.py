"""Sensor files split over many tasks against parsing each file whole."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from wavelake import queries
from wavelake.sources import labels, listing, sensors

MISSING = {"", "na", "nan", "n/a", "null"}


def number(field):
    try:
        return None if field.strip().lower() in MISSING else float(field)
    except ValueError:
        return None


def parse(text, mode):
    """(start, rate, rows) of one file's whole text, or None where the mode rejects it."""
    lines = text.splitlines()
    if len(lines) < 3 or None in (start := [number(x.split(",")[0]) for x in lines[:2]]):
        return None
    rows = [[number(f) for f in x.split(",")] for x in lines[2:] if x.strip()]
    if mode != "tolerant":
        return (*start, rows) if rows and not any(None in r or len(r) != len(rows[0]) for r in rows) else None
    rows = [r for r in rows if any(x is not None for x in r)]
    if not rows:
        return None
    width = max(map(len, rows))
    frame = pd.DataFrame([r + [None] * (width - len(r)) for r in rows], dtype=float).dropna(axis=1, how="all")
    return *start, frame.ffill().bfill().fillna(0.0).to_numpy().tolist()


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def texts():
    rng = random.Random(2)
    out = {
        "plain": "100.5,100.5\n4,4\n" + "".join(f"{i},{i * 2},-{i}.5e0\n" for i in range(900)),
        "gaps": "7\n32\n" + "".join(rng.choice(["NA,1\n", ",\n", "\n", f"{i},NaN\n", f"{i}\n", f"x,{i}\n", f" {i} , {i}\n"]) for i in range(900)),
        "late": "7\n32\n" + "NA,,\n" * 200 + ",,5\n" + "3,NA,NA\n" * 200,
        "blanks": "1\n2\n" + "5\n\n  \n" * 150, "crlf": "1\r\n2\r\n" + "5\r\n6\r\n" * 150, "wide_head": "1," + "0" * 3000 + "\n2," + "0" * 3000 + "\n1\n2\n", "long_row": "1\n2\n" + ",".join(["1"] * 200) + "\n" + ",".join(["2"] * 200),
        "ragged": "1\n2\n1,2\n3\n", "bad_late": "1\n2\n" + "5\n" * 500 + "oops\n", "no_end": "1\n2\n3\n4", "two": "1\n2\n", "one": "1\n", "empty": "", "head": "x\n2\n3\n", "blank_head": "\n1\n2\n3\n", "only_blank": "1\n2\n\n\n", "special": "1\n2\ninf\n-2e3\n.5\n5.\n", "java": "1\n2\n1.0d\n",
    }
    return out


@pytest.mark.parametrize("mode", ["fast", "tolerant", "strict"])
def test_split_files_equal_whole_ones(spark, tmp_path, small_blocks, mode):
    for name, text in texts().items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    got = sensors.read_sensors(spark, str(tmp_path), mode)
    found = {}
    for r in got.orderBy("path", "sample_idx").collect():
        found.setdefault(r.path.rsplit("/", 1)[1][:-4], []).append(r)
    for name, text in texts().items():
        want = parse(text, mode)
        rows = found.get(name, [])
        assert bool(rows) == bool(want), name
        if want:
            assert [r.sample_idx for r in rows] == list(range(len(want[2]))), name
            assert {(r.start_s, r.rate_hz) for r in rows} == {tuple(want[:2])}, name
            assert [list(r.v) for r in rows] == want[2], name


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_blocks):
    x = np.arange(20_000)
    (tmp_path / "a.csv").write_text("0\n64\n" + "\n".join(map(str, x)))
    assert sensors._text(spark, str(tmp_path), "*.csv").rdd.getNumPartitions() > 30
    rows = sensors.read_sensors(spark, str(tmp_path))
    assert rows.where(F.get("v", F.lit(0)) != F.col("sample_idx")).count() == 0 and rows.count() == len(x)
    assert sensors.probe_sensors(spark, str(tmp_path), count_rows=True).collect()[0].n == len(x)


def test_no_files_with_samples(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    for mode in sensors.MODES:
        assert sensors.read_sensors(spark, str(tmp_path), mode).count() == 0
    with pytest.raises(ValueError):
        sensors.read_sensors(spark, str(tmp_path), "loose")


def test_a_sensor_file_is_written_whole(spark):
    # both sides of the union are dealt by user; their parts are put together by size, each side by itself
    conf = {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        folder = queries.sensor_files(spark, "/root/testdata/sf0.001")
        files = spark.read.text(f"{folder}/*").select("_metadata.file_path").distinct().count()
        users = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id").distinct().count()
    finally:
        for k in conf:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert files == users == 15


def test_listing_by_tasks(spark, tmp_path):
    names = ["a.csv", "b.txt", "one/a.csv", "one/two/three/c.csv", "one/.hidden.csv", "_no/a.csv", "_k=1/a.csv", "one/empty.csv", "one two/d.csv", "one/new\nline.csv"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("" if "empty" in n else "1\n")
    (tmp_path / "empty").mkdir()
    got = {r.path for r in listing.list_files(spark, str(tmp_path), "*.csv").collect()}
    assert got == {f"file:{tmp_path}/{n}" for n in ("a.csv", "one/a.csv", "one/two/three/c.csv", "_k=1/a.csv", "one two/d.csv", "one/new\nline.csv")}
    assert listing.list_files(spark, f"{tmp_path}/*", "a.csv").count() >= 2  # a pattern goes to Spark
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "x.txt").write_bytes("1\r\n2 3\n\xe9\n4".encode("latin-1"))
    lines = listing.read_lines(listing.list_files(spark, f"{tmp_path}/labels", "*.txt"))
    assert sorted(r.value for r in lines.collect()) == ["1", "2 3", "4", "�"]


def test_small_files_take_few_tasks(spark, tmp_path):
    rows = spark.range(3000).selectExpr("concat('d', id % 1000, '/', id, '.txt') AS path", "CAST(id AS string) AS value")
    listing.write_lines(rows, [], f"file://{tmp_path}")
    before = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("small files", "")
    try:
        assert sorted(r.onset_s for r in labels.read_labels(spark, str(tmp_path)).collect()) == list(range(3000))
        jobs = [before.getJobInfo(j) for j in before.getJobIdsForGroup("small files")]
        assert sum(before.getStageInfo(s).numTasks for j in jobs for s in j.stageIds if before.getStageInfo(s)) < 200
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_sessions_by_listing(spark, tmp_path):
    names = ["Mayo_1/s/a_dev/ACC.csv", "Mayo_1/s/a_dev/bvp.csv", "Mayo_1/s/a_dev/EDA.csv", "Mayo_1/s/a_dev/TEMP.csv", "Mayo_1/s/a_dev/HR.old.csv", "Mayo_2/new\nline_dev/HR.csv", "Mayo_2/none/ACC.csv"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("1\n")
    got = {(r.patient_id, r.session_id, tuple(r.sensors), r.has_acc, r.has_hr, r.is_valid) for r in sensors.list_sessions(spark, str(tmp_path)).collect()}
    assert {x[1:] for x in got} == {("a_dev", ("", "ACC", "BVP", "EDA", "TEMP"), True, False, True), ("new\nline_dev", ("HR",), False, True, False)}


def test_small_files_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(400).selectExpr("concat('d', id div 4, '/', id, '.txt') AS path", "CAST(id AS string) AS value")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("written files", "")
    try:
        listing.write_lines(rows, [], f"file://{tmp_path}")
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("written files")]
        stages = {s: tracker.getStageInfo(s) for j in jobs for s in j.stageIds}
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    writing = [s.numCompletedTasks for s in stages.values() if s and s.numTasks == s.numCompletedTasks]
    assert writing.count(int(spark.conf.get("spark.sql.shuffle.partitions"))) >= 2  # the range and the files
    assert sorted(int(p.read_text()) for p in tmp_path.glob("*/*.txt")) == list(range(400)) and not list(tmp_path.glob("*/.*"))


@pytest.mark.parametrize("name", ["read_sensors", "read_sensors_strict", "read_sensors_tolerant", "probe_sensors", "read_labels"])
def test_unknown_values_and_users_are_kept(spark, tmp_path, name):
    # one user has an unknown value, one no other, one is unknown; values at the ends of what doubles hold
    duckdb.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i * 7) MINUTE AS ts, CASE WHEN i % 5 < 4 THEN i % 5 - 1 END AS user_id, CASE WHEN i % 2 = 0 THEN 'error' ELSE 'view' END AS event_type,
        CASE WHEN i % 5 = 0 OR i = 6 THEN NULL WHEN i = 12 THEN CAST('-inf' AS DOUBLE) WHEN i = 13 THEN 4.9e-324 ELSE i * 1e20 / 3 END AS value, '' AS props FROM range(50) t(i)) TO '{tmp_path}/events.parquet'""")
    got = queries.QUERIES[name](spark, str(tmp_path)).toPandas()
    want = duckdb.connect().execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'").execute(queries.ORACLE_SQL[name]).df()
    plain = lambda df: sorted((tuple(None if pd.isna(x) else float(x) for x in r) for r in df[sorted(want.columns)].astype(object).itertuples(index=False)), key=repr)
    assert plain(got) == plain(want)


def test_blocks_hold_each_line_once(spark, tmp_path):
    rng = random.Random(3)
    want = {}
    for i in range(6):
        text = "".join("x" * rng.randrange(9) + rng.choice(["\n", "\r\n", "\n\n"]) for _ in range(rng.randrange(1, 12))) + rng.choice(["", "é", "a\rb\n"])
        (tmp_path / f"{i} .csv").write_bytes(text.encode())
        want[f"{i} .csv"] = text.replace("\r\n", "\n").replace("\r", "\n").removesuffix("\n").split("\n")
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbf1\n2")
    want["bom.csv"] = ["1", "2"]
    for block in (5, 64, 1 << 20):
        found = {}
        for r in listing.read_blocks(listing.list_files(spark, str(tmp_path), "*.csv"), block).withColumn("at", F.monotonically_increasing_id()).orderBy("path", "block", "at").collect():
            found.setdefault(r.path.rsplit("/", 1)[1], []).append(r.value)
        assert found == want, block


def test_files_of_sensors_are_listed_by_tasks(spark, tmp_path):
    listing.write_lines(spark.range(600).selectExpr("concat('d', id div 3, '/data.csv') AS path", "CAST(id AS string) AS value"), ["value"], f"file://{tmp_path}")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("sensors listed", "")
    try:
        assert sensors.read_sensors(spark, str(tmp_path)).count() == 200 == sensors.probe_sensors(spark, str(tmp_path), count_rows=True).where("n = 1").count()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("sensors listed")]
        assert max(s.numTasks for j in jobs for i in j.stageIds if (s := tracker.getStageInfo(i))) < 100  # Spark's listing takes one a folder
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_label_files_are_found_by_tasks(spark, tmp_path):
    rows = spark.range(300).selectExpr("concat('Mayo_', id % 100, IF(id < 100, '/', concat('/s', id, '/')), 'times ', id, '.txt') AS path", "CAST(id AS string) AS value")
    listing.write_lines(rows, [], f"file://{tmp_path}")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("labels found", "")
    try:
        found = {r.patient_id: r.path.rsplit("/", 1)[1] for r in labels.find_label_files(spark, str(tmp_path)).collect()}
        lines = sorted(r.onset_s for r in labels.read_labels(spark, str(tmp_path)).collect())
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("labels found")]
        assert max(s.numTasks for j in jobs for i in j.stageIds if (s := tracker.getStageInfo(i))) < 100  # Spark's listing takes one a folder
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert found == {f"Mayo_{i}": f"times {i}.txt" for i in range(100)} and lines == list(range(300))
