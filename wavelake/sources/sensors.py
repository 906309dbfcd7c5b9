"""Sensor files: line 1 start time, line 2 rate, then one row of values per sample.

A file is one ordered record, but no task reads it whole: it is split by bytes like any text, and each
line keeps the block it came from and its place there.  The lines are parsed and written once; counts by
block, added up, then give every line its number in the file, so the two header lines are known wherever
they lie, and every sample its index.  Only blocks with gaps need a window, of a block's rows at most.
What goes from block to block, counts, last values before and the file's verdict, is a row a block.

Three modes differ in what they tolerate:

* ``fast``: numbers only; an unreadable value or rows of different widths drop the file, blank lines are passed over;
* ``tolerant``: whatever is no number is null; rows and columns without any number go; nulls are filled forwards,
  then backwards, then by 0;
* ``strict``: as fast; files of fewer than three lines are dropped, which have no samples in any mode.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patient_id
from ..scratch import materialize
from .listing import by_tasks, list_files, place, read_blocks

MODES = ("fast", "tolerant", "strict")
#: Bytes that hold the two header lines, for `probe_sensors` alone.
HEAD = 4096
#: Columns of a sensor file at most.
MOST_COLUMNS = 256
_NUMBER = r"(?i)^[+-]?(\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?$"
_INFINITE, _NAN = r"(?i)^[+-]?(inf|infinity)$", r"(?i)^[+-]?nan$"


def _listed(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, size) of the files, with paths as other sources give them."""
    return list_files(spark, path, pattern).withColumn("path", F.regexp_replace("path", "^file:/(?!/)", "file:///"))


def _text(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, block, value): the lines of all files under ``path`` and the byte where the block of each begins."""
    if pattern.endswith((".csv", ".txt")) and by_tasks(spark, path):  # Spark would list the files in the driver, and unpacks others
        return read_blocks(_listed(spark, path, pattern), spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def _values(line: Column, tolerant: bool) -> Column:
    """The fields of a line as numbers, null where they are none; NaN is a number only where it is not a gap."""
    ok = lambda t: t.rlike(_NUMBER) | t.rlike(_INFINITE) | (F.lit(False) if tolerant else t.rlike(_NAN))
    return F.transform(F.transform(F.split(line, ","), lambda x: F.trim(F.replace(x, F.lit("\t"), F.lit(" ")))), lambda t: F.when(ok(t), t.try_cast("double")))


def _over_blocks(blocks: DataFrame, sums: dict[str, str], lasts: dict[str, str]) -> DataFrame:
    """``blocks`` with sums and last values over the blocks before, inside each file."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    added = {n: F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in sums.items()}
    return blocks.withColumns(added | {n: F.last(c, ignorenulls=True).over(before) for n, c in lasts.items()})


def read_sensors(spark: SparkSession, path: str, mode: str = "fast", pattern: str = "*.csv") -> DataFrame:
    """(path, start_s, rate_hz, sample_idx, v: array<double>) from all files under ``path``; times are start_s + sample_idx / rate_hz."""
    if mode not in MODES:
        raise ValueError(f"mode {mode}")
    tolerant = mode == "tolerant"
    v = F.col("v")
    empty = lambda x: x.isNull()
    lines = _text(spark, path, pattern).select("path", "block", F.monotonically_increasing_id().alias("at"), _values(F.col("value"), tolerant).alias("v"), (F.trim(F.replace("value", F.lit("\t"), F.lit(" "))) != "").alias("filled"))
    if tolerant:
        lines = lines.withColumn("filled", F.exists(v, lambda x: x.isNotNull()))
    lines = materialize(lines, "sensor-lines")

    placed = _over_blocks(lines.groupBy("path", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), {"line": "n"}, {})
    placed = materialize(placed.select("path", "block", "first", "line"), "sensor-blocks")
    number = (F.col("line") + F.col("at") - F.col("first")).alias("number")
    numbered = lines.join(placed, ["path", "block"]).withColumn("number", number)
    head = lines.join(placed.where("line < 2"), ["path", "block"]).withColumn("number", number).where("number < 2")
    head = head.groupBy("path").agg(*(F.max(F.when(F.col("number") == i, F.get("v", F.lit(0)))).alias(name) for i, name in enumerate(("start_s", "rate_hz"))))

    data = numbered.where("number >= 2")
    wide = data.where("filled").agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0] if tolerant else 0
    if wide > MOST_COLUMNS:
        raise ValueError(f"a line of {wide} fields")
    at = lambda c: F.get("v", F.lit(c))
    gap = ~F.col("filled") | (F.exists(v, empty) | (F.size(v) < wide) if tolerant else F.lit(False))
    aggs = {"samples": F.count_if("filled"), "gaps": F.count_if(gap), "broken": F.count_if(F.col("filled") & F.exists(v, empty)), "least": F.min(F.when(F.col("filled"), F.size(v))), "most": F.max(F.when(F.col("filled"), F.size(v)))}
    for c in range(wide):
        aggs |= {f"first{c}": F.min_by(at(c), F.when(at(c).isNotNull(), F.col("at"))), f"last{c}": F.max_by(at(c), F.when(at(c).isNotNull(), F.col("at")))}
    blocks = data.groupBy("path", "block", "first", "line").agg(*(e.alias(n) for n, e in aggs.items()))
    blocks = _over_blocks(blocks, {"index": "samples"}, {f"carry{c}": f"last{c}" for c in range(wide)})
    whole = Window.partitionBy("path")
    in_order = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.withColumns({f"fill{c}": F.first(f"first{c}", ignorenulls=True).over(in_order) for c in range(wide)})
    sound = F.lit(True) if tolerant else (F.sum("broken").over(whole) == 0) & (F.min("least").over(whole) == F.max("most").over(whole))
    blocks = blocks.withColumn("sound", sound).where("sound").join(head.where("start_s is not null and rate_hz is not null"), "path")
    blocks = materialize(blocks.drop("samples", "broken", "least", "most", "sound", *(f"{x}{c}" for x in ("first", "last") for c in range(wide))), "sensor-blocks")

    rows = lines.join(blocks, ["path", "block"]).withColumn("number", number).where("number >= 2")
    full = rows.where("gaps = 0").withColumn("sample_idx", F.col("index") + F.col("number") - F.greatest(F.col("line"), F.lit(2)))
    here = Window.partitionBy("path", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    holed = rows.where("gaps > 0").withColumn("sample_idx", F.col("index") + F.count_if("filled").over(here) - 1)
    if tolerant:
        value = lambda c: F.coalesce(F.last(at(c), ignorenulls=True).over(here), F.col(f"carry{c}"), F.col(f"fill{c}"))
        columns = [F.struct(F.col(f"fill{c}").isNotNull().alias("held"), value(c).alias("x")) for c in range(wide)]
        filled = F.transform(F.filter(F.array(*columns), lambda s: s["held"]), lambda s: s["x"]) if columns else v
        holed = holed.withColumn("v", filled)
    columns = ["path", "start_s", "rate_hz", F.col("sample_idx").cast("long").alias("sample_idx"), "v"]
    return full.select(*columns).unionByName(holed.where("filled").select(*columns))


def probe_sensors(spark: SparkSession, path: str, pattern: str = "*.csv", count_rows: bool = False) -> DataFrame:
    """(path, start_s, rate_hz, n): headers; n counts the data rows, or is 1 where they are not counted.

    A file's first `HEAD` bytes are read; rows are counted by blocks.
    """
    if by_tasks(spark, path):
        files = _listed(spark, path, pattern).select(F.col("path").alias("key"), "path")
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select(F.col("_metadata.file_path").alias("key"), "path")

    def probe(name: str) -> tuple[float, float] | None:
        fs, at = place(name)
        with fs.open_input_stream(at, compression=None) as stream:
            lines = stream.read(HEAD).split(b"\n")[:2]
        try:
            start, rate = (float(x.decode("utf-8-sig").split(",")[0]) for x in lines)
        except ValueError:
            return None
        return start, rate

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [(key, *r) for key, name in zip(f["key"], f["path"], strict=True) if (r := probe(name))]
            yield pd.DataFrame(found, columns=["path", "start_s", "rate_hz"])

    heads = files.mapInPandas(run, "path string, start_s double, rate_hz double")
    if not count_rows:
        return heads.withColumn("n", F.lit(1).cast("long"))
    filled = _text(spark, path, pattern).groupBy("path").agg((F.count_if(F.trim("value") != "") - 2).alias("n"))  # but the header's
    return heads.join(filled, "path")


def sessions_from_files(files: DataFrame, required: tuple[str, ...] = ("ACC", "BVP", "EDA", "TEMP"), prefix: str = "Mayo_") -> DataFrame:
    """(patient_id, session_id, folder, sensors, has_*, is_valid) from a listing with column ``path``; patients' folders begin with ``prefix``.

    A session folder is any folder with ``_`` in its name that holds sensor files; a session is valid with all required files.
    """
    last = lambda c: F.substring_index(c, "/", -1)
    name = F.upper(F.regexp_extract(last("path"), r"^([^.]+)\.[^.]+$", 1))
    rows = files.select(F.expr("left(path, length(path) - length(substring_index(path, '/', -1)) - 1)").alias("folder"), name.alias("sensor")).where(last("folder").contains("_"))
    held = lambda s: F.bool_or(F.col("sensor") == s)
    valid = F.lit(True)
    for s in required:
        valid = valid & held(s)
    g = rows.groupBy("folder").agg(F.sort_array(F.collect_set("sensor")).alias("sensors"), *(held(s).alias(f"has_{s.lower()}") for s in ("ACC", "BVP", "EDA", "TEMP", "HR", "IBI")), valid.alias("is_valid"))
    return g.select(patient_id(F.col("folder"), prefix).alias("patient_id"), last("folder").alias("session_id"), "folder", "sensors", "has_acc", "has_bvp", "has_eda", "has_temp", "has_hr", "has_ibi", "is_valid")


def list_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session folders under a data folder, by listing alone: contents are not read."""
    return sessions_from_files(list_files(spark, path, "*.csv"))
