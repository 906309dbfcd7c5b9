"""Writers.  Tables stay distributed; only finished reports of bounded size are rendered by the driver."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cache_key(config: dict[str, Any]) -> str:
    """sha256 of a configuration's canonical JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def fingerprint(spark: SparkSession, inputs: Sequence[str]) -> str:
    """sha256 of names, sizes and times of all files under ``inputs``, from listings alone; a missing input counts as none."""
    found = []
    for at in sorted(inputs):
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            files = fs.listFiles(path, True)
            while files.hasNext():
                f = files.next()
                found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(found)).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, config: dict[str, Any], build: Callable[[], DataFrame], inputs: Sequence[str] = ()) -> DataFrame:
    """The table of a configuration and the files under ``inputs``: read if it was published before, else built, published and read.

    A table is written beside its place, under a name that Spark never reads, and published by one rename, so no reader
    meets half of it.  Of two writers the first to rename is read by both; changed inputs have another key.
    """
    key = cache_key({"config": config, "inputs": fingerprint(spark, inputs)} if inputs else config)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{key}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        own = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/.{key}-{uuid.uuid4().hex}")
        build().write.parquet(own.toString())
        fs.rename(own, path)
        # where another writer was first, a rename fails or moves this copy inside the other, hidden by its name
        for left in (own, spark._jvm.org.apache.hadoop.fs.Path(path, own.getName())):
            if fs.exists(left):
                fs.delete(left, True)
    return spark.read.parquet(path.toString())


def write_json(df: DataFrame, path: str, keep_null: bool = True) -> None:
    """One JSON document per row; undefined values are null."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": str(not keep_null).lower()}).alias("value")).write.mode("overwrite").text(path)


def write_documents(df: DataFrame, path: str, by: str) -> None:
    """A JSON file for each value of ``by``, in a folder of its own."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).json(path)


def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    w = df.write.mode("overwrite").option("header", "true")
    (w.partitionBy(by) if by else w).csv(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A Markdown table of a report; raises beyond ``most`` rows, which no report has."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    show = lambda x: "n/a" if x is None or x != x else f"{x:.4f}" if isinstance(x, float) else str(x)
    return "\n".join(["| " + " | ".join(c) + " |" for c in (df.columns, ["---"] * len(df.columns))] + ["| " + " | ".join(map(show, r)) + " |" for r in rows]) + "\n"
