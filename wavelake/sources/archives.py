"""Documents of finished runs: JSON results, prediction CSVs, logs, office text."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Whole-file JSON documents with ``file``; broken files give a row of nulls with their text in _corrupt."""
    s = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    s = T.StructType([*s.fields, T.StructField("_corrupt", T.StringType())])
    df = spark.read.schema(s).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    return df.withColumn("file", F.input_file_name())


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").schema("y_true int, y_prob double, y_pred int").csv(path)


def read_log(spark: SparkSession, path: str, pattern: str = "*_status.txt") -> DataFrame:
    """(file, modified, value): lines of log files."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), "value")


def office_text(content: bytes) -> str:
    """Text of a word-processor file's main part; empty where there is none."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            xml = z.read("word/document.xml").decode("utf-8", "replace")
    except (zipfile.BadZipFile, KeyError):
        return ""
    return re.sub(r"<[^>]+>", "", re.sub(r"</w:p>", "\n", xml))


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of all .docx files under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "text": [office_text(c) for c in f["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def terms_found(texts: DataFrame, terms: list[str]) -> DataFrame:
    """(path, term): forbidden terms that a text contains, case ignored."""
    return texts.select("path", F.explode(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower("text"), F.lower(t)))).alias("term"))
