"""Label files: one onset per line, with an optional second field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patient_id
from .listing import by_tasks, list_files, read_lines


def parse_label_lines(lines: DataFrame) -> DataFrame:
    """(path, onset_s, second_s) from (path, value): lines without a numeric first field are skipped."""
    fields = F.split(F.trim("value"), r"[,\s]+")
    number = lambda i: F.get(fields, F.lit(i)).try_cast("double")
    return lines.select("path", number(0).alias("onset_s"), number(1).alias("second_s")).where("onset_s is not null")


def find_label_files(spark: SparkSession, path: str, prefix: str = "Mayo_") -> DataFrame:
    """(patient_id, path): each patient's first text file that is no info or readme, shallow and early names first."""
    files = list_files(spark, path, "*.txt").select("path")
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    rows = files.where(~name.contains("info") & ~name.contains("readme")).withColumn("patient_id", patient_id(F.col("path"), prefix))
    order = Window.partitionBy("patient_id").orderBy(F.size(F.split("path", "/")), "path")
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("patient_id", "path")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(path, onset_s, second_s) of all label files under ``path``; order by onset_s where order matters."""
    if by_tasks(spark, path):
        lines = read_lines(list_files(spark, path, "*.txt")).withColumn("path", F.regexp_replace("path", "^file:/(?!/)", "file:///"))
    else:
        lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path).select(F.input_file_name().alias("path"), "value")
    return parse_label_lines(lines)
