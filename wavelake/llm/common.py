"""What the training-data operators share: shared scratch tables, word splitting, checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialize, scratch

#: Separators between words of the two word classes, as Java regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(df: DataFrame) -> None:
    """Delete the folder of a table that `materialize` made; nothing may read it later."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/wavelake/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 64 << 20) -> DataFrame:
    """Hint a broadcast only after counting at most ``max_rows`` rows of ``max_bytes`` as text; beyond that Spark shuffles."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))
    rows, held = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and held <= max_bytes else df


def sample_by_hash(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The rows with the n least hashes of ``keys``, n at most: the same at every run, whatever the partitions.

    Only hashes are sorted; the cut then filters the scan.  Of rows equal in ``keys`` one stays.
    """
    h = F.xxhash64(*keys)
    cut = df.select(h.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return df.where(h <= (0 if cut is None else cut)).dropDuplicates([*keys])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def space_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def alnum_words(text: Column) -> Column:
    """Words of letters, digits and all code points from U+0080, case kept; see `ascii_lower`."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NOT_ALNUM), "")


def ascii_lower(s: Column) -> Column:
    """Lower-case A-Z and nothing else.  Plain ASCII takes the byte-wise path."""
    return F.when(F.length(s) == F.octet_length(s), F.lower(s)).otherwise(F.translate(s, UPPER, LOWER))
