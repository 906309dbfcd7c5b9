"""The corpus pipeline: quality, near-duplicates, decontamination, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  All but the
last return the columns of ``docs``:

1. ``quality``: documents that the line field rejects go.
2. ``near_duplicates``: of each component of near copies the document with the least doc_id stays.
3. ``decontamination``: documents with a passage of the benchmark go.
4. ``mixing``: each document is repeated as often as the mix takes it, possibly not at all.
5. ``packing``: the rows become packed shards in the shared folder; the result lists every segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavelake.llm import common, decontam, mixing, packing, quality_crf, simhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_crf.keep_good(docs, common.table(spark, sf_dir, "labels").select("doc_id", "quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, common.scratch(spark, "shards"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return docs


#: The line field and the fingerprints have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None
