"""The pipeline: each stage against a plain restatement on its own input."""

from collections import Counter

import corpus_pipeline as P
import duckdb
from test_quality_crf import plain_score
from test_simhash import brute_components
from wavelake.llm import common, decontam, mixing, quality_crf


def sql(text, docs, sf, *columns):
    """Rows of an operator's SQL on a stage's input."""
    c = duckdb.connect()
    files = ", ".join(f"'{f.removeprefix('file://')}'" for f in docs.inputFiles())
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet([{files}])")
    c.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf}/benchmark.parquet'")
    return c.execute(f"SELECT {', '.join(columns)} FROM ({text})").fetchall()


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    outs = []
    for name, stage in P.STAGES:
        docs = common.materialize(stage(spark, docs, sf), name)
        outs.append(docs)
        if name != "packing":
            assert docs.columns == columns
    start = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [Counter(r.doc_id for r in d.select("doc_id").collect()) for d in [start, *outs]]
    field = quality_crf.fit(start, spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"))
    assert rows[1] == Counter(r.doc_id for r in start.collect() if plain_score(field, r.text) >= 0.3)
    texts = [(r.doc_id, r.text) for r in outs[0].collect()]
    assert rows[2] == Counter(set(brute_components(texts)[0].values()))
    assert rows[3] == Counter({d: 1 for d, near in sql(decontam.OP3_SQL, outs[1], sf, "doc_id", "n_near") if not near}) and rows[3] != rows[2]
    assert rows[4] == Counter({d: taken // size for d, taken, size in sql(mixing.OP8_SQL, outs[2], sf, "doc_id", "taken", "size") if taken})
    packed = outs[4].where("segment = 0")
    assert Counter(r.doc_id for r in packed.collect()) == rows[4]
    assert {(r.doc_id, r.text) for r in outs[3].collect()} <= {(r.doc_id, r.text) for r in start.collect()}


def test_run(spark, sf):
    assert P.run(spark, sf).count() > 0


def test_clashing_columns(spark, sf):
    names = ["row", "n_hit", "score", "pass", "size", "key", "items", "hits", "lost", "id", "label", "nth", "times", "target", "word", "t_doc_id", "found", "__found", "fp"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.selectExpr("*", *(f"concat('{n}', doc_id) AS `{n}`" for n in names))
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf), name)
        assert docs.columns == columns
    assert docs.where(" or ".join(f"`{n}` != concat('{n}', doc_id)" for n in names)).count() == 0
    assert P.pack(spark, docs, sf).count() > 0
