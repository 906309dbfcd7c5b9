"""Decontamination against brute force, proximity matches, edge cases."""

import re
import time
from collections import Counter

import pytest
from wavelake.llm import common, decontam

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        size = min(10, len(b))
        for s in range(len(b) - size + 1) if b else ():
            for at in range(len(w) - size + 1):
                if w[at : at + size] == b[s : s + size]:
                    hit.update(range(at, at + size))
                    found.add("null" if item is None else str(item))
    return len(w), len(hit), tuple(sorted(found))


def check(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, hits string")
    got = decontam.contamination(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == Counter((d, *brute(t, items)) for d, t, _ in docs)


PASSAGE = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def test_edge_cases(spark):
    p = PASSAGE.split()
    items = [(1, PASSAGE), (2, PASSAGE + " pi rho"), (3, "short one"), (4, None), (5, ""), (6, "... !!"), (None, "of nothing"), (7, "a a a a a a a a a a a"), (7, "other text of the same item id goes here for ten words"), (8, "É é Ünder")]
    docs = [
        (1, None, "x"), (2, "", "x"), (3, " ".join(p), "x"), (3, " ".join(p[:10]), "x"), (4, " ".join(p[:9]), "x"), (5, "ALPHA, " + "; ".join(p[1:11]) + "!", "x"),
        (6, "one short one", "x"), (None, " ".join(["z", *p[3:]]), "x"), (7, "of nothing", "x"), (8, "a " * 200, "x"), (9, "a " * 9, "x"), (10, " ".join([*p[:5], "inserted", *p[5:]]), "x"),
        (11, "other text of the same item id goes here for ten words", "x"), (12, "É é Ünder", "x"), (13, "é é ünder", "x"), (14, " ".join(["w"] * 20_000 + p), "x"), (14, " ".join(["w"] * 20_000 + p), "x"),
    ]
    check(spark, docs, items)


def test_table(spark, sf):
    docs = [(r.doc_id, r.text, "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text) < 6000]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    check(spark, docs, items)


@pytest.mark.parametrize("item", [5, None])
def test_repeated_item_starting_mid_passage(spark, item):
    # a document that begins 20 words into the long text of an id whose other text has 12 words
    long, other = [f"w{i}" for i in range(40)], [f"o{i}" for i in range(12)]
    docs = [(1, " ".join(long[20:]), ""), (2, " ".join(["x", *other]), ""), (3, " ".join(long[:12]), ""), (4, " ".join(other[:9]), "")]
    check(spark, docs, [(item, " ".join(long)), (item, " ".join(other)), (6, "w30 of another id")])


@pytest.mark.parametrize("docs,items", [([], [(1, PASSAGE)]), ([(1, PASSAGE, "")], [])])
def test_empty(spark, docs, items):
    check(spark, docs, items)


def test_long_item(spark):
    body = " ".join(f"w{i % 97} v{i}" for i in range(1500))
    check(spark, [(1, f"x {body} y", ""), (2, " ".join(body.split()[500:520]), "")], [(1, body)])


def test_repetitive_texts(spark):
    # a document and an item of one word over and over: one window, one anchor
    docs = [(1, "a " * 100_000, ""), (2, "b " + "a " * 9 + "b", ""), (3, "a " * 10 + "b", "")]
    d = spark.createDataFrame(docs, "doc_id long, text string, hits string")
    began = time.time()
    got = {r.doc_id: (r.n_hit, r.n_near, tuple(r["items"])) for r in decontam.contamination(d, spark.createDataFrame([(1, "a " * 1000)], "item_id long, text string")).collect()}
    assert got == {1: (100_000, 100_000, ("1",)), 2: (0, 9, ()), 3: (10, 10, ("1",))}
    assert time.time() - began < 60


def test_many_contexts_are_joined_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontam, "CONTEXTS", 1)
    p = PASSAGE.split()
    check(spark, [(1, PASSAGE, ""), (2, " ".join(["x", *p[3:]]), ""), (3, " ".join(p[:9]), ""), (4, "short one", "")], [(1, PASSAGE), (2, PASSAGE), (3, "short one")])


def brute_near(text, items):
    """Stretches of an item's window as it is, without one word, with one inner word changed or one inserted."""
    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        for s in range(len(b) - 9):
            v = b[s : s + 10]
            for at in range(len(w)):
                for size in (9, 10, 11):
                    d = w[at : at + size]
                    if len(d) < size:
                        continue
                    changed = size == 10 and d[0] == v[0] and d[-1] == v[-1] and sum(x != y for x, y in zip(d, v, strict=True)) <= 1
                    lost = size == 9 and any(d == v[:e] + v[e + 1 :] for e in range(10))
                    inserted = size == 11 and any(d[:e] + d[e + 1 :] == v for e in range(1, 10))
                    if changed or lost or inserted:
                        hit.update(range(at, at + size))
                        found.add("null" if item is None else str(item))
        if 0 < len(b) < 10 and any(w[at : at + len(b)] == b for at in range(len(w))):
            found.add("null" if item is None else str(item))
            hit.update(x for at in range(len(w)) if w[at : at + len(b)] == b for x in range(at, at + len(b)))
    return len(hit), tuple(sorted(found))


def test_proximity_matches_are_verified(spark):
    p = PASSAGE.split()
    items = [(1, PASSAGE), (2, "a b a b a b a b a b a a b"), (None, "short one"), (4, " ".join(f"w{i}" for i in range(30)))]
    bodies = [PASSAGE, " ".join(p[:9]), " ".join(p[:8]), " ".join(p[3:12]), "short new one", "a short one", "a b a b a a b a b a b b a", "a x b x a x b x a x b", "b a b a b a b a", " ".join(reversed(p))]
    for e in range(10):
        bodies += [" ".join(["x", *p[:e], "new", *p[e:10], "y"]), " ".join(["x", *p[:e], *p[e + 1 : 10], "y"]), " ".join([*p[:e], "new", *p[e + 1 : 10]])]
    # an edit in each ten words and an edit in each five
    for step in (10, 5):
        bodies += [" ".join("new" if i % step == 4 else f"w{i}" for i in range(30)), " ".join(f"w{i}" for i in range(30) if i % step != 4), " ".join(f"w{i} new" if i % step == 4 else f"w{i}" for i in range(30))]
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = common.materialize(decontam.contamination(docs, b), "near").collect()
    assert {r.doc_id: (r.n_near, tuple(r.near_items)) for r in got} == {i: brute_near(t, items) for i, t in enumerate(bodies)}
    assert all(r.n_hit <= r.n_near for r in got) and sum(r.n_near > 0 and r.n_hit == 0 for r in got) > 25
    assert Counter(r.doc_id for r in decontam.without_contaminated(docs, b).collect()) == Counter(r.doc_id for r in got if r.n_near == 0)


def test_proximity_with_terms_not_in_the_corpus(spark):
    # two words of the item occur nowhere: the halves without them still find the place
    p = PASSAGE.split()
    docs = spark.createDataFrame([(1, " ".join(["nu" if i == 4 else x for i, x in enumerate(p[:10])]))], "doc_id long, text string")
    row = decontam.contamination(docs, spark.createDataFrame([(1, " ".join(p[:10]))], "item_id long, text string")).first()
    assert (row.n_hit, row.n_near, row.near_items) == (0, 10, ["1"])


@pytest.mark.parametrize("at_once", [4_000_000, 60])
def test_many_contexts_shuffle_few_postings(spark, sf, monkeypatch, at_once):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    more = spark.createDataFrame([(-1, "solo"), (-2, "two words"), (-3, None)], "item_id long, text string")
    items = items.unionByName(more)
    few = sorted(map(str, decontam.contamination(docs, items).drop("text").collect()))
    monkeypatch.setattr(decontam, "CONTEXTS", 0)
    monkeypatch.setattr(decontam, "KEYS", at_once)
    tables = {}
    keep = common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, name: tables.setdefault(name, keep(df, name)))
    assert sorted(map(str, decontam.contamination(docs, items).drop("text").collect())) == few
    assert tables["near-anchors"].count() < decontam.postings(docs).count() / 20  # all that is shuffled


def test_many_test_words_are_counted_before_the_shuffle(spark, monkeypatch):
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('common common ', id, ' word', id % 7) AS text")
    vocabulary = spark.range(120_000).selectExpr("CAST(id AS string) AS term").unionByName(spark.createDataFrame([("common",), ("word3",)], "term string"))
    got = decontam.frequencies(docs, vocabulary)
    found = {r.term: r.df for r in got.collect()}
    assert found["common"] == 4000 and found["word3"] == 286 and found["17"] == 1 and len(found) == 2002
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning(term") < plan.index("partial_count")  # the exchange stands above the partial counts
