"""Fill-in-middle: units, cuts and forms against a plain restatement with regular expressions; exact round trips."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from wavelake.llm import fim

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plain(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    return n, *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aZ<>PSM 0\n"), st.characters(exclude_categories=["Cs"])), max_size=200), st.integers(-(2**63), 2**63 - 1))
def test_arrange(text, doc_id):
    *got, out = fim.arrange(text.encode(), fim.chances(doc_id, 1))
    assert (*got, out.decode()) == plain(doc_id, text)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**300), st.integers(0, 40))
def test_place(bits, k):
    width = 301
    ones = [i for i, c in enumerate(f"{bits:0{width}b}") if c == "1"]
    assert fim.place(bits, width, k) == (ones[k] if k < len(ones) else width)


def cases():
    rng = random.Random(3)
    pieces = ["word", "Mixed", " ", "\n", "é", "😀", "<", "P>", "<P", "<S", ">", "<M", "0", "\x00", "ß", "a"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 60))) for _ in range(400)]
    return [*texts, None, "", "<P>", "a<S>b", "x<M>", "word " * 60_000, "é" * 100_000, "a" * 300_000, "<<<P P>"]


def test_operator(spark):
    rows = [(i if i % 50 else None, t, "f", i) for i, t in enumerate(cases())] + [(7, "same", "f", 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    out = fim.fill_in_middle(docs).withColumn("back", fim.restore(F.col("output"), F.col("form")))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out.collect()), key=repr)
    assert got == sorted(((i, *plain(i, t), t or "") for i, t, _, _ in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_small_batches(spark, monkeypatch):
    monkeypatch.setattr(fim, "FLUSH", 100)
    docs = spark.createDataFrame([(i, "some text " * (i % 9)) for i in range(200)], "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in fim.fill_in_middle(docs).collect()} == {i: plain(i, "some text " * (i % 9)) for i in range(200)}


def test_empty_table(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
