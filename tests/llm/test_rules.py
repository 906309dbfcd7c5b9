"""Quality rules against brute force, and the promise on false rejections."""

import re
from collections import Counter
from math import comb

from pyspark.sql import functions as F
from wavelake.llm import rules

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    hit = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows[::2]] + [(rows[0][0], None, 0)], "doc_id long, quality int, toxic int")
    got = rules.apply_rules(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((d, *brute(t)) for d, _, t in rows), key=str)


def test_table(spark, sf):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").collect()])


def test_edge_cases(spark):
    check(spark, [
        (1, None, None), (2, "en", ""), (3, "en", "\n \n\t"), (4, "en", "a b c d e f g h " * 3), (5, "en", "x " * 5000),
        (6, "de", "wört\x0bß 😀😀 <a>|%\n" * 40), (6, "de", "wört\x0bß 😀😀 <a>|%\n" * 40), (None, "fr", "é  z " * 30), (7, None, "one\n one\none\none "),
    ])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert rules.apply_rules(docs, labels).count() == 0


def test_binomial_cdf(spark):
    for n, k in ((10, 0), (400, 3), (5000, 20), (90_000, 250)):
        got = spark.range(1).select(rules.binomial_cdf(F.lit(k), F.lit(n), 0.02 / 6)).first()[0]
        p = 1 / 300
        if n <= 5000:
            want = sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) if n <= 400 else None
            assert want is None or abs(got - want) < 1e-9
        assert 0 <= got <= 1


def test_step_is_the_last_of_a_safe_run(spark):
    # three good documents exceed the symbol cutoffs from step 4 on, forty more from step 10 on
    symbols = rules.cutoffs_of("symbols_per_word")
    at = lambda step: int(1000 * symbols[step]) + 1
    rows = [(i, "en", 1000, 5000, at(4) if i < 3 else at(10) if i < 43 else 0, 0, 0, 3, 0, 0, False, i) for i in range(1000)]
    cols = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_marks long, base_failed boolean, text_hash long"
    labels = spark.createDataFrame([(i, 1) for i in range(1000)] + [(999, 0)], "doc_id long, quality int")
    n = 999  # the last document has two labels
    safe = lambda k: sum(comb(n, j) * 0.02**j * 0.98 ** (n - j) for j in range(k + 1)) <= 0.05
    assert safe(3) and not safe(43)
    chosen = rules.choose_cutoffs(spark.createDataFrame(rows, cols), labels).collect()
    assert [(r.stratum, r.step) for r in chosen] == [("en", 9)]
    strictest = rules.choose_cutoffs(spark.createDataFrame(rows[43:], cols), labels).collect()
    assert [(r.stratum, r.step) for r in strictest] == [("en", rules.STEPS - 1)]
    assert not rules.choose_cutoffs(spark.createDataFrame(rows[43:143], cols), labels).collect()  # too few labels to be sure of anything


def test_copies_count_once(spark):
    # 300 distinct good texts of marks none, and a text full of marks that 200 good documents repeat: one draw in 301, not 200 in 500
    text = lambda i: " ".join(f"word{i}x{j}" for j in range(30))
    rows = [(i, "en", text(i)) for i in range(300)] + [(1000 + i, "en", "! ".join(text(999).split()) + "!") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int")
    once = sum(comb(301, j) * 0.02**j * 0.98 ** (301 - j) for j in range(2))
    often = sum(comb(500, j) * 0.02**j * 0.98 ** (500 - j) for j in range(201))
    assert once <= rules.LEVEL < often
    out = rules.apply_rules(docs, labels).collect()
    assert {r.doc_id for r in out if not r.kept} == {r[0] for r in rows[300:]}
    # the same 40 good texts, six times each, are 40 draws: too few for any cutoff
    few = spark.createDataFrame([(i, "en", text(i % 40)) for i in range(240)] + [(999, "en", "! ".join(text(999).split()) + "!")], "doc_id long, lang string, text string")
    marked = spark.createDataFrame([(i, 1) for i in range(240)] + [(999, 0)], "doc_id long, quality int")
    assert all(r.kept for r in rules.apply_rules(few, marked).collect())


def test_path_goes_from_lenient_to_strict():
    for rule, (_, lenient, strict) in rules.RULES.items():
        cutoffs = rules.cutoffs_of(rule)
        assert cutoffs[0] == lenient and cutoffs[-1] == strict and cutoffs == sorted(cutoffs, reverse=True) and len(cutoffs) == rules.STEPS
