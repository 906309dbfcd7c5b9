"""The line field: marginals against enumeration, held-out accuracy, edge cases."""

import itertools
import zlib

import numpy as np
from wavelake.llm import quality_crf as Q


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    sizes = [1, 4, 2, 5, 1]
    first = np.concatenate([[0], np.cumsum(sizes)])
    logit, pairs = rng.normal(size=first[-1]) * 2, rng.normal(size=(2, 2))
    good, expected, total = Q.forward_backward(logit, first, pairs)
    counts = np.zeros((2, 2))
    for k, (a, b) in enumerate(zip(first, first[1:])):
        weight = {}
        for y in itertools.product((0, 1), repeat=b - a):
            weight[y] = np.exp(sum(logit[a + i] for i in range(b - a) if y[i]) + sum(pairs[y[i], y[i + 1]] for i in range(b - a - 1)))
        z = sum(weight.values())
        assert np.isclose(total[k], np.log(z))
        for i in range(b - a):
            assert np.isclose(good[a + i], sum(w for y, w in weight.items() if y[i]) / z)
        for y, w in weight.items():
            for i in range(b - a - 1):
                counts[y[i], y[i + 1]] += w / z
    assert np.allclose(expected, counts)


def plain_features(line: bytes, known: set[bytes]) -> list[float]:
    """A line's features by their definitions, one line at a time."""
    of = {name: sum(bytes([b]) in chars for b in line for chars in [Q._CLASS[name]]) for name in Q._CLASS}
    chars, words = len(line.decode("utf-8", "replace")), line.split()
    some = max(len(words), 1)
    alike = sum(sum(a) == sum(b) and len(a) == len(b) and a[0] == b[0] for a, b in zip(words, words[1:]))
    letters = max(chars - of["space"] - of["digit"] - of["symbol"] - of["mark"] - of["stop"] - of["bar"], 1)
    upper, symbols, marks, bars, repeated = of["upper"] / letters, of["symbol"] / some, of["mark"] / some, of["bar"] / some, alike / max(len(words) - 1, 1)
    return [
        not words, np.log1p(chars) / 6, upper, min(symbols, 3) / 3, min(marks, 3) / 3, min(bars, 2) / 2, min(of["digit"] / some, 3) / 3, repeated, bool(line) and line in known, min(of["stop"] / some, 1), min(chars / some, 30) / 30,
        line[-1:] in (b".", b"!", b"?"), line[:1].isupper(), len(words) < 4, upper > 0.5, symbols > 0.4, repeated > 0.3, bars > 0.15, marks > 0.5]


def plain_score(field: Q.Field, text: str | None) -> float:
    """A document's score restated: plain features, products over label paths by recursion, length-weighted mean."""
    lines = (text or "").encode().split(b"\n")
    x = [plain_features(line, set(lines[:i])) for i, line in enumerate(lines)]
    none, last = [0.0] * len(Q.FEATURES), len(lines) - 1
    logit = [float(np.dot([*x[i], *(x[i - 1] if i else none), *(x[i + 1] if i < last else none), i == 0, i == last, 1], field.weights)) for i in range(len(x))]
    pair = lambda a, b: float(field.pairs[a, b])
    ahead, behind = [[0.0, logit[0]]], [[0.0, 0.0]]
    for i in range(1, len(x)):
        ahead.append([np.logaddexp(ahead[-1][0] + pair(0, y), ahead[-1][1] + pair(1, y)) + y * logit[i] for y in (0, 1)])
    for i in range(len(x) - 2, -1, -1):
        behind.insert(0, [np.logaddexp(pair(y, 0) + behind[0][0], pair(y, 1) + logit[i + 1] + behind[0][1]) for y in (0, 1)])
    good = [1 / (1 + np.exp(a[0] + b[0] - a[1] - b[1])) for a, b in zip(ahead, behind, strict=True)]
    weight = [len(line.decode()) + 1 for line in lines]
    return float(np.dot(good, weight) / sum(weight))


def test_scores_match_a_plain_restatement(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    field = Q.fit(docs, labels.select("doc_id", "quality"))
    texts = [r.text for r in docs.collect() if len(r.text) < 20_000] + ["", None, "one\n\none\none two two", "É É!\n| | |\n"]
    got = Q.score(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), field).collect()
    assert all(abs(r.score - plain_score(field, texts[r.doc_id])) < 1e-9 for r in got)


def test_features_of_lines():
    x, first, chars = Q.line_features([b"", "É é\né é\n\nAB CD!!".encode(), b"x x x x |"])
    names = {n: i for i, n in enumerate(Q.FEATURES)}
    assert first.tolist() == [0, 1, 5, 6] and chars.tolist() == [0, 3, 3, 0, 7, 9]
    assert x[:, names["empty"]].tolist() == [1, 0, 0, 1, 0, 0]
    assert x[5, names["repeats"]] == 3 / 4 and x[4, names["marks"]] == 1 / 3
    whole = Q.line_features([b"one two\nthree"])[0]
    alone = Q.line_features([b"zzz zzz", b"one two\nthree", b"q"])[0]
    assert np.array_equal(whole, alone[1:3])  # other texts of a slice don't matter


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in Q.op1_quality(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(rows) == docs
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(d, q) for d, q in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(rows[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, _ in labels)
    right = sum(rows[d].predicted == q for d, q in held) / len(held)
    good = [rows[d].predicted for d, q in held if q == 1]
    assert right > 0.95 and sum(good) / len(good) > 0.97, (right, len(held))
    again = {r.doc_id: r.score for r in Q.op1_quality(spark, sf).collect()}
    assert all(again[d] == r.score for d, r in rows.items())


def test_edge_cases(spark):
    plain, loud = "The quiet words of a sentence go on.\nAnd then another one follows it.", "BUY!! NOW!! BUY!! NOW!!\nBUY!! NOW!!"
    rows = [(i, plain if i % 2 else loud, "x") for i in range(60)] + [(100, None, "x"), (101, "", "y"), (None, plain, "n"), (3, plain, "x"), (102, "\n" * 3000, "z"), (103, "é" * 5_000_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(100, None), (None, 1), (5, 0)], "doc_id long, quality int")
    got = [(r.doc_id, r.text, r.score) for r in Q.score(docs, Q.fit(docs, labels)).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for *_, s in got)
    assert all((s >= 0.3) == (t == plain) for _, t, s in got if t in (plain, loud))
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id < 60").count() == 31


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in Q.score(docs, Q.fit(docs, none)).collect()] == [1.0, 1.0]
    assert Q.score(docs.limit(0), Q.fit(docs.limit(0), none)).count() == 0
