"""Licence scan against brute force."""

import re

from wavelake.llm import licenses

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute(text):
    """n_words, n_base, first, last, base labels: the contract's words, place by place."""
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def notices(text):
    """Labels of notices: 4-grams on diagonals, diagonals joined while neighbours are close."""
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = {}
    for d in range(len(words) - 3):
        places.setdefault(tuple(words[d : d + 4]), []).append(d)
    out = set()
    for notice, label in licenses.NOTICES.items():
        t = notice.split()
        by = {}
        for i in range(len(t) - 3):
            for d in places.get(tuple(t[i : i + 4]), ()):
                by.setdefault(d - i, set()).add(i)
        run, last = set(), None
        for d in sorted(by):
            run = run | by[d] if last is not None and d - last <= max(licenses.SHIFT, 0.4 * (len(t) - 3)) else by[d]
            last = d
            if len(run) >= licenses.COVER * (len(t) - 3):
                out.add(label)
    return out


def check(spark, rows):
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, words string")).collect()
    mine = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got), key=str)
    want = []
    for d, t, _ in rows:
        b = brute(t)
        labels = {*filter(None, b[4].split(",")), *notices(t)}
        want.append((d, *b, ",".join(sorted(labels))))
    assert mine == sorted(want, key=str)
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)


def test_table(spark, sf):
    check(spark, [(r.doc_id, r.text, "x") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_edge_cases(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    check(spark, [
        (1, None, ""), (2, "", ""), (3, "MIT", ""), (4, "MIT License MIT license, mit-LICENSE cc by-cc By", ""), (4, "other text", ""),
        (5, "Apache\nLicense " * 3000, ""), (5, "Apache\nLicense " * 3000, ""), (None, "the GNU General Public License. GNU General Public", ""),
        (10, next(t for t, x in licenses.NOTICES.items() if x == "mit-text").replace("merge", "merge and split").replace("contract", ""), ""), (11, "without warranties or conditions of any kind", ""),
        (6, mit.replace("obtaining", "now obtaining"), ""), (7, mit[:40], ""), (8, "énu gnu general public licensé MİT license", ""), (9, "of the and the " * 400, ""),
    ])


def test_texts_are_labelled(spark):
    rows = [(i, f"Some words first. {t.capitalize()}. And some after, as it is.", label) for i, (t, label) in enumerate(licenses.NOTICES.items())]
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, words string")).collect()}
    assert all(label in got[i] for i, _, label in rows)


def test_broken_notices(spark):
    bsd = next(t for t, x in licenses.NOTICES.items() if x == "bsd-terms").split()
    mit = next(t for t, x in licenses.NOTICES.items() if x == "mit-text").split()
    grams = len(mit) - 3
    at = lambda words, i, n: " ".join([*words[:i], *(f"new{j}" for j in range(n)), *words[i:]])
    far = grams * licenses.SLACK_PERCENT // 100
    rows = [
        (1, at(bsd, 10, 5)),  # five words at one place
        (2, at(bsd, 10, 9)),  # more than the sentence's slack: two halves
        (3, at(mit, 80, far)), (4, at(mit, len(mit) // 2, far + 1)),
        (5, " ".join([*mit[len(mit) // 2 :], *mit[: len(mit) // 2]])),  # halves exchanged
        (6, " ".join(w + (" new" if i % 4 == 3 else "") for i, w in enumerate(bsd))),  # too few 4-grams are left
        (7, " ".join(bsd[:10] + bsd[13:])),  # three words lost
    ]
    check(spark, [(d, t, "") for d, t in rows])
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "bsd-terms" in got[1] and "bsd-terms" not in got[2] and "bsd-terms" not in got[6] and "bsd-terms" in got[7]
    assert "mit-text" in got[3] and "mit-text" not in got[4] and "mit-text" not in got[5]


def test_empty(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
