"""Mixing: targets, closeness, bounds, edge cases, equal reruns."""

import re
from collections import Counter

from wavelake.llm import mixing

COLS = "doc_id long, text string, source string, size string"


def brute_targets(sizes):
    """Water filling: share by weight, cap, share the excess again until nothing is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(sizes.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        capped = {s for s in free if weight[s] * level >= 3 * sizes[s]}
        if not capped:
            return target | {s: weight[s] * level for s in free}
        target |= {s: 3.0 * sizes[s] for s in capped}
        rest -= sum(3.0 * sizes[s] for s in capped)
        free -= capped
    return target


def check(spark, rows):
    got = mixing.mix_sizes(spark.createDataFrame(rows, COLS)).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((d, s, count(t)) for d, t, s, _ in rows)
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += count(t)
    for s in {r[2] for r in rows}:
        sizes.setdefault(s, 0)
    targets = brute_targets(dict(sizes)) if rows else {}
    taken = Counter()
    longest = Counter()
    for r in got:
        assert 0 <= r.times <= 3 and abs(r.target - targets[r.source]) < 1e-6 * max(1, targets[r.source])
        taken[r.source] += r.times * r["size"]
        longest[r.source] = max(longest[r.source], r["size"])
    total = sum(sizes.values())
    assert sum(taken.values()) <= total
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 2 * max(longest.values(), default=0) + 1, (s, taken[s], t)
    again = mixing.mix_sizes(spark.createDataFrame(rows[::-1], COLS)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    return {s: taken[s] for s in targets}


def test_table(spark, sf):
    check(spark, [(r.doc_id, r.text, r.source, "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_edge_cases(spark):
    rows = [(i, "w " * (i % 40), ["a", "b", "z", None][i % 7 % 4], "x") for i in range(300)]
    rows += [(1000, None, "empty", "x"), (1001, "", "empty", "x"), (None, "one two three", "a", "x"), (5, "w " * 5, "b", "x"), (5, "w " * 5, "b", "x"), (2000, "long " * 3000, "b", "x"), (3000, "tiny", "t", "x")]
    taken = check(spark, rows)
    assert taken["empty"] == 0 and taken["t"] in (0, 1, 2, 3)


def test_nothing(spark):
    check(spark, [])
    check(spark, [(1, None, "a", ""), (2, " ", None, "")])


def test_one_source_takes_all_once(spark):
    taken = check(spark, [(i, "w " * 7, "only", "") for i in range(50)])
    assert taken == {"only": 350}


def test_mix_repeats_rows(spark):
    rows = [(i, f"text {i} " * (i % 9 + 1), "big" if i % 10 else "abc", "x") for i in range(200)] + [(7, "text 7 " * 8, "big", "y")]
    docs = spark.createDataFrame(rows, COLS)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    times = Counter()
    for r in mixing.mix_sizes(docs).collect():
        times[r.doc_id] += r.times
    assert Counter(r.doc_id for r in out.collect()) == +times
    assert {(r.doc_id, r.text) for r in out.collect()} <= {(r[0], r[1]) for r in rows}


def test_mix_of_copies_and_null_ids(spark):
    # one text many times over without a doc_id, other texts without one, copies that differ in an extra column
    rows = [(None, "hot words here", "big", "x")] * 400 + [(None, f"text {i} of five words", "big" if i % 3 else None, "x") for i in range(150)]
    rows += [(9, "a b c d", "abc", f"row {i % 5}") for i in range(60)] + [(9, "a b c d", None, "x")] * 3 + [(i, "one two " * (i % 6), "abc", "x") for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key string")
    counts = Counter()
    for r in mixing.mix_sizes(docs).collect():
        counts[(r.doc_id, r.source, r["size"], r.key)] += r.times
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    got, given = Counter(map(tuple, out.collect())), Counter(rows)
    assert set(got) <= set(given) and all(got[r] <= 3 * given[r] for r in got)
    assert Counter(map(tuple, mixing.mix(spark.createDataFrame(rows[::-1], docs.schema)).collect())) == got
    keyed = docs.select("doc_id", "source", "text", mixing._size().alias("size"), mixing._key().alias("k")).distinct().collect()
    by_doc = Counter()
    for r in keyed:
        by_doc[(r.doc_id, r.source, r["size"], r.k)] += sum(n for (d, t, s, _), n in got.items() if (d, t, s) == (r.doc_id, r.text, r.source))
    assert +by_doc == +counts
    assert len({r.k for r in keyed if r.doc_id is None}) == 151
    # some group is used unequally, so both ways are taken
    assert any(len({r.times for r in g}) > 1 for g in _groups(mixing.mix_sizes(docs).where("size > 0").collect()))


def _groups(rows):
    by = {}
    for r in rows:
        by.setdefault((r.doc_id, r.source, r.key), []).append(r)
    return by.values()


def test_edge_slice_is_cut_again_without_change(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = Counter(map(tuple, mixing.mix_sizes(docs).collect()))
    monkeypatch.setattr(mixing, "TIME_SLICES", 4)
    monkeypatch.setattr(mixing, "EDGE_ITEMS", 1)
    assert Counter(map(tuple, mixing.mix_sizes(docs).collect())) == whole
