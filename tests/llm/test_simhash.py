"""SimHash fingerprints and components against brute force."""

import random
import re

import numpy as np
import xxhash
from wavelake.llm import simhash
from wavelake.llm.components import connected_components


def brute_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """{row index: least doc_id}: union-find over all pairs."""
    prints = [brute_print(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                up[top(i)] = top(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(d)
    return {i: min((d for d in groups[top(i)] if d is not None), default=None) for i in range(len(rows))}, prints


def check(spark, rows):
    want, prints = brute_components(rows)
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got), key=str) == sorted(((rows[i][0], prints[i], want[i]) for i in want), key=str)


def test_table_matches_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_edge_cases(spark):
    long = " ".join(random.Random(1).choices(["ab", "cd", "efg", "h"], k=70_000))
    check(spark, [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (5, "one two"), (None, "one two"), (6, long), (7, long), (8, "É one"), (9, "é one"), (None, "alone here")])


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_anchors_cover_every_pair():
    rng = np.random.default_rng(5)
    for _ in range(300):
        x = rng.integers(0, 2**64, dtype=np.uint64)
        y = x
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            y ^= np.uint64(1) << np.uint64(b)
        anchor, row, home = simhash.anchor_rows(np.array([x, y], np.uint64))
        homes = {int(a) for a, r, h in zip(anchor, row, home) if r == 0 and h}
        assert homes & {int(a) for a, r in zip(anchor, row) if r == 1}


def test_crowded_anchor_is_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 8)
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 150:  # a chain of near fingerprints around one place
        x = rng.choice(sorted(prints))
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(200)}
    signed = sorted(p - 2**64 if p >> 63 else p for p in prints)
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    got = {r.node: r.root for r in connected_components(links).collect()}
    up = {p: p for p in signed}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4 and top(a) != top(b):
                up[max(top(a), top(b))] = min(top(a), top(b))
    assert {p: got.get(p, p) for p in signed} == {p: top(p) for p in signed}


def test_keep_one(spark):
    rows = [(3, "same text of five words", "x"), (1, "same text of five words", "y"), (2, "another thing entirely, is it not", "z"), (None, "same text of five words", "n")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, __lost string"))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2]
    assert "__lost" in kept.columns


def test_keep_one_loses_no_text_of_its_own(spark, monkeypatch):
    from wavelake.llm import common

    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(12)]
    near = texts[0] + " more"
    rows = [(1, texts[0]), (5, texts[0]), (5, texts[1]), (9, texts[2]), (None, texts[2]), (None, texts[3]), (None, texts[3]), (1, near), (7, near), (9, texts[2]), (20, None), (21, ""), (21, texts[4])]
    rows += [(rng.randrange(30, 40), rng.choice(texts[5:])) for _ in range(200)]  # hot components, ids with many texts
    want, _ = brute_components(rows)
    kept = sorted((r for i, r in enumerate(rows) if r[0] == want[i]), key=repr)
    assert (5, texts[1]) in kept and (5, texts[0]) not in kept and (None, texts[2]) not in kept and (21, texts[4]) in kept
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(docs).collect()), key=repr) == kept
    monkeypatch.setattr(common, "broadcast_if_small", lambda df, *_: df)
    assert sorted(map(tuple, simhash.keep_one(docs).collect()), key=repr) == kept


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(7, 7), (None, 3), (100, 101), (101, 100)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_components_of_hubs(spark, monkeypatch):
    from wavelake.llm import components

    monkeypatch.setattr(components, "HUB", 5)
    edges = [(0, i) for i in range(1, 60)] + [(i, 100 + i) for i in range(30)] + [(500, 500 + i) for i in range(1, 20)] + [(519, 900), (901, 900)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{n: 0 for n in [*range(60), *range(100, 130)]}, **{n: 500 for n in [*range(500, 520), 900, 901]}}
