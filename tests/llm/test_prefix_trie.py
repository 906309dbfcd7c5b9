"""Prefix trie: against a dictionary of all prefixes, with blocks and slices small enough to need many rounds."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from wavelake.llm import common, prefix_trie


def trunc(c):
    return c - (abs(c) % 5) * (1 if c > 0 else -1)


def rebuild(rows):
    """Turns are in the order of the rows here; ties are tested apart."""
    own = defaultdict(list)
    for c, _, role, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(trunc(c), [])[:h] + turns[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(own) - 1) * len(node[-1][1].encode()) if node else 0
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(own), len(node), min(members[node[:-1]]) if node else -(10**9), len(own), children[node] if node in children else 0, leaves[node], saved[node], digest([c for c in own if len(convs[c]) == len(node)]))
                  for node, own in members.items())


def nodes(spark, rows, columns="conv_id long, turn long, role string, text string, depth string"):
    turns = common.materialize(prefix_trie.turns_of(spark.createDataFrame(rows, columns)), "turns")
    out = prefix_trie.prefix_nodes(*prefix_trie.rebuilt(turns))
    return [r.asDict() for r in out.collect()]


def told(found):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(-(10**9) if r[n] is None else r[n] for n in names) for r in found)


def conversations(seed=4, ids=range(-30, 90)):
    rng = random.Random(seed)
    rows = []
    for c in ids:
        if rng.random() < 0.15:
            continue  # some bases are absent
        for t in range(rng.choice([1, 2, 3, 9, 12, 25])):
            rows.append((c, t if t else None, rng.choice(["user", "user", "assistant", None]), rng.choice(["a", "a", "ab", "é😀", "", None]), "x"))
    same = [(c, t, "user", f"turn {t}", "x") for c in range(1000, 1120) for t in range(11)]
    return rows + same + [(None, 1, "user", "nobody", "x"), (None, None, None, None, None)]


@pytest.mark.parametrize(("block", "slice_"), [(512, 4096), (3, 5)])
def test_against_all_prefixes(spark, monkeypatch, block, slice_):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "SLICE", slice_)
    rows = conversations()
    random.Random(1).shuffle(rows)
    found = nodes(spark, rows)
    assert told(found) == brute(rebuild(rows))
    # intervals: preorder is a numbering, subtrees nest
    assert sorted(r["preorder"] for r in found) == list(range(1, len(found) + 1))
    open_ends = []
    for r in sorted(found, key=lambda r: r["preorder"]):
        while open_ends and open_ends[-1][0] < r["preorder"]:
            open_ends.pop()
        assert r["depth"] == len(open_ends) and (not open_ends or r["subtree_end"] <= open_ends[-1][0])
        open_ends.append((r["subtree_end"],))


def test_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 5)
    rows = [(5, t, "user", f"t{t % 7}", "x") for t in range(260)] + [(10, t, "user", f"t{t % 7}", "x") for t in range(151)]
    assert told(nodes(spark, rows)) == brute(rebuild(rows))


def test_ties_repeats_and_one_turnless(spark):
    rows = [(5, 1, "user", "b", "x"), (5, 1, "assistant", "a", "x"), (5, 2, "user", "c", "x"), (5, 2, "user", "c", "x"), (15, 1, "assistant", "a", "x"), (15, 1, "user", "b", "x")]
    found = nodes(spark, rows)
    assert found and found == nodes(spark, rows[::-1]) or told(found) == told(nodes(spark, rows[::-1]))
    assert sum(r["depth"] == 2 for r in found) == 1  # ties are in one order everywhere
    alone = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    assert told(nodes(spark, [(alone, 1, "user", "lost", "x")])) == brute({alone: []})


def test_empty(spark):
    assert nodes(spark, []) == [] and nodes(spark, [(None, 1, "user", "a", "x")]) == []
