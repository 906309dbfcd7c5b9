"""Packing: exact round trip from the files, best-fit order, segment tree."""

import random

import numpy as np
import pytest
from wavelake.llm import common, packing


@pytest.fixture(scope="module")
def coder():
    with open(packing.VOCABULARY, "rb") as f:
        return packing.Tokenizer(f.read())


def back(spark, docs, length):
    folder = common.scratch(spark, "shards")
    manifest = packing.pack_documents(docs, folder, length=length)
    rows = {(r.shard, r.row): r for r in packing.read_packed(manifest, folder, length=length).collect()}
    texts, used = {}, {}
    for m in sorted(manifest.collect(), key=lambda m: (m.shard, m.item, m.segment)):
        r = rows[m.shard, m.row]
        assert m.start in r.cu_seqlens[:-1] and r.cu_seqlens[r.cu_seqlens.index(m.start) + 1] == m.start + m.n_tokens
        assert r.position_ids[m.start : m.start + m.n_tokens] == list(range(m.n_tokens))
        texts.setdefault((m.shard, m.item, m.doc_id), []).extend(r.input_ids[m.start : m.start + m.n_tokens])
        used[m.shard, m.row] = used.get((m.shard, m.row), 0) + m.n_tokens
    assert used == {k: r.cu_seqlens[-1] for k, r in rows.items()}
    for r in rows.values():
        assert all(i == 50256 for i in r.input_ids[r.cu_seqlens[-1] :]) and r.position_ids[r.cu_seqlens[-1] :] == list(range(length - r.cu_seqlens[-1]))
    return texts, len(rows), sum(used.values())


def test_round_trip(spark, sf, coder):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts, rows, ids = back(spark, docs, 256)
    want = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted((d, coder.decode(np.array(ids[:-1]))) for (_, _, d), ids in texts.items()) == want
    assert all(t[-1] == 50256 for t in texts.values())
    assert ids / (rows * 256) > 0.95


def test_edge_cases(spark, coder):
    long = "wörd 漢字 😀\n" * 40_000
    rows = [(1, None, 0), (2, "", 0), (3, "a", 0), (3, "a", 0), (None, "<|endoftext|>", 0), (4, long, 0), (5, " " * 3000, 0), (6, "ab" * 400_000, 0)]
    texts, _, _ = back(spark, spark.createDataFrame(rows, "doc_id long, text string, item int"), 64)
    got = sorted(((d, coder.decode(np.array(ids[:-1]))) for (_, _, d), ids in texts.items()), key=str)
    assert got == sorted(((d, t or "") for d, t, _ in rows), key=str)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, common.scratch(spark, "shards")).count() == 0


def test_parts_do_not_change_ids(coder, monkeypatch):
    rng = random.Random(1)
    bits = ["alpha,", "be", "gamma.", "\nNew", "12", "isn't", "é", " ", "  ", "\n\n", "\t \t", "\u3000", "\x85 ", "\x1c\x1c\x1c\x1c"]
    monkeypatch.setattr(packing, "LONG_SPACE", 3)
    for _ in range(300):
        text = "".join(rng.choices(bits, k=rng.randint(0, 40)))
        parts = list(coder.parts(text))
        assert "".join(p for p, _ in parts) == text
        assert coder.encode(text).tolist() == [*coder.coder.encode(text), coder.eot]


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "0123456789", "абвгдежзиклмн", "的一是不了人我在有他", "#$%&"])
def test_long_runs_are_encoded_whole(coder, alphabet):
    text = "".join(random.Random(3).choices(alphabet, k=600_000))
    ids = coder.encode(text)
    assert ids.tolist() == [*coder.coder.encode(text), coder.eot] and coder.decode(ids[:-1]) == text


def test_white_space_longer_than_the_pattern_can_match(coder):
    text = "a" + " " * 2_000_000 + "b" + "\n" * 1_500_000
    assert coder.decode(coder.encode(text)[:-1]) == text



def brute_fit(lengths, size):
    room, out = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [(r, b) for b, r in enumerate(room) if r >= lengths[i]]
        if fits:
            out[i] = min(fits)[1]
        else:
            room.append(size)
            out[i] = len(room) - 1
        room[out[i]] -= lengths[i]
    return out, room


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_matches_brute_force(seed):
    rng = random.Random(seed)
    size = rng.choice([7, 16, 100, 2048])
    lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 300))]
    got = packing.best_fit(lengths, size)
    want, room = brute_fit(lengths, size)
    left = [size] * (max(got, default=-1) + 1)
    for n, b in zip(lengths, got):
        left[b] -= n
    assert sorted(left) == sorted(room) and min(left, default=0) >= 0


def test_room_tree():
    rng = random.Random(8)
    tree, have = packing.RoomTree(100), set()
    for _ in range(3000):
        c = rng.randint(0, 100)
        tree.set(c, add := rng.random() < 0.5)
        (have.add if add else have.discard)(c)
        q = rng.randint(0, 100)
        assert tree.least_from(q) == min((x for x in have if x >= q), default=None)
