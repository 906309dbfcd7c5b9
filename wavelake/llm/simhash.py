"""Operator 2: near-duplicates by SimHash fingerprints and anchor-point covering.

Fingerprints.  Texts are lower-cased (A-Z), cut into words and `SHINGLE`-word shingles; each shingle
is hashed by XXH64 and a bit of the fingerprint is set where over half of the hashes have it.

Search.  Two fingerprints within `THRESHOLD` = 4 bits of 64 differ by at most 1 bit in the first 24
bits, or by at most 1 in the next 24, or not at all in the last 16 (2 + 2 + 1 > 4).  For each block
a covering code supplies the anchors:

* a 24-bit block takes the Hamming(15, 11) code on 15 bits, joined with all 9-bit words: 2**20
  anchors, covering radius 1.  Each fingerprint goes to every anchor within radius + 1 = 2 bits (17
  or 46 of them) and is at home at the nearest one.
* the 16-bit block with threshold 0 takes all words as anchors, covering radius 0.

If x and y are a pair, y is at x's home in one of the blocks, so comparing homes with visitors
anchor by anchor finds every pair.  A crowded anchor is cut into cells of bounded size that
together hold all of its pairs.  A cell returns a spanning forest of its links rather than all of
them, which keeps components and never grows with the square of a group.

Equal fingerprints are one node throughout.  Defined cases: null and empty texts have fingerprint
zero and are linked like any other; a text of fewer words is one shingle; a null doc_id never
names a component unless all of it is null; repeated rows get equal results; empty tables give no
rows; other columns are kept by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected_components, with_one

SHINGLE, SEED, BITS, THRESHOLD = 4, 42, 64, 4
#: Rows of a cell: crowded anchors are cut so that about so many meet in one.
CELL = 2048
#: Rows of bits summed at a time, and pairs compared at a time.
STEP, PAIRS = 1 << 16, 1 << 20
_LOWER = bytes.maketrans(common.UPPER.encode(), common.LOWER.encode())


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of one UTF-8 text, lower-cased already."""
    words = text.split()  # splits at \x20 and \x09-\x0D
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_digest
    count = len(words) - SHINGLE + 1
    counts = np.zeros(BITS, np.int64)
    for at in range(0, count, STEP):
        to = min(at + STEP, count)
        raw = b"".join([digest(line[s:e], SEED) for s, e in zip(starts[at:to], ends[at + SHINGLE - 1 : to + SHINGLE - 1], strict=True)])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > count).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        out = np.fromiter((fingerprint((t.as_py() or b"").translate(_LOWER)) for t in texts), np.uint64, len(texts))
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "fp": pa.array(out.view(np.int64))})


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp): a hash that tells the texts of one doc_id apart, and the fingerprint's bits as a signed long."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(_fingerprints, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, fp long")


def _block_masks() -> list[np.ndarray]:
    """For each of the 16 syndromes, the flips that lead from a 24-bit block to the anchors within 2 bits.

    The nearest anchor comes first.  Bit i of the low 15 has column i + 1 of the parity check.
    """
    rest = [1 << (15 + i) for i in range(9)]
    near = [0, *rest, *(a | b for i, a in enumerate(rest) for b in rest[i + 1 :])]
    out = []
    for s in range(16):
        if s == 0:
            out.append(np.array(near, np.uint64))
            continue
        one = 1 << (s - 1)
        two = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 16) if 0 < i ^ s < i]
        out.append(np.array([one, *(one | r for r in rest), *two], np.uint64))
    return out


def _syndromes() -> np.ndarray:
    s = np.zeros(1 << 15, np.uint8)
    for i in range(15):
        s ^= np.where(np.arange(1 << 15) >> i & 1, i + 1, 0).astype(np.uint8)
    return s


_MASKS, _SYNDROMES = _block_masks(), _syndromes()


def anchor_rows(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index into fp, at home) of every anchor that each of the uint64 fingerprints goes to."""
    anchors, rows, homes = [], [], []
    for block, shift in ((0, 40), (1, 16)):
        part = fp >> np.uint64(shift) & np.uint64(0xFFFFFF)
        syndrome = _SYNDROMES[part & np.uint64(0x7FFF)]
        for s in range(16):
            at = np.flatnonzero(syndrome == s)
            masks = _MASKS[s]
            anchors.append(((part[at, None] ^ masks[None, :]) | np.uint64(block << 24)).ravel())
            rows.append(np.repeat(at, len(masks)))
            home = np.zeros((len(at), len(masks)), bool)
            home[:, 0] = True
            homes.append(home.ravel())
    anchors.append(fp & np.uint64(0xFFFF) | np.uint64(2 << 24))
    rows.append(np.arange(len(fp)))
    homes.append(np.ones(len(fp), bool))
    return np.concatenate(anchors), np.concatenate(rows), np.concatenate(homes)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, whole.num_rows, 4096):
            fp = whole.column("fp").slice(i, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
            anchor, row, home = anchor_rows(fp)
            yield pa.record_batch({"anchor": pa.array(anchor.astype(np.int32)), "fp": pa.array(fp[row].view(np.int64)), "home": pa.array(home)})


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least reachable index of each of n nodes under the links a-b."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        was = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == was).all():
            break
    return label


def _links_of(cells: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of whole cells, rows sorted by cell."""
    first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    size = np.diff(np.r_[first, len(cells)])
    group = np.repeat(np.arange(len(first)), size)
    at = np.flatnonzero(home & (size[group] > 1))
    width = size[group[at]]
    a_all, b_all, i = [], [], 0
    ends = np.cumsum(width)
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
        w = width[i:j]
        a = np.repeat(at[i:j], w)
        b = np.repeat(first[group[at[i:j]]] - (np.cumsum(w) - w), w) + np.arange(w.sum())
        near = np.bitwise_count(fp[a] ^ fp[b]) <= THRESHOLD
        near &= fp[a] != fp[b]
        a, b = a[near], b[near]
        if len(a) > 4 * len(cells):  # crowded: keep what the links so far span
            label = forest(np.concatenate([*a_all, a]), np.concatenate([*b_all, b]), len(cells))
            a = np.flatnonzero(label != np.arange(len(cells)))
            a_all, b_all, b = [], [], label[a]
        a_all.append(a)
        b_all.append(b)
        i = j
    if not a_all:
        return fp[:0], fp[:0]
    label = forest(np.concatenate(a_all), np.concatenate(b_all), len(cells))
    child = np.flatnonzero(label != np.arange(len(cells)))
    return fp[child], fp[label[child]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell in, links out; cells are whole in a partition but may span batches."""
    kept: list[tuple[np.ndarray, ...]] = []

    def flush(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        a, b = _links_of(*rows)
        return pa.record_batch({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    for batch in batches:
        if not batch.num_rows:
            continue
        cell, fp, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "fp", "home"))
        kept.append((cell, fp.view(np.uint64), home))
        rows = tuple(np.concatenate(x) for x in zip(*kept, strict=True))
        ended = np.flatnonzero(rows[0] != rows[0][-1])
        cut = int(ended[-1]) + 1 if len(ended) else 0
        if cut:
            yield flush(tuple(x[:cut] for x in rows))
        kept = [tuple(x[cut:] for x in rows)]
    if kept:
        yield flush(tuple(np.concatenate(x) for x in zip(*kept, strict=True)))


def near_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links of a spanning forest of the near pairs among distinct fingerprints ``fp``."""
    rows = distinct.mapInArrow(_replicate, "anchor int, fp long, home boolean")
    rows = common.materialize(rows, "anchors")
    crowded = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL)
    crowded = crowded.select("anchor", F.ceil(F.col("n") / CELL).cast("int").alias("cuts"))
    rows = rows.join(common.broadcast_if_small(crowded), "anchor", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    # homes of cut i meet visitors of cut j in cell (i, j): a home row goes to row i, every row to column j
    cells = F.sequence(F.lit(0), F.col("cuts") - 1)
    here = F.transform(cells, lambda k: F.struct((k * F.col("cuts") + own).alias("c"), (F.col("home") & (k == own)).alias("home")))
    there = F.transform(cells, lambda k: F.struct((own * F.col("cuts") + k).alias("c"), F.lit(True).alias("home")))
    both = F.when(F.col("home"), F.concat(here, F.filter(there, lambda x: x["c"] != own * F.col("cuts") + own))).otherwise(here)
    single = F.array(F.struct(F.lit(0).alias("c"), F.col("home").alias("home")))
    cut = rows.select("anchor", "fp", F.explode(F.when(F.col("cuts") == 1, single).otherwise(both)).alias("x"))
    cut = cut.select(F.xxhash64("anchor", "x.c").alias("cell"), "fp", F.col("x.home").alias("home"))
    found = cut.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare, "a long, b long")
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, component_id), a row per row: the least doc_id reachable over links, itself included."""
    prints = common.materialize(fingerprints(docs), "fingerprints")
    distinct = common.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = common.materialize(connected_components(near_links(distinct.select("fp"))), "roots")
    named = common.materialize(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "named")
    component = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of = with_one(named.select("root", "fp", F.col("n").alias("copies")), component, "root", named.count())
    of = common.materialize(of.select("fp", "component_id", F.col("copies").alias("n")), "components")
    return with_one(prints, of, "fp", prints.count())


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies: of each component the rows with its least doc_id stay.

    A row goes if its own text is in a component with a lesser doc_id: where one doc_id has several texts, each
    is judged by itself.  Rows without a doc_id go where a component has any, else all of them stay; so do rows
    that repeat the least doc_id.
    """
    found = near_duplicates(docs)
    copies = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    lost = common.materialize(copies.select(F.col("doc_id").alias("lost"), F.col("text_hash").alias("lost_text")).distinct(), "copies")
    lost = common.broadcast_if_small(lost, 2_000_000, 128 << 20)  # two numbers a row
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("its_text"), F.struct("*").alias("row"))
    return rows.join(lost, F.col("id").eqNullSafe(F.col("lost")) & (F.col("its_text") == F.col("lost_text")), "left_anti").select("row.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document of ``documents``: its fingerprint in hex and its component."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
