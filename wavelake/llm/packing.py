"""Operator 5: token ids, packed by best-fit decreasing into fixed-length rows and written as binary shards.

Each text becomes byte-pair ids plus an end-of-text id, encoded whole whatever its length.  Documents longer than a row are split
into full rows and a rest; nothing is cut off.  A task gathers blocks of about `BLOCK` ids, sorts
their segments by length, and puts each where the least sufficient room is left, found by a
segment tree over remaining capacities.  A block is one shard of three little-endian files:

* ``NAME.ids``: uint16 or uint32 matrix [rows, length], padded with the end-of-text id;
* ``NAME.cu``: int32, for each row its number of segments k, then the k + 1 cumulative lengths from 0;
* ``NAME.resets``: uint8 [rows, ceil(length / 8)], a bit (high first) for each place where the position
  starts again at 0: the segments' starts and the padding's.

Shards are files in the shared folder, opened through ``pyarrow.fs`` and renamed when whole, so a repeated
task replaces them.  There is no shuffle, and a task's memory is one block, or one longer document.

Defined cases: null and empty texts are one end-of-text id; repeated rows are packed each; a null
doc_id is carried; an empty table writes no shard and lists no row; other columns are ignored.
The tokenizer file is read by the driver (`VOCABULARY_BYTES` at most) and sent to the tasks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VOCABULARY, VOCABULARY_BYTES = "/opt/tokenizers/byte_bpe_50k.tiktoken", 16 << 20
#: Fixed value: how the vocabulary's authors cut texts into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ids of a row, and of a block.
LENGTH, BLOCK = 2048, 4 << 20
#: Runs of white space from this length on are encoded apart, which the piece pattern's look-ahead could not.
LONG_SPACE = 100_000


@cache
def _spaces(least: int) -> regex.Pattern:
    return regex.compile(rf"\p{{White_Space}}{{{least},}}+")


MANIFEST = "segment int, n_segments int, n_tokens int, shard string, row int, start int, item int"


class Tokenizer:
    """Byte-pair encoding from a ranks file's content; the first free id ends a text."""

    def __init__(self, content: bytes, pattern: str = PATTERN):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        self.eot = max(ranks.values()) + 1
        self.dtype = np.dtype("<u2" if self.eot < 1 << 16 else "<u4")
        self.coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text in parts that no piece lies across, and whether a part is one piece.

        By the pattern a run of white space is one piece, less its last character if a word follows.
        """
        at = 0
        for run in _spaces(LONG_SPACE).finditer(text) if len(text) >= LONG_SPACE else ():
            end = run.end() - (run.end() < len(text))
            yield text[at : run.start()], False
            yield text[run.start() : end], True
            at = end
        yield text[at:], False

    def encode(self, text: str) -> np.ndarray:
        ids = [(self.whole if single else self.coder).encode_to_numpy(p, disallowed_special=()) for p, single in self.parts(text)]
        return np.concatenate([*ids, np.array([self.eot])]).astype(self.dtype)

    def decode(self, ids: np.ndarray) -> str:
        return self.coder.decode([int(i) for i in ids if i != self.eot])


class RoomTree:
    """Segment tree over capacities 0 .. size: which are present, and the least present one from a given one on."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.present = [False] * (2 * self.leaves)

    def set(self, capacity: int, present: bool) -> None:
        i, tree = capacity + self.leaves, self.present
        tree[i] = present
        while i > 1:
            i >>= 1
            now = tree[2 * i] or tree[2 * i + 1]
            if tree[i] == now:
                break
            tree[i] = now

    def least_from(self, capacity: int) -> int | None:
        i, tree = capacity + self.leaves, self.present
        if tree[i]:
            return capacity
        while i > 1:  # up to the first right sibling that holds one, then down its left side
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit(lengths: list[int], size: int) -> list[int]:
    """The bin of each item, items taken by decreasing length (ties in order) into the fullest bin with room."""
    tree, open_bins, bins = RoomTree(size), [[] for _ in range(size + 1)], 0
    out = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        room = tree.least_from(lengths[i])
        if room is None:
            b, bins, room = bins, bins + 1, size
        else:
            b = open_bins[room].pop()
            if not open_bins[room]:
                tree.set(room, False)
        out[i] = b
        left = room - lengths[i]
        if left:
            if not open_bins[left]:
                tree.set(left, True)
            open_bins[left].append(b)
    return out


def pack(items: list[np.ndarray], size: int, pad: int) -> tuple[np.ndarray, list[list[int]], list[tuple[int, int, int, int, int]]]:
    """(id matrix, cumulative lengths of each row, segments as (item, segment, row, start, length))."""
    pieces = [(k, s, a, min(size, len(ids) - a)) for k, ids in enumerate(items) for s, a in enumerate(range(0, len(ids), size))]
    rows = best_fit([p[3] for p in pieces], size)
    matrix = np.full((max(rows, default=-1) + 1, size), pad, items[0].dtype if items else np.uint16)
    cumulative: list[list[int]] = [[0] for _ in range(len(matrix))]
    placed = []
    for (k, s, a, n), row in zip(pieces, rows, strict=True):
        start = cumulative[row][-1]
        matrix[row, start : start + n] = items[k][a : a + n]
        cumulative[row].append(start + n)
        placed.append((k, s, row, start, n))
    return matrix, cumulative, placed


def resets(cumulative: list[list[int]], size: int) -> np.ndarray:
    """A bit for each place where positions start again."""
    bits = np.zeros((len(cumulative), size), np.uint8)
    for row, ends in enumerate(cumulative):
        bits[row, [e for e in ends if e < size]] = 1
    return np.packbits(bits, axis=1)


def positions(bits: np.ndarray, size: int) -> np.ndarray:
    """The position ids [rows, size] of packed reset bits."""
    start = np.unpackbits(bits, axis=1)[:, :size].astype(bool)
    place = np.arange(size)
    return place - np.maximum.accumulate(np.where(start, place, 0), axis=1)


_CODERS: dict[bytes, Tokenizer] = {}


def pack_documents(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """Tokenize, pack and write all documents to ``folder``; returns where each segment lies.

    Columns: doc_id, segment of n_segments, n_tokens (the end-of-text id counts), shard, row and start in
    the shard's matrix, item (the document's number in its shard: repeated rows have their own).
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        content = f.read(VOCABULARY_BYTES + 1)
    if len(content) > VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} has more than {VOCABULARY_BYTES} bytes")
    sent = spark.sparkContext.broadcast(content)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sent.value not in _CODERS:  # once per Python worker
            _CODERS[sent.value] = Tokenizer(sent.value)
        coder = _CODERS[sent.value]
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        task, shards = TaskContext.get(), 0
        ids: list[np.ndarray] = []
        names: list[pa.Array] = []
        held = 0

        def put(name: str, data: bytes | memoryview) -> None:
            with fs.open_output_stream(f"{base}/{name}.{task.taskAttemptId()}", compression=None) as out:
                out.write(data)
            fs.move(f"{base}/{name}.{task.taskAttemptId()}", f"{base}/{name}")

        def flush() -> pa.RecordBatch:
            nonlocal ids, names, held, shards
            fs.create_dir(base, recursive=True)
            shard = f"shard-{task.partitionId():06d}-{shards:04d}"
            matrix, cumulative, placed = pack(ids, length, coder.eot)
            put(f"{shard}.ids", np.ascontiguousarray(matrix).data.cast("B"))
            put(f"{shard}.cu", np.array([x for row in cumulative for x in (len(row) - 1, *row)], "<i4").tobytes())
            put(f"{shard}.resets", resets(cumulative, length).tobytes())
            at = np.array(placed, np.int32).T
            count = np.array([-(-len(x) // length) for x in ids], np.int32)[at[0]]
            doc = pa.concat_arrays(names).take(pa.array(at[0]))
            columns = {"doc_id": doc, "segment": at[1], "n_segments": count, "n_tokens": at[4], "shard": pa.array([shard] * len(doc)), "row": at[2], "start": at[3], "item": at[0]}
            ids, names, held, shards = [], [], 0, shards + 1
            return pa.record_batch({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})

        for batch in batches:
            doc, text = batch.column("doc_id"), batch.column("text")
            for i in range(batch.num_rows):
                ids.append(coder.encode(text[i].as_py() or ""))
                names.append(doc.slice(i, 1))
                held += len(ids[-1])
                if held >= block:
                    yield flush()
        if ids:
            yield flush()

    return common.materialize(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {MANIFEST}"), "packed")


def read_packed(manifest: DataFrame, folder: str, length: int = LENGTH, dtype: str = "<u2") -> DataFrame:
    """(shard, row, input_ids, cu_seqlens, position_ids) of every packed row, read from the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                def get(kind: str, shard: str = shard) -> bytes:
                    with fs.open_input_stream(f"{base}/{shard}.{kind}", compression=None) as f:
                        return f.read()

                ids = np.frombuffer(get("ids"), dtype).reshape(-1, length).astype(np.int32)
                place = positions(np.frombuffer(get("resets"), np.uint8).reshape(len(ids), -1), length).astype(np.int32)
                flat, cumulative, at = np.frombuffer(get("cu"), "<i4"), [], 0
                for _ in range(len(ids)):
                    cumulative.append(flat[at + 1 : at + 2 + flat[at]].tolist())
                    at += 2 + flat[at]
                for i in range(0, len(ids), 256):
                    n = len(ids[i : i + 256])
                    yield pa.record_batch({
                        "shard": pa.array([shard] * n), "row": pa.array(np.arange(i, i + n, dtype=np.int32)),
                        "input_ids": pa.array(list(ids[i : i + n])), "cu_seqlens": pa.array(cumulative[i : i + n], pa.list_(pa.int32())), "position_ids": pa.array(list(place[i : i + n])),
                    })

    shards = manifest.select("shard").distinct()
    # with a number, adaptive execution does not merge the tasks again
    shards = shards.repartition(max(1, shards.count()))
    return shards.mapInArrow(run, "shard string, row int, input_ids array<int>, cu_seqlens array<int>, position_ids array<int>")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per packed segment of ``documents``; the shards lie in the shared folder."""
    return pack_documents(common.table(spark, sf_dir, "documents"), common.scratch(spark, "shards"))
