"""Operator 1: document quality by a linear-chain conditional random field over lines.

Every line is good or bad.  A line's features describe it and its two neighbours; the chain adds
weights for pairs of labels.  The field is trained by conditional likelihood on documents whose
lines all take the document's label.  A document's score is the mean of its lines' forward-backward
marginals of `good`, weighted by line length.

Training reads at most `SAMPLE_DOCS` labelled documents (the least by hash of their id, those of
more than `SAMPLE_LINES` lines left out) and only ids whose crc32 modulo `FOLDS` is not 0; their line
features, not texts, reach the driver.  Scoring is one pass without a shuffle; a task holds one slice
of about `SLICE` bytes of text, or a single longer document.  Inputs of a score are the text alone.

Defined cases: null text is one empty line; repeated rows get equal scores; a null doc_id is scored
and never trained on; labels that are null or contradict each other are not used; without both
labels in the sample every score is the share of good labels (1 without any); an empty table gives
no rows; other columns are ignored, and `keep_good` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SAMPLE_DOCS, SAMPLE_LINES, FOLDS = 3000, 300, 5
#: Score from which a document is predicted good.
THRESHOLD = 0.3
SLICE = 2 << 20
#: Training: L2 weight per document, rounds of Newton's method on lines alone, then of Adam on chains.
L2, NEWTON, ADAM, RATE = 1e-5, 8, 80, 0.15

_CLASS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
    "symbol": b"#*$%&<>{}[]\\^~=_+@", "bar": b"|", "mark": b"!?", "stop": b".,;:", "space": b" \t\r\x0b\x0c\n",
}
_TABLES = {name: np.isin(np.arange(256), np.frombuffer(chars, np.uint8)) for name, chars in _CLASS.items()}
#: Bytes that begin a code point.
_TABLES["char"] = (np.arange(256) & 0xC0) != 0x80
FEATURES = (
    "empty", "length", "upper", "symbols", "marks", "bars", "digits", "repeats", "seen", "stops", "word_length",
    "ends_stopped", "begins_upper", "few_words", "many_upper", "many_symbols", "many_repeats", "many_bars", "many_marks",
)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, first line of each text and the total, characters of each line)."""
    data = b"\n".join(texts) + b"\n"
    first = np.concatenate([[0], np.cumsum([t.count(b"\n") + 1 for t in texts])]).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = {name: np.add.reduceat(t[raw], starts, dtype=np.int64).astype(np.float64) for name, t in _TABLES.items()}
    n["char"] -= 1  # the line's own \n
    space = _TABLES["space"][raw]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    line = np.searchsorted(ends, begin)
    words = np.bincount(line, minlength=len(ends)).astype(np.float64)
    repeats = np.zeros(len(ends))
    if len(begin) > 1:
        total = np.add.reduceat(raw, np.stack([begin, end], 1).ravel()[: 2 * len(begin) - (end[-1] >= len(raw))], dtype=np.int64)[::2]
        alike = (total[1:] == total[:-1]) & (end[1:] - begin[1:] == end[:-1] - begin[:-1]) & (raw[begin[1:]] == raw[begin[:-1]]) & (line[1:] == line[:-1])
        repeats = np.bincount(line[1:][alike], minlength=len(ends)).astype(np.float64)
    seen = np.zeros(len(ends))
    lines = data.split(b"\n")[:-1]
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a > 1:
            known: set[bytes] = set()
            for i in range(a, b):
                if lines[i] in known:
                    seen[i] = 1
                elif lines[i]:
                    known.add(lines[i])
    some = np.maximum(words, 1)
    letters = np.maximum(n["char"] - n["space"] + 1 - n["digit"] - n["symbol"] - n["mark"] - n["stop"] - n["bar"], 1)
    last = raw[np.maximum(ends - 1, starts)]
    upper, symbols, marks, bars = n["upper"] / letters, n["symbol"] / some, n["mark"] / some, n["bar"] / some
    repeated = repeats / np.maximum(words - 1, 1)
    x = np.stack([
        words == 0, np.log1p(n["char"]) / 6, upper, np.minimum(symbols, 3) / 3, np.minimum(marks, 3) / 3, np.minimum(bars, 2) / 2,
        np.minimum(n["digit"] / some, 3) / 3, repeated, seen, np.minimum(n["stop"] / some, 1), np.minimum(n["char"] / some, 30) / 30,
        np.isin(last, np.frombuffer(b".!?", np.uint8)), _TABLES["upper"][raw[starts]], words < 4,
        upper > 0.5, symbols > 0.4, repeated > 0.3, bars > 0.15, marks > 0.5,
    ], 1).astype(np.float64)
    return x, first, n["char"]


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of each line, of the lines before and after it in the text, and flags for its ends and 1."""
    head, tail = np.zeros(len(x), bool), np.zeros(len(x), bool)
    head[first[:-1]] = True
    tail[first[1:] - 1] = True
    before, after = np.roll(x, 1, 0), np.roll(x, -1, 0)
    before[head] = 0
    after[tail] = 0
    return np.column_stack([x, before, after, head, tail, np.ones(len(x))])


def forward_backward(logit: np.ndarray, first: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginal of good per line, expected label pairs per text [n, 2, 2], log partition per text).

    ``logit`` is the score of good over bad of each line alone, ``pairs`` the 2 x 2 pair scores.  Texts run
    side by side, longest first, so a step costs one small vector operation.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size, begin = size[order], first[:-1][order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), "left")  # texts with more than t lines
    shift = np.maximum(logit, 0)
    emit = np.stack([np.exp(-shift), np.exp(logit - shift)], 1)
    step = np.exp(pairs)
    alpha, beta = np.empty((len(logit), 2)), np.ones((len(logit), 2))
    scale = np.ones(len(logit))
    now = emit[begin]
    for t in range(longest):
        at = begin[: active[t]] + t
        if t:
            now = (now[: len(at)] @ step) * emit[at]
        c = now.sum(1)
        now = now / c[:, None]
        alpha[at], scale[at] = now, c
    for t in range(longest - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        beta[at] = (emit[at + 1] * beta[at + 1]) @ step.T / scale[at + 1, None]
    good = alpha[:, 1] * beta[:, 1] / (alpha * beta).sum(1)
    inner = np.ones(len(logit), bool)
    inner[first[:-1]] = False
    here = np.flatnonzero(inner)
    both = alpha[here - 1][:, :, None] * step[None] * (emit[here] * beta[here])[:, None, :] / scale[here, None, None]
    expected = both.sum(0)
    total = np.add.reduceat(np.log(scale) + shift, first[:-1]) if len(first) > 1 else np.zeros(0)
    return good, expected, total


class Field:
    """The trained field: line weights, pair scores, or a constant where nothing could be learned."""

    def __init__(self, weights: np.ndarray | None, pairs: np.ndarray, constant: float = 1.0):
        self.weights, self.pairs, self.constant = weights, pairs, constant

    def score(self, texts: list[bytes]) -> np.ndarray:
        x, first, chars = line_features(texts)
        if self.weights is None:
            return np.full(len(texts), self.constant)
        good, _, _ = forward_backward(with_neighbours(x, first) @ self.weights, first, self.pairs)
        weight = chars + 1
        return np.clip(np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]), 0, 1)


def train(x: np.ndarray, first: np.ndarray, label: np.ndarray) -> Field:
    """Fit the field to texts of one label each; ``x`` has the lines' own features."""
    if len(label) == 0 or label.min() == label.max():
        return Field(None, np.zeros((2, 2)), float(label.mean()) if len(label) else 1.0)
    size = np.diff(first)
    z, y, texts = with_neighbours(x, first), np.repeat(label, size).astype(np.float64), len(label)
    of_line = np.repeat(1 / size, size)  # each text counts once
    w = np.zeros(z.shape[1])
    for _ in range(NEWTON):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (of_line * (y - p)) / texts - L2 * w
        curve = (z * (of_line * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z / texts + L2 * np.eye(len(w))
        w = w + np.linalg.solve(curve, grad)
    # the chain: gradient = observed minus expected features and pairs
    pairs = np.zeros((2, 2))
    steps = np.bincount(label, weights=size - 1, minlength=2)
    seen = np.diag(steps)
    theta = np.concatenate([w, pairs.ravel()])
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    lines = len(y)
    for i in range(1, ADAM + 1):
        w, pairs = theta[:-4], theta[-4:].reshape(2, 2)
        good, expected, _ = forward_backward(z @ w, first, pairs)
        grad = np.concatenate([z.T @ (y - good), (seen - expected).ravel()]) / lines - L2 * theta
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        rate = RATE * (1 - i / (ADAM + 1))
        theta = theta + rate * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-8)
    return Field(theta[:-4], theta[-4:].reshape(2, 2))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes) in slices of about `SLICE` bytes."""
    out, held, at = [], 0, 0
    for i, t in enumerate(texts.cast(pa.large_binary())):
        text = t.as_py() or b""
        if out and held + len(text) > SLICE:
            yield at, out
            out, held, at = [], 0, i
        out.append(text)
        held += len(text)
    if out:
        yield at, out


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column("quality").to_numpy(zero_copy_only=False)
        for at, texts in _slices(batch.column("text")):
            x, first, _ = line_features(texts)
            rows = [(int(labels[at + i]), x[a:b].astype(np.float32).tobytes()) for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)) if b - a <= SAMPLE_LINES]
            yield pa.record_batch({"label": pa.array([r[0] for r in rows], pa.int32()), "lines": pa.array([r[1] for r in rows], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame) -> Field:
    """Train on the bounded sample of ``labels`` (doc_id, quality) outside the held-out fold.

    At most `SAMPLE_DOCS` ids are drawn and twice as many rows of ``docs`` learned from, so where ids repeat
    the rows with the greatest feature hashes are not.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    sample = F.broadcast(common.sample_by_hash(known, ["doc_id"], SAMPLE_DOCS))  # at most SAMPLE_DOCS rows
    rows = docs.select("doc_id", "text").join(sample, "doc_id").select("text", "quality")
    got = rows.mapInArrow(_sample_features, "label int, lines binary").orderBy(F.xxhash64("lines"), "label").limit(2 * SAMPLE_DOCS).collect()
    lines = [np.frombuffer(r.lines, np.float32).reshape(-1, len(FEATURES)).astype(np.float64) for r in got]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)
    return train(np.concatenate(lines) if lines else np.zeros((0, len(FEATURES))), first, np.array([r.label for r in got], np.int64))


def score(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with a double column ``score``; a column of that name is replaced."""
    kept = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [field.score(texts) for _, texts in _slices(batch.column("text"))]
            columns = [*batch.columns, pa.array(np.concatenate(values) if values else np.zeros(0))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "score"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, in all their columns."""
    field = fit(docs, labels)
    rows = docs.select("text", F.struct("*").alias("row"))
    return score(rows, field).where(F.col("score") >= threshold).select("row.*")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document of ``documents``: its fold, score and prediction."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    field = fit(docs, common.table(spark, sf_dir, "labels").select("doc_id", "quality"))
    rows = score(docs, field)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
