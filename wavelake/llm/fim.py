"""Operator 13: fill-in-middle, by bit-parallel work on big integers.

A text is cut into units ``[A-Za-z]+|[^A-Za-z]`` of code points and two cuts at unit boundaries make a
prefix, a middle and a suffix.  The output is one of three forms:

* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
* ``plain``: the text as it is, where it is empty, holds a sentinel, or chance says so

Each UTF-8 text becomes two big integers with a bit per byte, first byte on top: ``bytes.translate``
marks letters, and bytes that begin a code point.  A unit begins at a code point unless it and the byte
before are letters: one shift, one AND, one XOR.  ``bit_count`` of the result is the number of units,
and the byte where unit k begins is found by halving: count the upper half, keep the half that holds
the k-th bit.  The work is linear in the text and its masks take an eighth of it.

The cuts and the form depend on ``seed:doc_id`` alone, so reruns agree whatever the partitions.

`restore` rebuilds a text from its output and form: a sentinel cannot begin inside another or inside
the text, so the first of each kind is the mark.

Defined cases: a null text is empty; a null doc_id counts as the empty string; repeated rows get equal
results; an empty table gives no rows; other columns are ignored.  Texts of any length are cut whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

P, S, M = "<P>", "<S>", "<M>"
#: The seed, per cent of texts left plain, and per cent of the others in suffix-first form.
SEED, PLAIN, SPM = 1, 10, 20
#: Outputs are handed on whenever so many bytes are ready.
FLUSH = 16 << 20

_LETTERS = bytes(48 + (65 <= b <= 90 or 97 <= b <= 122) for b in range(256))
_BEGINS = bytes(48 + (b & 0xC0 != 0x80) for b in range(256))


def marks(raw: bytes) -> tuple[int, int]:
    """(where units begin, where code points begin): a bit per byte, the first byte on top."""
    if not raw:
        return 0, 0
    letters, begins = int(raw.translate(_LETTERS), 2), int(raw.translate(_BEGINS), 2)
    return begins ^ letters & letters >> 1, begins


def place(bits: int, width: int, k: int) -> int:
    """How many of ``width`` bits stand above the k-th set one, counted from 0 from the top; ``width`` if there is none."""
    if k >= bits.bit_count():
        return width
    above = 0
    while width > 1:
        low = width >> 1
        upper = bits >> low
        n = upper.bit_count()
        if k < n:
            bits, width = upper, width - low
        else:
            bits, width, k, above = bits ^ upper << low, low, k - n, above + width - low
    return above


def chances(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """The four draws of a document: the first 8-digit groups of a SHA-256."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def arrange(raw: bytes, draws: tuple[int, int, int, int], plain: int = PLAIN, spm: int = SPM) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output) of one UTF-8 text."""
    units, begins = marks(raw)
    n, width = units.bit_count(), len(raw)
    if not raw or draws[2] % 100 >= 100 - plain or any(s.encode() in raw for s in (P, S, M)):
        return n, "plain", None, None, raw
    one, two = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    one, two = place(units, width, one), place(units, width, two)
    before, upto = ((begins >> width - at).bit_count() for at in (one, two))
    head, middle, tail = raw[:one], raw[one:two], raw[two:]
    if draws[3] % 100 < spm:
        return n, "spm", before, upto - before, b"<S>%b<P>%b<M>%b" % (tail, head, middle)
    return n, "psm", before, upto - before, b"<P>%b<S>%b<M>%b" % (head, tail, middle)


def fill_in_middle(docs: DataFrame, seed: int = SEED, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each of ``docs`` (doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.large_binary())
            made: list[tuple] = []
            first = held = 0

            def flush(to: int, ids=ids) -> pa.RecordBatch:
                n, form, before, middle, output = zip(*made, strict=True)
                return pa.record_batch({
                    "doc_id": ids.slice(first, to - first), "n": pa.array(n, pa.int64()), "form": pa.array(form, pa.string()),
                    "prefix_chars": pa.array(before, pa.int64()), "middle_chars": pa.array(middle, pa.int64()),
                    "output": pa.array(output, pa.binary()).cast(pa.string())})

            for i, (key, text) in enumerate(zip(ids, texts, strict=True)):
                made.append(arrange(text.as_py() or b"", chances(key.as_py(), seed), plain, spm))
                held += len(made[-1][-1])
                if held >= FLUSH:
                    yield flush(i + 1)
                    made, first, held = [], i + 1, 0
            if made:
                yield flush(batch.num_rows)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text, rebuilt from an output and its form alone."""
    after = lambda s, mark: F.get(F.split(s, mark, 2), F.lit(1))
    before = lambda s, mark: F.get(F.split(s, mark, 2), F.lit(0))
    body, middle = before(output, M), after(output, M)
    psm = F.concat(before(after(body, P), S), middle, after(body, S))
    spm = F.concat(after(body, P), middle, before(after(body, S), P))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document of ``documents``: units, form, lengths, and digests of the output and of the text rebuilt from it."""
    out = fill_in_middle(common.table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS head, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS tail FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(head) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || middle ELSE '<S>' || tail || '<P>' || head || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
