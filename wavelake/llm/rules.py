"""Operator 6: quality rules with risk-controlled thresholds, by DataFrame functions only.

Each document gets measurements and fails the base rules or not.  Further rules reject a document
whose measurement exceeds a cutoff, and the cutoffs are chosen per stratum (language) so that few
good documents are lost:

* holdout: the labelled texts of the stratum that are good and pass the base rules, each text once, since
  copies are no independent draws;
* the rules' cutoffs move together along one path of `STEPS` steps, fixed in advance, from lenient to
  strict; a step is safe if the exact binomial (Clopper-Pearson) upper bound on the chance that a good
  document exceeds any of its cutoffs is at most `RISK`;
* steps are tried from lenient to strict and the first unsafe one ends the search (fixed-sequence
  testing), so steps and rules need no correction among each other; strata are corrected by
  Bonferroni: level `LEVEL` / strata.

So with probability 1 - `LEVEL` no stratum loses more than `RISK` of its good texts to these rules.  A
stratum with too few labelled texts (under 217 of 4 strata) gets no cutoffs and rejects nothing beyond
the base rules.

The bound is tested without inverting it: upper bound <= r if and only if P(Bin(n, r) <= k) <= level.

Everything of a document is computed within its row; shuffles carry measurements or counts only.
Defined cases: null text has no words; labels that are null, or contradict each other on one
doc_id, are not used; a null language is a stratum of its own; repeated rows and copies are judged each,
but count once in a stratum's holdout; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
RISK, LEVEL = 0.02, 0.05

STEPS = 24
#: Rules: a measurement that is bad when high, and its most lenient and its strictest cutoff.
RULES: dict[str, tuple[str, float, float]] = {
    "symbols_per_word": ("n_symbols / nullif(n_words, 0)", 2.0, 0.1),
    "dup_line_share": ("n_dup_lines / greatest(n_lines, 1L)", 0.9, 0.3),
    "repeat_share": ("n_repeat_words / nullif(n_words, 0)", 0.3, 0.15),
    "upper_share": ("n_upper / greatest(word_chars, 1L)", 0.9, 0.25),
    "chars_per_word": ("word_chars / nullif(n_words, 0)", 40.0, 10.0),
    "marks_per_word": ("n_marks / nullif(n_words, 0)", 2.0, 0.15),
}


def cutoffs_of(rule: str) -> list[float]:
    """The rule's cutoffs along the path: a geometric series."""
    _, lenient, strict = RULES[rule]
    return [round(lenient * (strict / lenient) ** (i / (STEPS - 1)), 6) for i in range(STEPS)]


def _without(text: Column, chars: str) -> Column:
    return F.regexp_replace(text, f"[{chars}]+", "")


def _doubled(hashes: Column, span: int) -> Column:
    """Hashes of windows of 2 * span words from those of windows of span words, or from the words."""
    return F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - span, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(hashes, i + span)))


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks (long)."""
    text = F.coalesce("text", F.lit(""))
    w = docs.withColumn("__words", common.space_words(F.col("text")))
    n = F.size("__words")
    # the hash of a window of 2, 4, 8 words is that of its halves' hashes
    hashes, span = F.col("__words"), 1
    while span < REPEAT_WINDOW:
        w = w.withColumn(f"__{2 * span}", _doubled(hashes, span))
        span *= 2
        hashes = F.col(f"__{span}")
    w = w.withColumn("__hashes", hashes)
    w = w.withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0))
    # most texts repeat no window: sorting is left to those that do
    some = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
    w = w.withColumn("__placed", F.when(some, F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = lambda x, k: F.coalesce(F.get("__placed", k)["h"] == x["h"], F.lit(False))
    found = F.filter("__placed", lambda x, k: ((k > 0) & twin(x, k - 1)) | twin(x, k + 1))
    w = w.withColumn("__at", F.sort_array(F.transform(found, lambda x: x["i"])))
    gaps = F.transform("__at", lambda p, k: F.least(F.coalesce(F.get("__at", k + 1) - p, F.lit(REPEAT_WINDOW)), F.lit(REPEAT_WINDOW)))
    w = w.withColumn("__repeat", F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)))
    joined = F.array_join("__words", "")
    size = F.length(text)
    return w.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(joined).cast("long"),
        "n_symbols": (size - F.length(_without(text, SYMBOLS))).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.col("__repeat").cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_upper": (size - F.length(_without(text, "A-Z"))).cast("long"),
        "n_marks": (size - F.length(_without(text, "!?"))).cast("long"),
        "base_failed": (n < MIN_WORDS) | (100 * F.col("__repeat") > MAX_REPEAT_PERCENT * n),
    }).drop("__words", "__2", "__4", "__8", "__hashes", "__lines", "__placed", "__at", "__repeat")


def _value(rule: str) -> Column:
    return F.coalesce(F.expr(RULES[rule][0]), F.lit(0.0))


def binomial_cdf(k: Column, n: Column, r: float) -> Column:
    """P(Bin(n, r) <= k) for 0 <= k <= n * r, summed downwards from k, where the terms only shrink."""
    odds = r / (1 - r)
    k, n = k.cast("long"), n.cast("double")
    up = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    log_pmf = F.aggregate(up, n * math.log1p(-r), lambda a, j: a + F.log((n - j + 1) / j * odds))
    down = F.reverse(up)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(a: Column, j: Column) -> Column:
        term = a["term"] * j / ((n - j + 1) * odds)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    return F.exp(log_pmf) * F.aggregate(down, start, step)["sum"]


def choose_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(stratum, step): the strictest step of the path that is safe with all before it, from rows of `measure` with ``lang`` and ``text_hash``."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("least"), F.max("quality").alias("most")).where("least = 1 and most = 1")
    held = measured.where("not base_failed").join(good.select("doc_id"), "doc_id")
    # the number of a rule's cutoffs that a document stays under: it exceeds all from there on
    under = lambda rule: F.size(F.filter(F.array(*map(F.lit, cutoffs_of(rule))), lambda c: _value(rule) <= c))
    first = held.select(F.col("lang").alias("stratum"), "text_hash", F.least(*map(under, RULES)).alias("step")).distinct()
    counts = common.materialize(first.groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("c")), "rule-counts")
    sizes = counts.groupBy("stratum").agg(F.sum("c").alias("n"))
    strata = sizes.count()
    rows = sizes.select("stratum", "n", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("step"))
    c = counts.select(F.col("stratum").alias("s"), F.col("step").alias("j"), "c")
    rows = rows.join(c, F.col("stratum").eqNullSafe(F.col("s")) & (F.col("step") == F.col("j")), "left")
    so_far = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    tested = rows.withColumn("k", F.sum(F.coalesce("c", F.lit(0))).over(so_far))
    safe = F.when(F.col("k") <= F.col("n") * risk, binomial_cdf(F.col("k"), F.col("n"), risk) <= level / max(1, strata)).otherwise(False)
    return tested.withColumn("all_safe", F.min(safe).over(so_far)).where("all_safe").groupBy("stratum").agg(F.max("step").alias("step"))


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Measurements of each document of ``docs`` with base_failed, rejected_by (rules exceeded) and kept."""
    wanted = ("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "base_failed")
    rows = measure(docs.select("doc_id", "lang", "text")).select(*wanted, F.xxhash64("text").alias("text_hash"))
    measured = common.materialize(rows, "measured")
    chosen = choose_cutoffs(measured, labels.select("doc_id", "quality"))
    chosen = common.materialize(chosen, "cutoffs")
    rows = measured.join(common.broadcast_if_small(chosen), F.col("lang").eqNullSafe(F.col("stratum")), "left")
    broken = F.array(*(F.when(_value(rule) > F.get(F.array(*map(F.lit, cutoffs_of(rule))), F.col("step")), F.lit(rule)) for rule in RULES))
    rows = rows.withColumn("rejected_by", F.array_compact(broken))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("stratum", "step", "text_hash")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document of ``documents``: base measurements, base verdict and final verdict."""
    rows = apply_rules(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.size("rejected_by").cast("long").alias("n_broken"))


def _oracle() -> str:
    cutoffs = ", ".join(f"('{rule}', {i}, CAST({c} AS DOUBLE))" for rule in RULES for i, c in enumerate(cutoffs_of(rule)))
    values = " UNION ALL ".join(f"SELECT doc_id, '{rule}' AS rule, coalesce({expr.replace('1L', '1')}, 0) AS v FROM b" for rule, (expr, *_) in RULES.items())
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s : s + {REPEAT_WINDOW - 1}], ' ') AS p FROM d, unnest(range(1, len(w) - {REPEAT_WINDOW - 2})) u(s)),
rep AS (SELECT doc_id, s FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, p) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT x) AS n_repeat_words FROM (SELECT doc_id, unnest(range(s, s + {REPEAT_WINDOW})) AS x FROM rep) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, d.lang, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, coalesce(n_repeat_words, 0) AS n_repeat_words,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_marks
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id),
b AS (SELECT *, len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
v AS ({values}),
c(rule, i, cutoff) AS (VALUES {cutoffs}),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1),
held AS (SELECT min(b.doc_id) AS doc_id, b.lang FROM b JOIN good ON b.doc_id = good.doc_id WHERE NOT base_failed GROUP BY b.lang, b.t),
sz AS (SELECT lang, count(*) AS n FROM held GROUP BY lang),
over AS (SELECT held.doc_id, held.lang, c.i, bool_or(v.v > c.cutoff) AS any_over FROM held JOIN v ON v.doc_id = held.doc_id JOIN c ON c.rule = v.rule GROUP BY ALL),
k AS (SELECT sz.lang, sz.n, over.i, count(*) FILTER (WHERE any_over) AS k FROM over JOIN sz ON over.lang IS NOT DISTINCT FROM sz.lang GROUP BY ALL),
safe AS (SELECT *, k <= n * {RISK} AND coalesce((SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({RISK}) + (n - j) * ln(1 - {RISK}))) FROM unnest(range(k + 1)) q(j)), 0)
         <= {LEVEL} / (SELECT count(*) FROM sz) AS ok FROM k),
run AS (SELECT *, bool_and(ok) OVER (PARTITION BY lang ORDER BY i ROWS UNBOUNDED PRECEDING) AS all_ok FROM safe),
cut AS (SELECT lang, c.rule, c.cutoff FROM (SELECT lang, max(i) AS i FROM run WHERE all_ok GROUP BY lang) JOIN c USING (i)),
bad AS (SELECT b.doc_id, count(*) AS n_broken FROM b JOIN cut ON b.lang IS NOT DISTINCT FROM cut.lang JOIN v ON v.doc_id = b.doc_id AND v.rule = cut.rule WHERE v.v > cut.cutoff GROUP BY b.doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_broken IS NULL AS kept, coalesce(n_broken, 0) AS n_broken
FROM b LEFT JOIN bad ON b.doc_id = bad.doc_id
"""


OP6_SQL = _oracle()
