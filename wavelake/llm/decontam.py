"""Operator 3: find benchmark passages in the corpus through a positional inverted index.

The index holds postings (term, document, pos).  For every distinct test window of `WINDOW` words the
`RAREST` terms with the fewest postings are its anchors.  An anchor carries its context: the words of
the windows that it stands for, in their place around it.  Offset-adjusted intersection: a posting is
kept in the index where the words beside it are those beside an anchor of its term, as far as one edit
leaves them, and is stored with the `WINDOW` words on its either side.  Kept postings are compared word
by word with the context, laid over the document so that the anchor meets the posting, which makes the
matches exact.  Each comparison covers a window or two, whatever the length of document and item, and
equal windows of an item have one anchor, so repetitive texts take no more than others.

A proximity match is a window that becomes a stretch of the document by one edit: a word inserted,
lost or changed.  One edit spares one of two anchors, and of the two words on the longer side of
that anchor one at least stands next to it or one place off, so no such place is lost.  At a place
found the window is compared along its alignment and the two beside it, which decides exactly.  A
window with an edge word lost is a match of the others.

What is stored and shuffled: kept postings, no texts (`postings` gives a whole index).  Vocabulary and
contexts of the test set are broadcast after a check of rows and bytes.  For larger ones, terms are counted
before they are shuffled, and hashes of anchors with their neighbours, broadcast in parts of fixed size,
pick the postings that are.

Defined cases: null or empty texts have no words and no matches; an item of fewer words than the
window is one window and matches only exactly, as one word is more than a tenth of it; items without
words never match; rows that share a doc_id but not a text are kept apart; a null item_id is reported
as ``null``; empty tables give no rows or no matches; extra columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: Anchors per window: more prune better, fewer keep the index smaller.
RAREST = 2
#: Contexts that are broadcast: rows and bytes.
CONTEXTS, CONTEXT_BYTES = 500_000, 128 << 20
#: Hashes of terms with a neighbour that are broadcast at a time where contexts are more; 8 bytes each, some 24 in a task's table.
KEYS = 4_000_000


def item_words(items: DataFrame) -> DataFrame:
    """(copy, item, words): lower-case words of each test item that has any.

    ``copy`` numbers the rows: an item_id may repeat or be null, and its texts stay apart by it.
    """
    words = F.transform(common.alnum_words(F.col("text")), common.ascii_lower)
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("null"))
    rows = items.select(item.alias("item"), words.alias("words")).where(F.size("words") > 0)
    return rows.select(F.monotonically_increasing_id().alias("copy"), "item", "words")


def postings(docs: DataFrame) -> DataFrame:
    """The whole inverted index: (term, doc_id, text_hash, pos), positions from 0, and the document's ``words``, case kept."""
    words = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), common.alnum_words(F.col("text")).alias("words"))
    # the outer form: Spark derives a filter from the inner one that would split every text again
    raw = words.select("*", F.posexplode_outer("words").alias("pos", "raw")).where("raw is not null")
    return raw.select(common.ascii_lower(F.col("raw")).alias("term"), "doc_id", "text_hash", "pos", "words")


def frequencies(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, df): how many postings each term of ``vocabulary`` has.  Counted before any shuffle, whatever the vocabulary's size."""
    terms = postings(docs).select("term")
    few = common.broadcast_if_small(vocabulary)
    if few is vocabulary:  # many: a row for each term and task is what travels, then the vocabulary picks
        return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(vocabulary, "term")
    return terms.join(few, "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def anchors(words: DataFrame, frequency: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """(term, copy, item, p, low, high): for each distinct window of a text its rarest positions with a term that occurs at all.

    ``low`` to ``high`` are the words of the windows that an anchor stands for.  A window with more words that
    never occur in the corpus than the one an edit explains can't match and has no anchors.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    w = words.select("copy", "item", "words", F.explode(starts).alias("start"))
    w = w.groupBy("copy", "item", F.slice("words", F.col("start") + 1, window).alias("held")).agg(F.min("start").alias("start"))
    t = w.select("copy", "item", "start", F.size("held").alias("n"), F.posexplode("held").alias("o", "term"))
    t = t.join(frequency, "term", "left").withColumn("p", F.col("start") + F.col("o"))
    of_window = Window.partitionBy("copy", "start")
    t = (
        t.withColumn("absent", F.count_if(F.col("df").isNull()).over(of_window)).where(F.col("absent") <= F.when(F.col("n") == window, 1).otherwise(0)).where("df is not null")
        # one position of a repeated term is enough: the first in the window
        .withColumn("again", F.row_number().over(Window.partitionBy("copy", "start", "term").orderBy("p"))).where("again = 1")
        .withColumn("rank", F.row_number().over(of_window.orderBy("df", "term", "p"))).where(F.col("rank") <= rarest)
    )
    return t.groupBy("term", "copy", "item", "p").agg(F.min("start").alias("low"), F.max(F.col("start") + F.col("n")).alias("high"))


def contexts(anchor: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct contexts (context, term, held, o), the anchor being word ``o`` of ``held``; and which items have them (context, item)."""
    w = common.broadcast_if_small(words.select("copy", "words"))
    rows = anchor.join(w, "copy").select("item", "term", F.slice("words", F.col("low") + 1, F.col("high") - F.col("low")).alias("held"), (F.col("p") - F.col("low")).alias("o"))
    rows = common.materialize(rows.distinct(), "item-contexts")
    held = rows.select("term", "held", "o").distinct().select(F.monotonically_increasing_id().alias("context"), "term", "held", "o")
    held = common.materialize(held, "contexts")
    return held, common.materialize(rows.join(held, ["term", "held", "o"]).select("context", "item"), "context-items")


def _neighbours(term: Column, word: Callable[[int], Column]) -> Column:
    """array<long>: hashes of a term with the words one and two places before and after it, and of the term alone."""
    beside = [F.when(word(d).isNotNull(), F.xxhash64(F.lit(d > 0), term, word(d))) for d in (-2, -1, 1, 2)]
    return F.array_distinct(F.array_compact(F.array(*beside, F.xxhash64(term))))


def kept_postings(docs: DataFrame, context: DataFrame, window: int = WINDOW) -> DataFrame:
    """The stored index: (context, doc_id, text_hash, pos, around, held, o) of postings that an anchor's neighbours agree with.

    One of the two words on a side of the posting is one of the two there in the context; a context of
    one word has no neighbours.  ``around``: the words, case kept, from ``window`` before the posting, or the
    beginning, to ``window`` after it, as far as there are.

    Contexts that are too many to broadcast are met through hashes of a term and a neighbour: those are broadcast,
    `KEYS` at a time, a pass over the texts each, and only postings that have one are shuffled.
    """
    # compiled expressions only: an interpreted one would get each posting with all words of its document
    first = F.greatest(F.col("pos") - window, F.lit(0))
    reach = F.slice("words", first + 1, F.col("pos") + window + 1 - first)
    few = common.broadcast_if_small(context, CONTEXTS, CONTEXT_BYTES)
    beside = lambda words, at, d: F.get(words, at + d)
    same = F.size("held") == 1
    near = {d: common.ascii_lower(beside("words", F.col("pos"), d)) for d in (-2, -1, 1, 2)}
    if few is context:
        told = F.when(F.size("held") == 1, F.array(F.xxhash64("term"))).otherwise(F.filter(_neighbours(F.col("term"), lambda d: beside("held", F.col("o"), d)), lambda k: k != F.xxhash64("term")))
        keyed = common.materialize(context.withColumn("key", F.explode(told)), "context-keys")
        keys = common.materialize(keyed.select("key").distinct(), "keys")
        rows, passes = None, max(1, -(-keys.count() // KEYS))
        for i in range(passes):
            some = F.broadcast(keys.where(F.pmod("key", F.lit(passes)) == i))  # about `KEYS` numbers
            posted = postings(docs).withColumn("key", F.explode(_neighbours(F.col("term"), lambda d: near[d]))).join(some, "key", "left_semi")
            posted = posted.select("key", "term", "doc_id", "text_hash", "pos", reach.alias("around"))
            rows = posted if rows is None else rows.unionByName(posted)
        rows = common.materialize(rows, "near-anchors").join(keyed, ["key", "term"])
        near = {d: common.ascii_lower(beside("around", F.least("pos", F.lit(window)), d)) for d in (-2, -1, 1, 2)}
    else:
        rows = postings(docs).join(few, "term")
    for side in ((-1, -2), (1, 2)):
        for x in side:
            for y in side:
                same = same | F.coalesce(near[x] == beside("held", F.col("o"), y), F.lit(False))
    rows = rows.where(same)
    return rows.select("context", "doc_id", "text_hash", "pos", (F.col("around") if few is context else reach).alias("around"), "held", "o")


def _stretches(around: Column, held: Column, at: Column, window: int) -> Column:
    """array<struct<start, len, exact>>: stretches of ``around`` one edit at most from a window of ``held``, laid on it from ``at`` on."""
    n = F.lit(window)

    def stretch(start: Column, size: Column | int, exact: bool = False) -> Column:
        return F.struct(start.cast("int").alias("start"), (size if isinstance(size, Column) else F.lit(size)).cast("int").alias("len"), F.lit(exact).alias("exact"))

    def odd(shift: int) -> Column:
        # positions of the held words that differ from the document's, null where they are the same
        return F.transform(held, lambda x, i: F.when(F.get(around, at + shift + i).eqNullSafe(x), F.lit(None).cast("int")).otherwise(i))

    def of_window(s: Column, odds: Column) -> Column:
        def ends(name: str) -> tuple[Column, Column]:
            part = F.slice(odds[name], s + 1, n)
            return F.coalesce(F.array_min(part) - s, n), F.coalesce(s + n - 1 - F.array_max(part), n)

        def of_ends(e: Column) -> Column:
            head, tail, place = e["head"], e["tail"], at + s
            lost_first, lost_last = (head == 0) & (tail == n - 1), (head == n - 1) & (tail == 0)
            return F.array_compact(F.array(
                # the same; one word changed, at an edge or within
                F.when(head == n, stretch(place, n, True)).when(lost_first, stretch(place + 1, n - 1)).when(lost_last, stretch(place, n - 1)).when(head + tail >= n - 1, stretch(place, n)),
                # a word lost, the longer part before it or after it
                F.when(head + e["tail_left"] >= n - 1, stretch(place, n - 1)),
                F.when(e["head_right"] + tail >= n - 1, stretch(place + 1, n - 1)),
                # a word inserted between two words of the window
                F.when((head + e["tail_right"] >= n) & (head > 0) & (e["tail_right"] > 0), stretch(place, n + 1)),
                F.when((e["head_left"] + tail >= n) & (e["head_left"] > 0) & (tail > 0), stretch(place - 1, n + 1)),
            ))

        names = {"": "here", "_left": "left", "_right": "right"}
        both = [c for suffix, name in names.items() for c in zip(ends(name), ("head" + suffix, "tail" + suffix), strict=True)]
        return common.let(F.struct(*(c.alias(name) for c, name in both)), of_ends)

    def windows(odds: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(held) - n), lambda s: of_window(s, odds)))

    odds = F.struct(odd(0).alias("here"), odd(-1).alias("left"), odd(1).alias("right"))
    short = F.when(F.size(F.array_compact(odd(0))) == 0, F.array(stretch(at, F.size(held), True))).otherwise(F.array().cast("array<struct<start:int,len:int,exact:boolean>>"))
    return F.when(F.size(held) >= n, common.let(odds, windows)).otherwise(short)


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> tuple[DataFrame, DataFrame]:
    """Matches (doc_id, text_hash, context, start, len, exact), each found at least once, and the items of a context (context, item).

    Matches that are not exact are proximity matches; they are complete for windows of three words and two
    anchors at least.  ``text_hash`` tells rows of one doc_id apart.
    """
    words = common.materialize(item_words(items), "items")
    vocabulary = common.materialize(words.select(F.explode("words").alias("term")).distinct(), "vocabulary")
    frequency = common.materialize(frequencies(docs, vocabulary), "frequency")
    context, members = contexts(common.materialize(anchors(words, frequency, window, rarest), "anchors"), words)
    index = common.materialize(kept_postings(docs, context, window), "postings")
    before = F.least("pos", F.lit(window))
    lower = F.transform("around", common.ascii_lower)
    found = common.let(lower, lambda around: _stretches(around, F.col("held"), before - F.col("o"), window))
    found = index.select("doc_id", "text_hash", "context", (F.col("pos") - before).alias("first"), F.explode_outer(found).alias("m")).where("m is not null")
    found = found.select("doc_id", "text_hash", "context", (F.col("first") + F.col("m.start")).alias("start"), "m.len", "m.exact")
    return common.materialize(found, "matches"), members


def contaminated(found: DataFrame, members: DataFrame) -> DataFrame:
    """(doc, hash, n_hit, items, n_near, near_items) for each text with a match; ``near`` counts exact and proximity matches."""
    key = ("doc_id", "text_hash")
    # of the matches that begin at a word the longest covers the others
    longest = found.groupBy(*key, "start").agg(F.max(F.col("start") + F.col("len")).alias("end"), F.max(F.when(F.col("exact"), F.col("start") + F.col("len"))).alias("exact_end"))
    before = Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    new = lambda end: F.greatest(F.lit(0), F.col(end) - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))))
    covered = longest.select(*key, new("end").alias("near"), F.coalesce(F.when(F.col("exact_end").isNotNull(), new("exact_end")), F.lit(0)).alias("hit"))
    covered = covered.groupBy(*key).agg(F.sum("hit").cast("long").alias("n_hit"), F.sum("near").cast("long").alias("n_near"))
    of = found.groupBy(*key, "context").agg(F.max("exact").alias("exact")).join(common.broadcast_if_small(members), "context")
    of = of.groupBy(*key, "item").agg(F.max("exact").alias("exact"))
    named = of.groupBy(*key).agg(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("item")))).alias("items"), F.array_sort(F.collect_set("item")).alias("near_items"))
    named = named.select(F.col("doc_id").alias("doc"), F.col("text_hash").alias("hash"), "items", "near_items")
    return covered.join(named, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("text_hash") == F.col("hash"))).drop(*key)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """All columns of ``docs`` with n_words and what was found in them.

    Exact matches: n_hit, the words in them, and items, sorted.  Proximity matches, which include the exact
    ones: n_near and near_items.
    """
    per_text = common.materialize(contaminated(*matches(docs, items, window, rarest)), "contaminated")
    rows = docs.withColumns({"n_words": F.size(common.alnum_words(F.col("text"))).cast("long"), "__hash": F.xxhash64("text")})
    rows = rows.join(common.broadcast_if_small(per_text), F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("__hash") == F.col("hash")), "left").drop("doc", "hash", "__hash")
    none = {"n_hit": F.lit(0).cast("long"), "n_near": F.lit(0).cast("long"), "items": F.array().cast("array<string>"), "near_items": F.array().cast("array<string>")}
    return rows.withColumns({c: F.coalesce(c, empty) for c, empty in none.items()})


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no window of ``items`` occurs in, as it is or with one word inserted, lost or changed."""
    texts = docs.select("doc_id", "text")
    found, _ = matches(texts, items)
    lost = common.materialize(found.select(F.col("doc_id").alias("doc"), F.col("text_hash").alias("hash")).distinct(), "contaminated")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.struct("*").alias("row"))
    lost = common.broadcast_if_small(lost, 2_000_000)  # two numbers a row
    return rows.join(lost, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("text_hash") == F.col("hash")), "left_anti").select("row.*")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document of ``documents``: words hit by windows of ``benchmark`` and the items they are from.

    The columns with ``near`` count proximity matches too.
    """
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = contamination(docs, common.table(spark, sf_dir, "benchmark"))
    told = lambda items: F.sha2(F.array_join(items, ","), 256)
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), told("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        "n_near", F.size("near_items").cast("long").alias("n_near_items"), told("near_items").alias("near_items_sha256"),
    )


#: Exact matches join equal stretches.  Proximity matches join equal patterns: a window with an inner word masked and
#: a stretch so masked (c), a window without a word and a stretch (l), a window and a longer stretch without an inner word (i).
#: One edit leaves five words of ten side by side, so stretches are taken only around such fives.
OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, w[s : s + least(10, len(w)) - 1] AS v
  FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) u(s) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS p
  FROM d, ns, unnest(range(1, len(w) - n + 2)) u(s) WHERE len(w) >= n),
h AS (SELECT dw.doc_id, dw.s, dw.n, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.p = array_to_string(iw.v, ' ')),
ip AS (
  SELECT DISTINCT item, 'c' AS kind, array_to_string(v[1 : e] || ['*'] || v[e + 2 : 10], ' ') AS p FROM iw, unnest(range(1, 9)) u(e) WHERE n = 10
  UNION SELECT item, 'l', array_to_string(v[1 : e] || v[e + 2 : 10], ' ') FROM iw, unnest(range(0, 10)) u(e) WHERE n = 10
  UNION SELECT item, 'i', array_to_string(v, ' ') FROM iw WHERE n = 10),
five AS (SELECT DISTINCT array_to_string(v[e : e + 4], ' ') AS p FROM iw, unnest(range(1, 7)) u(e) WHERE n = 10),
df AS (SELECT doc_id, s, array_to_string(w[s : s + 4], ' ') AS p FROM d, unnest(range(1, len(w) - 3)) u(s)),
places AS (SELECT DISTINCT doc_id, unnest(range(greatest(1, s - 6), s + 1)) AS s FROM df WHERE p IN (SELECT p FROM five)),
da AS (SELECT d.doc_id, s, w FROM places JOIN d ON places.doc_id = d.doc_id),
dp AS (
  SELECT doc_id, s, 10 AS n, 'c' AS kind, array_to_string(w[s : s + e - 1] || ['*'] || w[s + e + 1 : s + 9], ' ') AS p FROM da, unnest(range(1, 9)) x(e) WHERE s <= len(w) - 9
  UNION ALL SELECT doc_id, s, 9, 'l', array_to_string(w[s : s + 8], ' ') FROM da WHERE s <= len(w) - 8
  UNION ALL SELECT doc_id, s, 11, 'i', array_to_string(w[s : s + e - 1] || w[s + e + 1 : s + 10], ' ') FROM da, unnest(range(1, 10)) x(e) WHERE s <= len(w) - 10),
m AS (SELECT doc_id, s, n, item FROM h UNION ALL SELECT dp.doc_id, dp.s, dp.n, ip.item FROM dp JOIN ip ON dp.kind = ip.kind AND dp.p = ip.p),
c AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM h) GROUP BY doc_id),
i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id),
nc AS (
  SELECT doc_id, count(DISTINCT x) AS n_near FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM m) GROUP BY doc_id),
ni AS (
  SELECT doc_id, count(*) AS n_near_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near, 0) AS n_near, coalesce(n_near_items, 0) AS n_near_items, sha256(coalesce(ni.items, '')) AS near_items_sha256
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN i ON d.doc_id = i.doc_id LEFT JOIN nc ON d.doc_id = nc.doc_id LEFT JOIN ni ON d.doc_id = ni.doc_id
"""
