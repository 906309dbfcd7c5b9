"""Operator 8: mix sources to target weights by weighted fair queueing.

Every document of a source, in a fixed shuffled order, gets a virtual finish time: the source's
words up to and including it, divided by the source's target.  Served in that order by all
sources at once, the queue hands each source its share at every moment; the mix is the queue's
beginning up to the total budget.  A source whose target exceeds its size is queued again, up to
three passes.

Prefix sums are made in two steps so that a source with most of the rows is spread: sums by
(source, slice of the shuffle key), running totals over the slices, then running totals inside
each slice.  The global cut works alike on slices of the virtual time; the slice in which the budget ends
is cut again until at most `EDGE_ITEMS` queued documents are left in it.

`mix` joins the counts back to the rows by document.  Alike rows of a document stand side by side in the
queue, so they are nearly always used equally often and need no numbers, however many they are; only
where a pass begins or the budget ends among them are they told apart.

Defined cases: null or empty text has size 0 and is never taken; a null source is a source of its
own and sorts last; repeated rows queue as separate documents; documents without a doc_id are known by
their text; an empty table gives no rows; extra columns are ignored by `mix_sizes` and kept by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Weights dealt to the sources in turn, and how often a document may be used.
WEIGHTS = (5, 2, 1)
PASSES = 3
#: Slices of virtual time from 0 to 1, and hex digits of the shuffle key that make a slice of a source.
TIME_SLICES = 4096
KEY_DIGITS = 3
#: Queued documents that are put in order in one task to find the last one taken.
EDGE_ITEMS = 1 << 20
#: Beyond so many slices a double can't tell two virtual times apart.
FINEST = 1 << 48


def _size() -> Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _key() -> Column:
    """Where a document stands in its source's shuffled order: by doc_id, or by text without one."""
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")).cast("binary"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """(source, src, source_size, target): weights times the common level, capped at ``passes`` times the size.

    The excess of capped sources is shared again by weight.  Ordered by cap / weight, the capped
    sources are a prefix, so running sums find them at once.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    deal = F.element_at(F.array(*map(F.lit, weights)), ((F.col("src") - 1) % len(weights) + 1).cast("int"))
    t = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("src", F.row_number().over(by_name))
        .withColumn("weight", deal.cast("long"))
        .withColumn("cap", F.col("source_size") * passes)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("capped", F.col("cap") * F.col("weight_left") <= F.col("weight") * (F.col("total") - F.col("cap_before")))
        .withColumn("rest", F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything))
        .withColumn("shared", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(everything))
    )
    level = (F.col("weight") * F.col("rest")).cast("double") / F.col("shared")
    return t.select("source", "src", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level).alias("target"))


def _queued(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """sizes with src, source_size, target and ``upto``: the source's words in shuffled order up to the row."""
    t = common.broadcast_if_small(targets.withColumnRenamed("source", "named"))
    rows = sizes.join(t, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    rows = rows.withColumn("part", F.substring("key", 1, KEY_DIGITS))
    earlier = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("src", "part").agg(F.sum("size").alias("words"))
        .select("src", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("src", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("inside", F.sum("size").over(inside)).join(offsets, ["src", "part"]).withColumn("upto", F.col("offset") + F.col("inside"))


def _slot(finish: Column, scale: int) -> Column:
    """The slice of virtual time at ``scale`` slices a unit; all from 4 on are one, since the budget ends near 1."""
    return F.least(F.floor(finish * scale), F.lit(4 * scale)).cast("long")


def _edge(flat: DataFrame, budget: int) -> tuple[int, int, DataFrame, int] | None:
    """(scale, slot, its items, words before it) of the slice where the budget ends; None if it covers everything."""
    start, scale, inside = 0, TIME_SLICES, flat
    while True:
        slots = inside.groupBy(_slot(F.col("finish"), scale).alias("slot")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("items"))
        slots = slots.withColumn("upto", F.lit(start) + F.sum("words").over(Window.orderBy("slot")))
        edge = slots.where(F.col("upto") > budget).orderBy("slot").first()
        if edge is None:
            return None
        start = edge["upto"] - edge["words"]
        inside = flat.where(_slot(F.col("finish"), scale) == edge["slot"])
        if edge["items"] <= EDGE_ITEMS or edge["slot"] == 4 * scale or scale >= FINEST:
            return scale, edge["slot"], inside, start
        scale *= TIME_SLICES


def mix_sizes(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """(doc_id, source, size, key, source_size, target, times): how often the mix takes each document.

    The budget is the sum of all sizes.  Only two bounded facts reach the driver: the budget and
    the last item taken.
    """
    sizes = common.materialize(docs.select("doc_id", "source", _size().alias("size"), _key().alias("key")), "mix-sizes")
    targets = common.materialize(source_targets(sizes, weights, passes), "mix-targets")

    def item(e: Column) -> Column:
        finish = (e * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")
        return F.struct(finish.alias("finish"), F.col("key"), F.col("doc_id"), e.alias("pass"))

    items = F.when((F.col("size") > 0) & (F.col("target") > 0), F.transform(F.sequence(F.lit(0), F.lit(passes - 1)), item))
    queue = common.materialize(_queued(sizes, targets).withColumn("items", items), "mix-queue")
    budget = targets.agg(F.sum("source_size")).first()[0] or 0
    flat = queue.select("size", F.explode("items").alias("i")).select("size", "i.*")
    edge = _edge(flat, budget)
    if edge is None:
        taken = F.coalesce(F.size("items"), F.lit(0))
    else:
        scale, at, inside, start = edge
        order = ("finish", "key", "doc_id", "pass")
        upto = F.lit(start) + F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        last = inside.withColumn("upto", upto).where(F.col("upto") <= budget).orderBy(*(F.desc(c) for c in order)).first()
        within = F.lit(False)
        if last is not None:
            cut = F.struct(*(F.lit(last[c]).cast(t).alias(c) for c, t in (("finish", "double"), ("key", "string"), ("doc_id", dict(flat.dtypes)["doc_id"]), ("pass", "int"))))
        def served(i: Column) -> Column:
            at_edge = within if last is None else F.struct(*(i[c] for c in order)) <= cut
            slot = _slot(i["finish"], scale)
            return (slot < at) | ((slot == at) & at_edge)
        taken = F.when(F.col("items").isNull(), 0).otherwise(F.size(F.filter("items", served)))
    return queue.select("doc_id", "source", "size", "key", "source_size", "target", taken.alias("times"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each row as often as the mix takes it, in the columns of ``docs``.

    Rows are matched by (key, source, size).  ``uses`` counts, for e = 1, 2, ..., the rows alike in these that are
    taken e times or more.  If each count is none or all of them, every row joins its document's number at
    once, and a hot document may be split over tasks.  Else equal rows are counted before the shuffle, and
    the rows that begin the order of their texts take the larger numbers.
    """
    # names of their own beside the row, and no nulls, so that the join is by equality
    source = {"k_source": F.coalesce("source", F.lit("")), "k_null": F.col("source").isNull()}
    same = ("key", *source, "size")
    rows = docs.select(_key().alias("key"), *(c.alias(n) for n, c in source.items()), _size().alias("size"), F.struct("*").alias("row"))
    at_least = F.array(*(F.count_if(F.col("times") >= e) for e in range(1, PASSES + 1)))
    uses = mix_sizes(docs).where("size > 0").withColumns(source).groupBy(*same).agg(F.count(F.lit(1)).alias("n"), at_least.alias("uses"))
    uses = common.materialize(uses.where(F.col("uses")[0] > 0).withColumn("equal", F.forall("uses", lambda a: (a == 0) | (a == F.col("n")))), "mix-uses")
    times = uses.where("equal").select(*same, F.size(F.filter("uses", lambda a: a > 0)).alias("times"))
    mixed = rows.join(times, [*same]).select("row", "times")
    cut = uses.where("not equal").select(*same, "uses")
    if not cut.isEmpty():
        some = rows.join(common.broadcast_if_small(cut), [*same]).groupBy(*same, "uses", "row").agg(F.count(F.lit(1)).alias("n"))
        earlier = Window.partitionBy(*same).orderBy(F.to_json("row")).rowsBetween(Window.unboundedPreceding, -1)
        some = some.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        taken = F.aggregate("uses", F.lit(0).cast("long"), lambda t, a: t + F.greatest(F.least(a - F.col("before"), F.col("n")), F.lit(0)))
        mixed = mixed.union(some.select("row", taken.cast("int").alias("times")).where("times > 0"))
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("pass")).select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document of ``documents``: its size, its source's size and target, words taken."""
    rows = mix_sizes(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS src
  FROM d GROUP BY source),
w AS (
  SELECT *, CASE (src - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap,
         sum(source_size) OVER () AS total FROM s),
r AS (
  SELECT *, coalesce(sum(cap) OVER p, 0) AS cap_before,
         sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS weight_left
  FROM w WINDOW p AS (ORDER BY CAST(cap AS DOUBLE) / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * weight_left <= weight * (total - cap_before) AS capped FROM r),
t AS (
  SELECT source, source_size, total,
         CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE
           CAST(weight * (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) AS DOUBLE)
           / CAST(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS DOUBLE) END AS target
  FROM c),
q AS (
  SELECT d.doc_id, d.k, d.size, t.source_size, t.target, t.total,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
i AS (
  SELECT q.*, e.e, CAST(e.e * source_size + upto AS DOUBLE) / target AS finish
  FROM q, (VALUES (0), (1), (2)) e(e) WHERE size > 0 AND target > 0),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, k, doc_id, e ROWS UNBOUNDED PRECEDING) <= total AS served FROM i),
n AS (SELECT doc_id, CAST(sum(CASE WHEN served THEN size ELSE 0 END) AS BIGINT) AS taken FROM g GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(n.taken, 0) AS taken
FROM q LEFT JOIN n ON q.doc_id = n.doc_id
"""
