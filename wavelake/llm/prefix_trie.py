"""Operator 12: the trie of conversation prefixes, by preorder intervals and prefix sums.

A node is a distinct sequence of the first d turns (role, text) of some conversation; the conversations
that begin with it are its members.  No tree is walked:

1. Turns are numbered and reduced to 128 bits and a byte count; texts are never shuffled.
2. Equal conversations become one sequence with a count.  Distinct sequences are ranked in the
   lexicographic order of their turns, so the members of any node are a run of ranks, lo to hi.
3. A node's identity is its depth and the sum of its turns' place-bound hashes, a running sum.  One
   grouping by identity gives members, least conversation, lo and hi of every node.
4. Ordered by (lo, depth) the nodes are in preorder.  Running sums over that order of 1, of leaves and
   of savings, and the position of the last node of each rank, where the subtrees of that hi end, give
   every subtree's leaves and savings by one difference.

Long conversations: sequences are compared in blocks of `BLOCK` turns.  While a conversation has more
than one block, distinct blocks are ranked and their ranks become the turns of the next round, which
keeps the order, so no row ever holds more than `BLOCK` turns.  All numbering and all sums are those of
`operators.prefix`, where a key may span many tasks.  The digest of a node's full members is made from
their sorted ids in slices of `SLICE`, taken one after the other.

Two sequences of turns are held equal when 128 bits of hashes agree.

Defined cases: rows with a null conv_id belong to no conversation and are left out; a null role or text
is empty; null turns come first; ties in ``turn`` go by a hash of role and text; repeated rows are turns
of their own; a conversation may be rebuilt to no turns and is then a member of the root alone; an empty
table has no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import Running, number_rows, running
from . import common
from .components import with_one

#: Turns of a sequence that one row holds, and conversation ids of a slice of a digest.
BLOCK, SLICE = 512, 4096
#: How conversations are rebuilt: groups of `GROUP` ids share up to `HEAD` - 1 first turns.  Fixed values.
GROUP, HEAD = 5, 9
NO_MEMBER = hashlib.sha256(b"").hexdigest()
_LOW = (1 << 32) - 1


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, bytes): turns from 1 in order, as hashes of role and text and bytes of the text."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        "conv_id", "turn", F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), role, text).alias("b"), F.octet_length(text).cast("long").alias("bytes"))
    return number_rows(rows, ["conv_id"], ["turn", "a", "b"], "pos", 1).drop("turn")


def head_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes over."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEAD


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id, turns as of `turns_of`): the first h turns of conversation c - c % GROUP, then c's own after its first h."""
    convs = common.materialize(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("len")), "conversations")
    wanted = convs.select("conv_id", head_turns(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    heads = turns.where(F.col("pos") < HEAD).withColumnRenamed("conv_id", "base")
    taken = wanted.join(heads, "base").where("pos <= h").select("conv_id", "pos", "a", "b", "bytes")
    have = wanted.join(convs.withColumnRenamed("conv_id", "base"), "base", "left").select("conv_id", F.least("h", F.coalesce("len", F.lit(0))).alias("have"))
    own = turns.where(F.col("pos") > head_turns(F.col("conv_id")))
    n_own = F.greatest(F.col("len") - head_turns(F.col("conv_id")), F.lit(0)).alias("n")
    have = have.join(convs.select("conv_id", n_own), "conv_id").where("n > 0")
    own = with_one(own, have, "conv_id", own.count()).withColumn("pos", F.col("pos") - head_turns(F.col("conv_id")) + F.col("have"))
    return convs.select("conv_id"), common.materialize(taken.unionByName(own.select(*taken.columns)), "turns")


def sequence_keys(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, key: array<struct<a, b>>): keys order as the sequences of turns do, and none is longer than `BLOCK`."""
    rows = turns.select("conv_id", "pos", "a", "b")
    while True:
        block = F.floor((F.col("pos") - 1) / BLOCK).cast("long")
        blocks = rows.groupBy("conv_id", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b"))).alias("t"))
        blocks = common.materialize(blocks.select("conv_id", "block", F.transform("t", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))).alias("key")), "blocks")
        if not (blocks.agg(F.max("block")).first()[0] or 0):
            break
        distinct = blocks.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        ranked = common.materialize(number_rows(distinct, [], ["key"], "a"), "ranked")
        rows = with_one(blocks, ranked, "key", blocks.count()).select("conv_id", (F.col("block") + 1).alias("pos"), "a", F.lit(0).cast("long").alias("b"))
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    return convs.join(blocks.select("conv_id", "key"), "conv_id", "left").withColumn("key", F.coalesce("key", none))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (s1, s2, slice, ids) sorted by sequence and slice in, a digest a sequence out; ids are taken one row after the other."""
    now, sha = None, None
    for batch in batches:
        done = []
        for s1, s2, ids in zip(batch.column("s1").to_pylist(), batch.column("s2").to_pylist(), batch.column("ids"), strict=True):
            if (s1, s2) != now:
                if now:
                    done.append((*now, sha.hexdigest()))
                now, sha = (s1, s2), hashlib.sha256(ids.as_py().encode())
            else:
                sha.update(b"," + ids.as_py().encode())
        if done:
            yield pa.record_batch(dict(zip(("s1", "s2", "digest"), map(pa.array, zip(*done, strict=True)), strict=True)))
    if now:
        yield pa.record_batch({"s1": pa.array([now[0]]), "s2": pa.array([now[1]]), "digest": pa.array([sha.hexdigest()])})


def member_digests(members: DataFrame) -> DataFrame:
    """(s1, s2, digest): SHA-256 of the ids of each sequence's conversations, ascending, comma-joined."""
    placed = number_rows(members, ["s1", "s2"], ["conv_id"], "place")
    slices = placed.groupBy("s1", "s2", F.floor(F.col("place") / SLICE).alias("slice")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return slices.repartition("s1", "s2").sortWithinPartitions("s1", "s2", "slice").mapInArrow(_digests, "s1 long, s2 long, digest string")


def prefix_nodes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row per node of the trie of ``turns`` (conv_id, pos from 1, a, b, bytes); ``convs`` lists all conversations, turnless ones too.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, preorder, subtree_end): the last two
    are the node's interval of positions, from 1.
    """
    keys = sequence_keys(convs, turns)
    members = common.materialize(keys.select("conv_id", F.xxhash64("key").alias("s1"), F.xxhash64(F.lit(1), "key").alias("s2"), "key"), "members")
    distinct = members.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("copies"), F.min("conv_id").alias("least"), F.first("key").alias("key"))
    ranked = number_rows(distinct, [], ["key"], "rank").join(member_digests(members.drop("key")), ["s1", "s2"])
    ranked = common.materialize(ranked.select("rank", "copies", "least", "digest"), "sequences")

    one = turns.join(ranked.select(F.col("least").alias("conv_id"), "rank"), "conv_id").select("rank", F.col("pos").alias("depth"), "a", "b", "bytes")
    h = [F.xxhash64("depth", "a", "b"), F.xxhash64(F.lit(1), "depth", "a", "b")]
    lanes = [lane for x in h for lane in (x.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(x, 32))]
    one = running(one, ["rank"], ["depth"], {f"l{i}": Running("sum", lane) for i, lane in enumerate(lanes)})
    node = F.struct("depth", *(f"l{i}" for i in range(4)))
    parent = F.struct((F.col("depth") - 1).alias("depth"), *((F.col(f"l{i}") - lane).alias(f"l{i}") for i, lane in enumerate(lanes)))
    one = one.select("rank", node.alias("node"), parent.alias("parent"), "bytes")
    zero = F.lit(0).cast("long")
    root = F.struct(zero.alias("depth"), *(zero.alias(f"l{i}") for i in range(4)))
    roots = ranked.select("rank", root.alias("node"), F.lit(None).cast(one.schema["parent"].dataType).alias("parent"), zero.alias("bytes"))
    rows = one.unionByName(roots).join(ranked.select("rank", "copies", "least"), "rank")
    first = rows.groupBy("node").agg(
        F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.sum("copies").alias("n_convs"), F.min("least").alias("conv_id"), F.max("bytes").alias("bytes"), F.max("parent").alias("parent"))
    first = common.materialize(first, "nodes")

    children = first.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = first.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", zero))
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    leaf = (F.col("n_children") == 0).cast("long")
    nodes = nodes.withColumns({"depth": F.col("node.depth"), "leaf": leaf, "saved": saved})
    nodes = running(nodes, [], ["lo", "depth"], {"preorder": Running("sum", zero + 1), "leaves": Running("sum", F.col("leaf")), "sums": Running("sum", F.col("saved"))})
    nodes = common.materialize(nodes, "preorder")
    last = F.max(F.struct("preorder", "leaves", "sums", "depth"))
    ends = nodes.groupBy("lo").agg(last.alias("e"))
    ends = ends.join(ranked.select(F.col("rank").alias("lo"), "digest"), "lo").join(nodes.groupBy(F.col("hi").alias("lo")).agg(F.count(F.lit(1)).alias("n")), "lo", "left")
    ends = common.materialize(ends.select(F.col("lo").alias("rank"), "e", "digest", F.coalesce("n", zero).alias("n")), "ends")
    # the last node of a rank is the end of its sequence, and of every subtree with that hi
    out = with_one(nodes.withColumnRenamed("hi", "rank"), ends.drop("digest"), "rank", nodes.count())
    full = ends.select(F.col("e.preorder").alias("preorder"), "digest")
    out = out.join(full, "preorder", "left")
    parents = first.join(children.where("node is not null"), "node").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    below = with_one(out.where("depth > 0"), parents, "parent", nodes.count())
    out = below.unionByName(out.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast(dict(below.dtypes)["parent_conv_id"])))
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("e.leaves") - F.col("leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("e.sums") - F.col("sums") + F.col("saved")).alias("saved_tokens"), F.coalesce("digest", F.lit(NO_MEMBER)).alias("ends_sha256"), "preorder", F.col("e.preorder").alias("subtree_end"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per node of the trie of all rebuilt ``conversations``."""
    turns = common.materialize(turns_of(common.table(spark, sf_dir, "conversations")), "turns")
    return prefix_nodes(*rebuilt(turns)).drop("preorder", "subtree_end")


_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, d: list_reduce(list_prepend(xor(c, d), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda k, z: CASE WHEN k % 2 = 1 THEN xor(k >> 1, 3988292384::BIGINT) ELSE k >> 1 END)), 4294967295::BIGINT)"""

OP12_SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_CRC32} % 9 AS h, list(x ORDER BY i) AS own FROM t GROUP BY conv_id),
b AS (SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) AS seq FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5),
m AS (SELECT conv_id, len(seq) AS len, unnest(range(len(seq) + 1)) AS depth, seq FROM b),
n AS (SELECT depth, seq[1:depth] AS node, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(strlen(any_value(seq[depth].t)), 0) AS saved,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len = depth), '')) AS ends_sha256 FROM m GROUP BY 1, 2),
k AS (SELECT p.depth, p.node, count(ch.depth) AS n_children FROM n p LEFT JOIN n ch ON ch.depth = p.depth + 1 AND ch.node[1:p.depth] = p.node GROUP BY 1, 2),
a AS (SELECT n.*, k.n_children, unnest(range(n.depth + 1)) AS up FROM n JOIN k USING (depth, node)),
s AS (SELECT up AS depth, node[1:up] AS node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM a GROUP BY 1, 2)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, k.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN k USING (depth, node) JOIN s USING (depth, node) LEFT JOIN n p ON p.depth = n.depth - 1 AND p.node = n.node[1:n.depth - 1]
"""
