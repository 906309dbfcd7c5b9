"""Operator 9: find licence notices by diagonal voting, with DataFrame functions only.

Templates are word sequences: base phrases, voting by their word pairs, and wordings of notices and
licence texts, voting by their 4-grams.  Their hashed k-grams form a small fixed table of (hash,
template, position).  The rolling k-gram hashes of every text are joined to it, and the words
themselves are compared at once, so no vote rests on a collision.  A hash that no template has joins
nothing, so such places are left out by a membership test before the rows are exploded.  A vote at
document word d for template word t lies on the diagonal d - t; votes are aggregated by diagonal.

* A base phrase stands at a place if all of its pairs vote for one diagonal.
* A notice may have words inserted or lost, which moves the rest to a neighbouring diagonal:
  neighbours at most `SHIFT` apart, or `SLACK_PERCENT` of the template's 4-grams where that is more, are
  merged, and the merged span is verified by the share of the template's 4-grams that it holds
  (`COVER`).  So a longer notice may be broken by a longer insertion.  A notice with a changed word in
  every four keeps none of its 4-grams, and one with a change each four to seven words too few; such
  are not found.

The template table is a constant of this module, which bounds its broadcast.

Defined cases: null text is empty and has no places; repeated rows get equal results; rows that
share a doc_id but not a text are kept apart; a null doc_id is a value like any other; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Wordings of common notices and licence texts, and the labels that the method adds.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0-notice",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
    "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
    "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license": "apache-2.0-header",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind": "apache-2.0-terms",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
    "see the gnu general public license for more details": "gpl-warranty",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0-notice",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0-notice",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-terms",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
    "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection "
    "with the software or the use or other dealings in the software": "mit-text",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-terms",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-2-clause-text",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-text",
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form "
    "or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-text",
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at": "mpl-2.0-notice",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely": "zlib-text",
}
#: Words of a base phrase's and of a notice's k-grams.
BASE_GRAM, NOTICE_GRAM = 2, 4
SHIFT, SLACK_PERCENT, COVER = 3, 40, 0.6


def _grams() -> list[tuple[str, str, str, bool, int, int, int]]:
    """(gram, template, label, base, k, at, grams) of all templates."""
    rows = []
    for base, k, texts in ((True, BASE_GRAM, BASE), (False, NOTICE_GRAM, NOTICES)):
        for text, label in texts.items():
            words = text.split()
            n = len(words) - k + 1
            rows += [(" ".join(words[i : i + k]), text, label, base, k, i, n) for i in range(n)]
    return rows


def _gram_hash(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*(F.get(words, at + j) for j in range(k)))


def template_grams(spark: SparkSession) -> DataFrame:
    """(hash, gram, template, label, base, k, at, grams): the voting k-grams of all templates."""
    names = ("gram", "template", "label", "base", "k", "at", "grams")
    # one literal: an expression for each value would take the driver seconds
    text = json.dumps([dict(zip(names, row, strict=True)) for row in _grams()])
    table = F.from_json(F.lit(text), "array<struct<gram:string,template:string,label:string,base:boolean,k:int,at:int,grams:int>>")
    t = spark.range(1, numPartitions=1).select(F.explode(table).alias("t")).select("t.*")
    words = F.split("gram", " ")
    return t.withColumn("hash", F.when(F.col("k") == BASE_GRAM, _gram_hash(words, F.lit(0), BASE_GRAM)).otherwise(_gram_hash(words, F.lit(0), NOTICE_GRAM)))


def votes(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """(doc_id, text_hash, template columns, pos): places where a template's k-gram stands."""
    words = F.transform(common.alnum_words(F.col("text")), common.ascii_lower)
    w = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words.alias("words"))
    # a few hundred constants: the hash of each gram, and of the two words it begins with
    table = grams.select("k", "hash", _gram_hash(F.split("gram", " "), F.lit(0), 2).alias("two")).distinct().collect()
    starts = F.when(F.size("words") >= 2, F.sequence(F.lit(0), F.size("words") - 2)).otherwise(F.array().cast("array<int>"))
    w = w.withColumn("near", F.filter(starts, lambda i: _gram_hash(F.col("words"), i, 2).isin(list({r.two for r in table}))))

    def places(k: int) -> Column:
        found = F.filter("near", lambda i: _gram_hash(F.col("words"), i, k).isin([r.hash for r in table if r.k == k]))
        # each place carries its own words, so a row that comes out of the explosion is small whatever the text's length
        return F.transform(found, lambda i: F.struct(i.alias("pos"), _gram_hash(F.col("words"), i, k).alias("hash"), F.array_join(F.slice("words", i + 1, k), " ").alias("held")))

    # the outer form: Spark derives a filter from the inner one and would compute all of this in it again
    w = w.select("doc_id", "text_hash", F.explode_outer(F.concat(places(BASE_GRAM), places(NOTICE_GRAM))).alias("place")).select("doc_id", "text_hash", "place.*")
    # an equality would become a part of the join key; the hash alone is the key
    same = (F.col("held") <= F.col("gram")) & (F.col("held") >= F.col("gram"))
    return w.join(F.broadcast(grams), "hash").where(same).select("doc_id", "text_hash", "template", "label", "base", "k", "grams", "at", "pos")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, label, base, start, end, cover): verified places, end exclusive, in words."""
    v = votes(docs, template_grams(docs.sparkSession))
    key = ("doc_id", "text_hash", "template", "label", "base", "grams")
    diagonal = v.groupBy(*key, (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("seen"), F.min("pos").alias("start"), F.max(F.col("pos") + F.col("k")).alias("end"))
    order = Window.partitionBy(*key).orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    far = (gap > SHIFT) & (100 * gap > SLACK_PERCENT * F.col("grams"))
    # a base phrase needs one diagonal, so each of its diagonals is an island
    fresh = F.when(F.col("base") | gap.isNull() | far, 1).otherwise(0)
    islands = diagonal.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order))
    merged = islands.groupBy(*key, "island").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("hits"), F.min("start").alias("start"), F.max("end").alias("end"))
    cover = F.col("hits") / F.col("grams")
    good = merged.withColumn("cover", cover).where(cover >= F.when(F.col("base"), 1.0).otherwise(COVER))
    return good.select("doc_id", "text_hash", "label", "base", "start", "end", "cover")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of ``docs``."""
    found = common.materialize(spans(docs.select("doc_id", "text")), "license-spans")
    base: Column = F.col("base")
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    per_doc = found.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        joined(F.collect_set("label")).alias("labels"),
        F.max("cover").alias("score"),
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(common.alnum_words(F.col("text"))).cast("long").alias("n_words"))
    rows = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    filled = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}
    return rows.select("doc_id", "n_words", *(F.coalesce(c, F.lit(filled[c])).alias(c) if c in filled else F.col(c) for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document of ``documents``: places of base phrases, all labels and a score."""
    return scan_licenses(common.table(spark, sf_dir, "documents"))


def _oracle() -> str:
    rows = [f"('{gram}', '{text}', '{label}', {base}, {k}, {at}, {n})" for gram, text, label, base, k, at, n in _grams()]
    return rf"""
WITH t(gram, template, label, base, k, place, grams) AS (VALUES {", ".join(rows)}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, s - 1 AS pos, k, array_to_string(w[s : s + k - 1], ' ') AS gram FROM d, (VALUES ({BASE_GRAM}), ({NOTICE_GRAM})) ks(k), unnest(range(1, len(w) - k + 2)) u(s)),
v AS (SELECT doc_id, template, label, base, grams, place, pos, pos - place AS diagonal FROM p JOIN t USING (k, gram)),
g AS (SELECT doc_id, template, label, base, grams, diagonal, list(DISTINCT place) AS seen, min(pos) AS s FROM v GROUP BY doc_id, template, label, base, grams, diagonal),
f AS (SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER o > greatest({SHIFT}, {SLACK_PERCENT} * grams // 100), true) THEN 1 ELSE 0 END AS fresh FROM g WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS island FROM f),
x AS (SELECT doc_id, template, label, base, grams, island, min(s) AS s, len(list_distinct(flatten(list(seen)))) / CAST(grams AS DOUBLE) AS cover FROM i GROUP BY doc_id, template, label, base, grams, island),
ok AS (SELECT * FROM x WHERE cover >= CASE WHEN base THEN 1.0 ELSE {COVER} END),
r AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(s) FILTER (WHERE base) AS first_word, max(s) FILTER (WHERE base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM ok GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""


OP9_SQL = _oracle()
