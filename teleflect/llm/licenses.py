"""License scans in DataFrame functions only: exact phrases, and an exact set-similarity join with license templates.

Words are runs of [a-z0-9] and non-ASCII characters, ASCII capitals lowered. A template is a whole notice or license
body. It is held against blocks of twice its own length in words (8 at least); blocks start at every half, so a stretch
of the template's length lies whole in one. A block meets a template if it holds at least `least` of the template's
distinct tokens (containment |B & T| / |T|).

The join: tokens are ordered by how often they occur in all documents, rarest first. A block that meets T shares one of
T's first |T| - need + 1 tokens (prefix filter), has at least `need` words (length filter), and from the first token
that they share on, both have enough left (positional filter); what passes is counted exactly. Only template words
are kept of a text, in one pass, so no text is shuffled. Templates are fixed texts, so their table is broadcast.

Null and empty texts have no words; very long ones are one array. Rows are told apart by their place in the stored
table, so repeated rows and doc_ids each get their own result. Equal frequencies are ordered by the token. Other columns
are left out, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

# Phrases whose words must stand consecutively, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notices and license bodies as their licenses word them, and the labels that near wordings get.
TEMPLATES = (
    ("Released under the MIT License.", "mit"),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation"
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
        " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "mit",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "isc",
    ),
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
        " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
        " See the License for the specific language governing permissions and limitations under the License.",
        "apache-2.0",
    ),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)"
        " any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "gpl",
    ),
    ("Licensed under CC BY-NC 4.0.", "cc-by"),
    ("licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("All rights reserved.", "reserved"),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice,"
        " this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other"
        " materials provided with the distribution.",
        "bsd",
    ),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mpl-2.0"),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,"
        " for any purpose, commercial or non-commercial, and by any means.",
        "unlicense",
    ),
)
# Words too common to tell a notice.
COMMON = ("a", "and", "any", "are", "as", "in", "is", "of", "or", "the", "this", "to", "with")
#: What stands between words of a text whose capitals are not lowered yet.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _template_words(text: str) -> list[str]:
    import re

    return re.findall(r"[a-z0-9]+", text.lower())


def _tokens(text: str) -> list[str]:
    return [w for w in _template_words(text) if w not in COMMON]


def _template_rows(least: float) -> list[tuple[int, str, list[str], int, int]]:
    """number, label, distinct tokens, how many of them are needed, block size."""
    return [(i, label, t, -(-round(len(t) * least * 1000) // 1000), 2 * max(4, len(_template_words(text)))) for i, (text, label) in enumerate(TEMPLATES) if (t := sorted(set(_tokens(text))))]


def templates(spark: SparkSession, least: float) -> DataFrame:
    return spark.createDataFrame(_template_rows(least), "template int, label string, tokens array<string>, need int, size int")


def _words(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), GAP)


def scan(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of docs(doc_id, text).

    score: 1 with a base label, else the largest containment in a template that is met, else 0.
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for p in PHRASES for w in p.split()} | {w for t, _ in TEMPLATES for w in _tokens(t)})
    words = F.transform(F.col("parts"), lambda w, i: F.struct((i - F.col("lead")).alias("pos"), F.lower(w).alias("w"), F.octet_length(w).alias("bytes")))
    ours = F.filter(words, lambda x: x["w"].isin(vocabulary) & (x["bytes"] == F.length(x["w"])))  # as many bytes as letters: no non-ASCII capital was lowered
    rows = docs.select("doc_id", _words(F.col("text")).alias("parts"))
    rows = rows.withColumn("lead", (F.col("parts")[0] == "").cast("int"))
    count = F.size("parts") - F.col("lead") - F.when((F.size("parts") > 1) & (F.element_at("parts", -1) == ""), 1).otherwise(0)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", count.cast("long").alias("n_words"), F.transform(ours, lambda x: F.struct(x["pos"].alias("pos"), x["w"].alias("w"))).alias("hits"))
    rows = stored(rows, "license-words")  # row numbers stand still from here on

    # how often template words occur in all documents gives their order
    often = rows.select(F.explode("hits.w").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    order = templates(spark, least).select("template", "label", "need", "size", F.explode("tokens").alias("w")).join(F.broadcast(often), "w", "left").groupBy("template", "label", "need", "size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w"))).alias("tokens"))
    ordered = order.select("template", "label", "need", "size", F.col("tokens.w").alias("tokens"))

    # blocks that hold a token of a template's prefix, by the first of them: prefix, length and positional filters
    member = ordered.select("template", "size", "need", F.size("tokens").alias("of"), F.posexplode("tokens").alias("rank", "w"))
    hit = rows.select("row", "n_words", F.explode("hits").alias("h")).select("row", "n_words", F.col("h.w").alias("w"), F.col("h.pos").alias("pos"))
    met = hit.join(F.broadcast(member.filter(F.col("rank") <= F.col("of") - F.col("need"))), "w").withColumn("start", F.explode(_blocks_of()))
    in_block = F.least(F.col("n_words") - F.col("start"), F.col("size"))
    met = met.filter(in_block >= F.col("need")).groupBy("row", "template", "start", "need", "of").agg(F.min("rank").alias("first")).filter(F.col("of") - F.col("first") >= F.col("need"))
    met = stored(met.drop("first"), "license-blocks")

    # each hit of these texts goes to the two blocks it is in, so work grows with the text, however long; a block's tokens are bits
    dealt = rows.select("row", "hits").join(met.select("row", "template").distinct(), "row").select("row", "template", F.explode("hits").alias("h"))
    dealt = dealt.select("row", "template", F.col("h.w").alias("w"), F.col("h.pos").alias("pos")).join(F.broadcast(member.select("template", "size", "rank", "w")), ["template", "w"])
    dealt = dealt.select("row", "template", "rank", F.explode(_blocks_of()).alias("start"))
    bit = lambda k: F.when(F.floor(F.col("rank") / 62) == k, F.expr("shiftleft(1L, rank % 62)")).otherwise(F.lit(0).cast("long"))
    bits = [f"bits{k}" for k in range(-(-max(len(t) for _, _, t, _, _ in _template_rows(least)) // 62))]
    own = dealt.groupBy("row", "template", "start").agg(*[F.bit_or(bit(k)).alias(b) for k, b in enumerate(bits)])
    shared = sum((F.bit_count(b) for b in bits[1:]), F.bit_count(bits[0]))
    found = met.join(own, ["row", "template", "start"]).select("row", "template", "need", shared.alias("shared"), (shared / F.col("of")).alias("share")).filter(F.col("shared") >= F.col("need"))
    found = found.join(F.broadcast(ordered.select("template", "label")), "template").groupBy("row").agg(F.collect_set("label").alias("near"), F.max("share").alias("share"))

    # words of a phrase that stand together in the text stand together among the hits
    places = [_places(phrase.split(), label) for phrase, label in PHRASES.items()]
    base = rows.select("row", "doc_id", "n_words", F.concat(*places).alias("base"))
    out = base.join(found, "row", "left")
    labels = F.array_distinct(F.col("base.label"))
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.pos").cast("long").alias("first_word"), F.array_max("base.pos").cast("long").alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(labels, F.coalesce("near", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def _blocks_of() -> Column:
    """Starts of the blocks of `size` words at every half of it that hold the word at `pos`."""
    half = F.col("size") / 2  # sizes are even
    at = F.floor(F.col("pos") / half)
    return F.filter(F.array((at * half).cast("int"), ((at - 1) * half).cast("int")), lambda s: s >= 0)


def _places(phrase: list[str], label: str) -> Column:
    """Where a phrase's words stand consecutively: its first word's place, and the label."""
    hit = lambda i: F.get(F.col("hits"), i)

    def stands(i: Column) -> Column:
        out = hit(i)["w"] == phrase[0]
        for j, w in enumerate(phrase[1:], 1):
            out = out & (hit(i + j)["w"] == w) & (hit(i + j)["pos"] == hit(i)["pos"] + j)
        return out

    first = F.size("hits") - len(phrase)
    indices = F.when(first >= 0, F.sequence(F.lit(0), F.greatest(first, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(indices, stands), lambda i: F.struct(hit(i)["pos"].alias("pos"), F.lit(label).alias("label")))


def _sql(least: float = 0.8) -> str:
    """The same by brute force: every block of every document against every template."""
    values = ", ".join(f"({i}, '{label}', [{', '.join(repr(w) for w in t)}], {need}, {size})" for i, label, t, need, size in _template_rows(least))
    phrases = ", ".join(f"('{label}', [{', '.join(repr(w) for w in p.split())}])" for p, label in PHRASES.items())
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p(label, ph) AS (VALUES {phrases}),
b AS (SELECT doc_id, label, i - 1 AS pos FROM w, p, unnest(generate_series(1, len(ws) - len(ph) + 1)) AS t(i) WHERE len(ws) >= len(ph) AND ws[i] = ph[1] AND ws[i:i + len(ph) - 1] = ph),
bb AS (SELECT doc_id, count(*) AS n, min(pos) AS a, max(pos) AS z, list(DISTINCT label) AS ls FROM b GROUP BY doc_id),
t(id, label, ts, need, size) AS (VALUES {values}),
z AS (SELECT DISTINCT size FROM t),
blk AS (SELECT doc_id, size, ws[s + 1:s + size] AS bw FROM w, z, unnest(generate_series(0, greatest(len(ws) - 1, 0), size // 2)) AS x(s) WHERE len(ws) > 0),
m AS (SELECT doc_id, label, len(list_intersect(list_distinct(bw), ts)) AS k, len(ts) AS n, need FROM blk JOIN t ON blk.size = t.size),
mm AS (SELECT doc_id, list(DISTINCT label) AS ls, max(k / n) AS share FROM m WHERE k >= need GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(bb.n, 0) AS BIGINT) AS n_base, CAST(bb.a AS BIGINT) AS first_word, CAST(bb.z AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(bb.ls), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bb.ls, []), coalesce(mm.ls, [])))), ','), '') AS labels,
  CAST(CASE WHEN bb.n > 0 THEN 1.0 ELSE coalesce(mm.share, 0.0) END AS DOUBLE) AS score
FROM w LEFT JOIN bb USING (doc_id) LEFT JOIN mm USING (doc_id)
"""


SQL = _sql()
