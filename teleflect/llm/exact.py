"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after deleting ASCII white space; null counts as empty. Of equal texts the row with the
most code points in the original text stays, then the smallest doc_id (null doc_id last). Rows that repeat a doc_id
and a text are one document: they share one fate. An empty table gives an empty result; other columns are carried
untouched, but a column of a result's name is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, broadcast_if_small, stored


def normalised(text) -> F.Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def text_hash() -> F.Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def exact_groups(docs: DataFrame, prefix_chars: int = 64, hash_all: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row. Unless hash_all, the full hash is null where length or prefix already tell a text apart.

    hash_all is for who wants every hash anyway: then it is taken in the pass that takes length and prefix, and the
    refinement only spares the grouping of texts that are told apart before.
    """
    return _groups(docs, prefix_chars, hash_all)


def _groups(docs: DataFrame, prefix_chars: int = 64, hash_all: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """The rows of exact_groups with the columns `carry` of docs.

    One pass over the texts writes a narrow table (lengths and a prefix hash; the full hash if all are wanted). Groups
    are counted on it with partial sums, so a text that fills a third of the table is no heavier than another. Without
    hash_all a second pass hashes the texts whose length and prefix others share.
    """
    norm = normalised(F.col("text"))
    full = F.sha2("norm", 256)
    rows = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("chars"), norm.alias("norm"), *carry)
    rows = rows.select("doc_id", "chars", F.length("norm").alias("n"), F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("p"), "norm", *carry)
    narrow = stored(rows.withColumn("h", full).drop("norm") if hash_all else rows.select("n", "p"), "lengths")
    by_length = stored(narrow.groupBy("n").count().filter("count > 1").select("n"), "same-length")
    left = narrow.join(broadcast_if_small(by_length), "n", "left_semi").groupBy("n", "p").count().filter("count > 1")
    left = stored(left.select("n", "p", F.lit(True).alias("left")), "same-prefix")
    small = broadcast_if_small(left)
    if hash_all:
        rows = narrow.join(small, ["n", "p"], "left")
    elif small is not left:  # the surviving groups go to the texts
        rows = rows.join(small, ["n", "p"], "left").withColumn("h", F.when(F.col("left"), full)).drop("norm")
    else:  # too many to send: hashes go to the groups instead, as texts would weigh more in a shuffle; what did not survive gets null all the same
        rows = rows.withColumn("h", full).drop("norm").join(left, ["n", "p"], "left").withColumn("h", F.when(F.col("left"), F.col("h")))
    rows = stored(rows.select("doc_id", "chars", "h", *carry, F.coalesce("left", F.lit(False)).alias("left")), "hashes")

    best = F.struct("chars", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("first"))
    groups = rows.filter("left").groupBy("h").agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    groups = stored(groups.select("h", (-F.col("best.first")).alias("keep"), "group_size"), "groups")
    out = rows.join(broadcast_if_small(groups), "h", "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("h").alias("text_sha256"), *carry)


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows whose text another row already has; every column stays. A row goes by its doc_id and text, so others of that doc_id, or without one, stay.

    Rows that repeat a doc_id and its text all stay or all go.
    """
    gone = stored(_groups(docs.withColumn("__text", text_hash()), carry=("__text",), **options).filter("not kept").select(F.col("doc_id").alias("__gone"), "__text").distinct(), "copies")
    return docs.join(broadcast_if_small(gone), F.col("doc_id").eqNullSafe(F.col("__gone")) & (text_hash() == F.col("__text")), "left_anti")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS n, max(length(text)) AS chars FROM d GROUP BY norm),
k AS (SELECT d.norm, g.n, min(d.doc_id) AS keep_id FROM d JOIN g ON d.norm = g.norm AND length(d.text) = g.chars GROUP BY d.norm, g.n)
SELECT d.doc_id, k.keep_id, CAST(k.n AS BIGINT) AS group_size, d.doc_id = k.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN k ON d.norm = k.norm
"""
