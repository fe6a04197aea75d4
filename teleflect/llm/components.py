"""Connected components of a link table, by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours link to its smallest neighbour (or itself)."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """links has u > v: every node and its smaller neighbours link to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links(u long, v long), u <> v -> node, root: each linked node and the smallest node that it reaches.

    Each round is written to the shared folder, so lineage stays short; rounds grow with the logarithm of the longest
    chain. The driver sees two numbers a round.
    """
    links = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    # wrapping is meant: the sum of hashes is an order-free fingerprint of the table
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    now = mark(links)
    for r in range(most_rounds):
        links = stored(_small_star(_large_star(links)), f"stars-{r}")
        before, now = now, mark(links)
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("components did not settle")
