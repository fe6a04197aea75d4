"""Streams that carry what a dimension says about their rows, dealt out by tenant.

The dimension is read anew for every batch (a registry changes while a stream runs), joined to the batch and written to
folders by batch and tenant. A batch that runs again replaces its own folder; a reader of one tenant opens that
tenant's folders alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "unknown"


def small_side(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """df, hinted for a broadcast only if a count shows few rows; its rows are narrow."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def enriched(batch: DataFrame, dimension: DataFrame, key: str, tenant: str) -> DataFrame:
    """batch with the columns of its dimension row; a key that the dimension does not have keeps its row, under tenant `unknown`."""
    rows = batch.join(small_side(dimension.dropDuplicates([key])), key, "left")
    return rows.withColumn(tenant, F.coalesce(F.col(tenant).cast("string"), F.lit(UNKNOWN)))


def follow(stream: DataFrame, dimension: Callable[[SparkSession], DataFrame], key: str, tenant: str, out: str, checkpoint: str) -> None:
    """Enrich a stream until its input is read. dimension(spark) is called for each batch."""

    def write(batch: DataFrame, n: int) -> None:
        enriched(batch, dimension(batch.sparkSession), key, tenant).write.mode("overwrite").partitionBy(tenant).parquet(f"{out}/batch={n}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def feed_of(spark: SparkSession, out: str, tenant: str, value: str | None, after: int = -1) -> DataFrame:
    """What one tenant's followers get, from batches later than `after`; no tenant, no rows."""
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*").filter(F.col("batch") > after)
    return rows.filter(F.col(tenant).cast("string") == F.lit(value)) if value is not None else rows.limit(0)
