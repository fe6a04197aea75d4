"""Running totals and ranks of a few keys over many rows, where one window would put a key into one task.

Rows are dealt in ranges of (keys, order), so a key of any size lies over as many tasks as it needs, in order. Each
part runs its totals by itself; what stood before it is the sum over the parts before, a table of one row for each key
and part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def running_totals(rows: DataFrame, keys: list[str], order: list[Column], totals: dict[str, Column], parts: int | None = None) -> DataFrame:
    """rows with, for each name, the sum of its column over the rows of the keys up to this one. order tells any two rows of a key apart; nulls in keys are a key."""
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = {f"__v_{n}": c for n, c in totals.items()}
    placed = rows.withColumns(values).repartitionByRange(parts, *[F.col(k).asc() for k in keys], *order).withColumn("__part", F.spark_partition_id())
    placed = stored(placed, "ranges")  # part numbers stand still from here on
    own = placed.groupBy(*keys, "__part").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in totals])
    over = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = own.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__part").alias("__p"), *[F.coalesce(F.sum(f"__t_{n}").over(over), F.lit(0)).alias(f"__b_{n}") for n in totals])
    inside = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = placed.withColumns({f"__r_{n}": F.sum(f"__v_{n}").over(inside) for n in totals})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], F.col("__part") == F.col("__p"))
    return run.join(before, same).select(*rows.columns, *[(F.col(f"__r_{n}") + F.col(f"__b_{n}")).alias(n) for n in totals])


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """rows with their number within the keys, from 1 on."""
    return running_totals(rows, keys, order, {name: F.lit(1).cast("long")}, parts)
