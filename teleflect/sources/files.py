"""Lake, dimension and export files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_history(spark: SparkSession, base: str) -> DataFrame:
    """Hive-partitioned Parquet (dt=...): filters on dt prune folders."""
    return spark.read.parquet(base)


def write_history(readings: DataFrame, base: str, ts: str = "event_ts") -> None:
    """One folder a day, zstd, sorted by unit and seq within files."""
    rows = readings.withColumn("dt", F.to_date(ts))
    rows.repartition("dt", F.pmod(F.hash("vin"), F.lit(16))).sortWithinPartitions("dt", "vin", "seq").write.mode("overwrite").partitionBy("dt").option("compression", "zstd").parquet(base)


def read_dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; an empty field is null."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)


def export_features(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def read_features(spark: SparkSession, path: str, booleans: tuple[str, ...] = ()) -> DataFrame:
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return df.withColumns({c: F.lower(F.col(c).cast("string")).isin("true", "t", "1") for c in booleans}) if booleans else df
