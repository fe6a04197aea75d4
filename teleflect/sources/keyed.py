"""A table of one row for each key that a stream keeps up to date, on Parquet folders by bucket of the key.

Each batch of the stream rewrites only the buckets that its keys fall into, into a folder of its own, and is then
committed by one small file that names the folder of every bucket. A batch is known by its number, so one that runs
again after a failure changes nothing, and readers meet the table as it was after some whole batch. Beside the table
stands its outbox: the rows that each batch changed, with their versions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runs import log_names, name_of, put_once, read_text


class KeyedTable:
    """keys: columns that name a row; combine(rows) -> one row a key, from stored rows and new ones together; buckets: folders a version has."""

    def __init__(self, base: str, keys: list[str], schema: str, combine: Callable[[DataFrame], DataFrame], buckets: int = 16):
        self.base, self.keys, self.schema, self.combine, self.buckets = base, keys, schema, combine, buckets

    def _log(self) -> str:
        return f"{self.base}/_batches"

    def state(self, spark: SparkSession) -> tuple[int, dict[str, str]]:
        """Number of the newest batch (-1 for none), and the folder of each bucket that has rows."""
        names = log_names(spark, self._log())
        if not names:
            return -1, {}
        return int(names[-1].split(".")[0]), json.loads(read_text(spark, f"{self._log()}/{names[-1]}"))

    def _read(self, spark: SparkSession, folders: dict[str, str], some: list[str] | None = None) -> DataFrame:
        paths = [f"{self.base}/data/{f}/__bucket={b}" for b, f in folders.items() if some is None or b in some]
        schema = f"{self.schema}, version long"
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, self.state(spark)[1])

    def changes(self, spark: SparkSession, after: int = -1) -> DataFrame:
        """Rows changed by batches later than `after`, with the batch's number: a feed that can be followed and read again."""
        names = [int(n.split(".")[0]) for n in log_names(spark, self._log())]
        done = spark.createDataFrame([(n,) for n in names if n > after], "batch long")
        schema = f"{self.schema}, version long, batch long"
        if not [n for n in names if n > after]:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", f"{self.base}/outbox").parquet(*[f"{self.base}/outbox/batch={n}" for n in names if n > after]).join(F.broadcast(done), "batch", "left_semi")

    def merge(self, batch: DataFrame, number: int) -> bool:
        """Apply a batch of rows (schema) once; False if it has been applied. For foreachBatch."""
        spark = batch.sparkSession
        newest, folders = self.state(spark)
        if number <= newest:
            return False
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        batch = batch.persist()  # read for its buckets, then for its rows
        try:
            touched = sorted(str(r[0]) for r in batch.select(bucket).distinct().collect())  # at most `buckets` numbers
            old = self._read(spark, folders, touched)
            rows = self.combine(old.drop("version").unionByName(batch.select(*old.drop("version").columns)))
            mine = batch.select(*self.keys).distinct().withColumn("__new", F.lit(True))
            versions = old.select(*self.keys, F.col("version").alias("__old"))
            same = lambda other: [F.col(f"a.{k}").eqNullSafe(F.col(f"{other}.{k}")) for k in self.keys]
            both = rows.alias("a").join(versions.alias("v"), same("v"), "left").join(mine.alias("m"), same("m"), "left")
            new = F.col("m.__new").isNotNull()
            out = both.select("a.*", (F.coalesce("v.__old", F.lit(0)) + new.cast("long")).alias("version"), new.alias("__changed"))
            folder = f"{number:012d}-{uuid.uuid4().hex[:8]}"
            out.withColumn("__bucket", bucket).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.base}/data/{folder}")
            if touched:
                written = spark.read.parquet(f"{self.base}/data/{folder}").filter("__changed").drop("__changed", "__bucket")
                written.write.mode("overwrite").parquet(f"{self.base}/outbox/batch={number}")
            else:
                spark.createDataFrame([], f"{self.schema}, version long").write.mode("overwrite").parquet(f"{self.base}/outbox/batch={number}")
        finally:
            batch.unpersist()
        return put_once(spark, f"{self._log()}/{name_of(number)}", json.dumps(folders | dict.fromkeys(touched, folder)))

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """Merge a stream until its input is read."""
        stream.writeStream.foreachBatch(lambda b, n: self.merge(b, n) and None).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()
