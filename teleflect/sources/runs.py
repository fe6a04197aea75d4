"""Batch runs that happen once and are seen whole: a log of committed runs whose newest entry is the pointer.

A run writes its tables into folders of its own and then one small file into the log, by a rename that fails where
the name is taken. Readers follow the newest entry of the log, so they meet a whole run or the one before, and two
jobs cannot commit the same place. The log is also the run table: inputs whose hash stands there need no run.
The store under a log must have an atomic rename (HDFS, local and most distributed file systems).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "place long, run_id string, run_hash string, rows_read long, units long, first_ts string, last_ts string, tables string"


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """A file of this text at path, whole or not at all; False if there is one already."""
    jvm, where, fs = _store(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}-{uuid.uuid4().hex}")
    with_out = fs.create(part)
    with_out.write(bytearray(text.encode()))
    with_out.close()
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(part, where, options)
        return True
    except Exception as e:
        fs.delete(part, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise


def log_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a log, in order; dot files are entries that are not there yet."""
    jvm, where, fs = _store(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if not s.getPath().getName().startswith(".")) if fs.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file."""
    jvm, where, fs = _store(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def name_of(place: int) -> str:
    return f"{place:012d}.json"


def run_table(spark: SparkSession, base: str) -> DataFrame:
    """ENTRY of every committed run; empty before the first."""
    if not log_names(spark, f"{base}/_runs"):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).json(f"{base}/_runs")


def newest_run(spark: SparkSession, base: str) -> dict | None:
    names = log_names(spark, f"{base}/_runs")
    return json.loads(read_text(spark, f"{base}/_runs/{names[-1]}")) if names else None


def pending(inputs: DataFrame, base: str) -> DataFrame:
    """inputs(run_hash, ...) that no committed run has read."""
    return inputs.join(run_table(inputs.sparkSession, base).select("run_hash").distinct(), "run_hash", "left_anti")


def commit_run(results: dict[str, DataFrame], base: str, run_id: str, run_hash: str, read: DataFrame | None = None, unit: str = "vin", ts: str = "ts") -> bool:
    """Write all tables of a run and commit it; False, and nothing written, if a committed run has this hash.

    read: what the run read, whose rows, units and span stand in the log. A run that fails on the way leaves folders
    that nobody reads; one that another job overtakes raises, and may be tried again.
    """
    spark = next(iter(results.values())).sparkSession
    names = log_names(spark, f"{base}/_runs")
    if run_table(spark, base).filter(F.col("run_hash") == run_hash).limit(1).count():
        return False
    own = f"{run_id}-{uuid.uuid4().hex[:8]}"
    for name, df in results.items():
        df.write.parquet(f"{base}/{name}/run={own}")
    entry = {"place": len(names), "run_id": run_id, "run_hash": run_hash, "tables": own}
    if read is not None:
        n = read.agg(F.count(F.lit(1)).alias("rows_read"), F.countDistinct(unit).alias("units"), F.min(ts).cast("string").alias("first_ts"), F.max(ts).cast("string").alias("last_ts")).first()
        entry |= n.asDict()
    if not put_once(spark, f"{base}/_runs/{name_of(len(names))}", json.dumps(entry)):
        raise RuntimeError(f"run {run_id} was overtaken by another one")
    return True


def read_run(spark: SparkSession, base: str, name: str, run_id: str | None = None) -> DataFrame:
    """A table of the newest run, or of the newest with this run_id."""
    entry = newest_run(spark, base) if run_id is None else run_table(spark, base).filter(F.col("run_id") == run_id).orderBy(F.desc("place")).first()
    if entry is None:
        raise LookupError(f"no committed run in {base}")
    return spark.read.parquet(f"{base}/{name}/run={entry['tables']}")


def input_hash(spark: SparkSession, version: str, manifest: str) -> DataFrame:
    """One row, `run_hash`, of a code version and a manifest file."""
    return spark.read.option("wholetext", True).text(manifest).select(F.sha2(F.concat(F.lit(version), "value"), 256).alias("run_hash"))


def row_hash(rows: DataFrame, columns: list[str], version: str) -> str:
    """A hash of a table's rows in any order, repeats counted, and a code version: equal inputs need no second run."""
    digest: Column = F.xxhash64(*columns)
    low, high = digest.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(digest, 32)
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(low).alias("a"), F.sum(high).alias("b"), F.bit_xor(F.xxhash64(digest, F.lit(1))).alias("c")).first()
    import hashlib

    return hashlib.sha256(f"{version}|{n['n']}|{n['a']}|{n['b']}|{n['c']}".encode()).hexdigest()
