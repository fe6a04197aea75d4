"""What the corpus operators share: tables, the shared scratch folder, size-checked broadcasts, files."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space [\x20\x09-\x0D] that separates words in the contracts.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which the driver and all executors see; a local one only where driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="teleflect-")
        spark.sparkContext.setCheckpointDir(base)
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Most bytes of an Arrow batch in small_batches.
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of at most BATCH_BYTES for the Python steps of jobs that run inside; a limit that the session sets itself stays.

    A batch stands in direct memory, beside the heap, and again in the worker, for each task that runs. Spark's own
    limits are 10,000 rows and 64 MB, and whole texts reach them.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key)


def _width(column: str, kind: str) -> F.Column:
    c = F.col(f"`{column}`")
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(c), F.lit(0))
    return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) if kind.startswith(("array", "map", "struct")) else F.lit(8)


def broadcast_if_small(df: DataFrame, most_rows: int = 200_000, most_bytes: int = 64 << 20) -> DataFrame:
    """df, hinted for a broadcast only if a count shows that it has few rows and bytes; a shuffle join otherwise. df should be stored.

    Only how the join runs depends on the size, never its rows.
    """
    width = sum((_width(c, t) for c, t in df.dtypes), F.lit(0))
    rows, size = df.limit(most_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if rows <= most_rows and size <= most_bytes else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store that holds uri (file, hdfs, s3, gs, ...) and the path in it; for use inside tasks."""
    return pafs.FileSystem.from_uri(uri)


def slices(batches: Iterator[pa.RecordBatch], most: int = 256) -> Iterator[pa.RecordBatch]:
    """batches in parts of few rows, so that a worker holds few texts as Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, most):
            yield b.slice(at, most)


@contextmanager
def publishing(uri: str):
    """A stream into a file of another name, moved into place at the end: a repeated task replaces it with the same bytes."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        yield out
    fs.move(part, path)


def whole_runs(batches: Iterator[pd.DataFrame], keys: list[str], most: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Rows sorted by keys, regrouped so that no run of equal keys is torn: (rows, run of each row, whether that run is hot).

    A run of over `most` rows is hot; it comes in parts as it arrives, so that memory stays bounded.
    """
    held, hot_key = None, None
    for b in itertools.chain(batches, [None]):
        parts = [x for x in (held, b) if x is not None and len(x)]
        if not parts:
            continue
        rows = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
        values = [rows[k].to_numpy() for k in keys]
        new = np.ones(len(rows), bool)
        new[1:] = np.any([v[1:] != v[:-1] for v in values], axis=0)
        starts = np.flatnonzero(new)
        goes_on = hot_key is not None and tuple(v[0] for v in values) == hot_key
        held, hot_key = None, None
        if b is not None:  # the last run may go on in the next batch
            tail = int(starts[-1])
            if len(rows) - tail > most or (goes_on and tail == 0):
                hot_key = tuple(v[-1] for v in values)
            else:
                held, rows, starts = rows.iloc[tail:], rows.iloc[:tail], starts[:-1]
        if not len(rows):
            continue
        sizes = np.diff(np.append(starts, len(rows)))
        hot = sizes > most
        hot[0] |= goes_on
        hot[-1] |= hot_key is not None
        run = np.repeat(np.arange(len(starts)), sizes)
        yield rows, run, hot[run]
