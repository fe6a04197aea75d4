"""Ordered folds whose state feeds back: rows of a key in order, with the state alone held between batches.

Values come to a step as they are stored: whole numbers as ints of any size, nulls as None in any column, times as whole
microseconds. So an id never passes through a float, and a null key is a key like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "timestamp": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}


def columns_of(schema: str) -> dict[str, str]:
    return dict(x.strip().split() for x in schema.split(","))


def in_micros(rows: DataFrame) -> DataFrame:
    """rows with every time as microseconds since 1970."""
    return rows.select(*[F.unix_micros(F.col(c).cast("timestamp")).alias(c) if t.startswith("timestamp") else F.col(c) for c, t in rows.dtypes])


def plain_schema(schema: str) -> str:
    """schema with times as microseconds."""
    return ", ".join(f"{c} {'long' if t == 'timestamp' else t}" for c, t in columns_of(schema).items())


def with_times(rows: DataFrame, schema: str) -> DataFrame:
    """rows of plain_schema(schema) with their times again."""
    return rows.select(*[F.timestamp_micros(c).alias(c) if t == "timestamp" else F.col(c) for c, t in columns_of(schema).items()])


def _values(column: pa.Array) -> list:
    if not (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
        return column.to_pylist()
    if not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    values = column.fill_null(0).to_numpy(zero_copy_only=False).tolist()
    for i in column.is_null().to_numpy(zero_copy_only=False).nonzero()[0].tolist():
        values[i] = None
    return values


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[tuple], object], step: Callable[[object, tuple], list[tuple]], schema: str) -> DataFrame:
    """step(state, row) for each row of `rows` in the given order within its keys, start(row) makes a key's state -> what the steps return, as `schema`.

    Spark deals rows by key and sorts them, spilling where it must; a task streams them, so a key of any size takes a
    batch and a state of memory. Columns of rows come to step in their order.
    """
    at = [rows.columns.index(k) for k in keys]
    out = pa.schema([(c, _ARROW[t]) for c, t in columns_of(schema).items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            made: list[tuple] = []
            for row in zip(*map(_values, b.columns), strict=True):
                own = tuple(row[i] for i in at)
                if own != key:
                    key, state = own, start(row)
                made += step(state, row)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)], schema=out)

    sorted_ = in_micros(rows.repartition(*keys)).sortWithinPartitions(*keys, *order)
    return with_times(sorted_.mapInArrow(run, plain_schema(schema)), schema)
