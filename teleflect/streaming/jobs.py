"""Streaming forms: tumbling roll-ups, light and exact de-duplication. Each runs until its input is read (availableNow) and can go on from its checkpoint."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import columns_of, in_micros, ordered_fold, plain_schema, with_times
from ..operators.intake import ACCEPTED, Clock, Intake, clock_step, intake_input, intake_step, judge

REPLAY = "vin long, seq long, ts timestamp, outcome string"


def file_stream(spark: SparkSession, folder: str, pattern: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def run_updates(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Changed rows of each batch, with its number: the newest row of a key is its current one. A batch that runs again replaces its own files."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()


def hourly(readings: DataFrame, late: str = "1 hour") -> DataFrame:
    """Tumbling hours per unit. Readings late within the watermark still count."""
    w = F.window("ts", "1 hour")
    return readings.withWatermark("ts", late).groupBy("vin", w).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"), F.max("y").alias("most")).select("vin", F.col("window.start").alias("hour"), "n", "total", "most")


def deduped(readings: DataFrame, late: str = "2 hours") -> DataFrame:
    return readings.withWatermark("ts", late).dropDuplicatesWithinWatermark(["vin", "seq"])


def replay_outcomes(messages: DataFrame) -> DataFrame:
    """messages(vin, arrival, seq, ts) -> REPLAY in batch: each unit's messages in order of arrival."""
    return ordered_fold(replay_input(messages), ["vin"], ["arrival"], lambda r: [None], replay_step, REPLAY)


def replay_input(messages: DataFrame) -> DataFrame:
    return messages.select("vin", "arrival", "seq", F.col("ts").cast("timestamp").alias("ts"))


def replay_step(state: list, row: tuple) -> list[tuple]:
    vin, _, seq, us = row
    outcome, state[0] = judge(state[0], seq, us)
    return [(vin, seq, us, outcome)]


class FoldProcessor(StatefulProcessor):
    """An ordered fold on a stream: the same start and step as in batch, state kept per key between batches of the stream."""

    def __init__(self, order: list[str], start, step, names: list[str]):
        self.order, self.start, self.step, self.row = order, start, step, Row(*names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", "state binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # the rows of one key in one batch of the stream, bounded by maxFilesPerTrigger; nulls first, as Spark sorts them
        own = sorted(rows, key=lambda r: [(r[c] is not None, r[c]) if r[c] is not None else (False,) for c in self.order])
        state = pickle.loads(self.state.get()[0]) if self.state.exists() else self.start(tuple(own[0]))
        for r in own:
            for made in self.step(state, tuple(r)):
                yield self.row(*made)
        self.state.update((pickle.dumps(state),))

    def close(self) -> None: ...


def fold_stream(rows: DataFrame, keys: list[str], order: list[str], start, step, schema: str) -> DataFrame:
    """ordered_fold on a stream. A row that comes in a later batch than its order says is taken when it comes; steps tell it by its seq."""
    processor = FoldProcessor(order, start, step, list(columns_of(schema)))
    return with_times(in_micros(rows).groupBy(*keys).transformWithState(processor, plain_schema(schema), "append", "none"), schema)


def replay_stream(messages: DataFrame) -> DataFrame:
    return fold_stream(replay_input(messages), ["vin"], ["arrival"], lambda r: [None], replay_step, REPLAY)


def intake_stream(messages: DataFrame) -> DataFrame:
    """intake.intake on a stream: replay window, jumps and resets in one state for each unit."""
    return fold_stream(intake_input(messages), ["vin"], ["arrival"], lambda r: Intake(), intake_step, ACCEPTED)


def clock_stream(messages: DataFrame, source: str = "source", most_ms: int = 120_000) -> DataFrame:
    """messages(source, arrival, event_ms, ingest_ms) -> source, arrival, ahead: a ring of offsets in the state of each source."""
    rows = messages.select(F.col(source).cast("string").alias("source"), "arrival", F.col("event_ms").cast("long"), F.col("ingest_ms").cast("long"))
    return fold_stream(rows, ["source"], ["arrival"], lambda r: Clock(), clock_step(most_ms), "source string, arrival long, ahead boolean")


def detect_with_peers_stream(rows: DataFrame, metrics: dict, p) -> DataFrame:
    """peers.detect_with_peers on a stream: three states one after the other, in one query."""
    from ..operators import peers

    out = peers.peers_input(rows)
    for (keys, order, schema), (start, step) in zip(peers.STAGES, peers.steps(metrics, p), strict=True):
        out = fold_stream(out, keys, order, start, step, schema)
    return out


def use_rocksdb(spark: SparkSession) -> SparkSession:
    """States of Python steps live in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark
