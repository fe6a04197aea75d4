"""Phrases, costs, merged records, decisions and erasure: what people read from the tables, and what they change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tenths(x: Column) -> Column:
    """A number that is not negative with one decimal; a half goes up, however its binary form falls short of it."""
    return (F.floor(x * 10 + 0.5 + 1e-7) / 10).cast("decimal(12,1)").cast("string")


def level_clues(level: Column, normal: Column, z: Column, slope: Column, hours_left: Column, unit: str) -> Column:
    """Phrases in order, only those that hold: how far from normal, how fast, how long to the limit."""
    dev = level - normal
    return F.array_compact(
        F.array(
            F.when(F.abs(z) >= 1.5, F.concat(tenths(F.abs(dev)), F.lit(f" {unit} "), F.when(dev > 0, "above").otherwise("below"), F.lit(" its own normal"))),
            F.when(F.abs(slope) >= 0.5, F.concat(F.when(slope > 0, "rising ").otherwise("falling "), tenths(F.abs(slope)), F.lit(f" {unit} an hour"))),
            F.when(hours_left.isNotNull(), F.concat(F.lit("limit in "), F.ceil(hours_left).cast("string"), F.lit(" h"))),
        )
    )


def waiting_cost(hours_left: Column, hazard: Column, days: Column, full: float) -> Column:
    """Chance of a breakdown before its bay, times what a breakdown costs: from the time to the limit where it is known, else from a daily hazard."""
    chance = F.when(hours_left.isNotNull(), F.least(F.lit(1.0), days * 24 / F.greatest(hours_left, F.lit(1.0)))).otherwise(1 - F.pow(1 - hazard, days))
    return F.when(days <= 0, 0.0).otherwise(F.round(chance * full, 0))


def merge_actions(actions: DataFrame, key: str) -> DataFrame:
    """actions(key, seq, ts, action, severity 1..3, runaway, value): the record that they leave. Severity and runaway only rise, the first critical time stays, values are the newest."""
    newest = lambda c: F.max_by(c, F.struct("ts", "seq"))
    return actions.groupBy(key).agg(
        newest("action").alias("status"), F.max("severity").alias("severity"), F.bool_or("runaway").alias("runaway"),
        F.min(F.when(F.col("runaway"), F.col("ts"))).alias("critical_ts"), newest("value").alias("value"), F.count(F.lit(1)).alias("actions"),
    )


RECORD = "status string, severity long, runaway boolean, critical_ts timestamp, value double, actions long, ts timestamp, seq long"


def as_records(actions: DataFrame, key: str) -> DataFrame:
    """actions as merge_actions takes them, each as the RECORD it leaves by itself."""
    at = F.col("ts").cast("timestamp")
    return actions.select(
        key, F.col("action").alias("status"), F.col("severity").cast("long").alias("severity"), "runaway", F.when(F.col("runaway"), at).alias("critical_ts"), F.col("value").cast("double").alias("value"), F.lit(1).cast("long").alias("actions"), at.alias("ts"), F.col("seq").cast("long").alias("seq"),
    )


def merge_records(records: DataFrame, key: str) -> DataFrame:
    """records(key, RECORD): one for each key. Merging merged ones with new ones gives what merging all at once gives, in any order and grouping."""
    newest = lambda c: F.max_by(c, F.struct("ts", "seq")).alias(c)
    return records.groupBy(key).agg(newest("status"), F.max("severity").alias("severity"), F.bool_or("runaway").alias("runaway"), F.min("critical_ts").alias("critical_ts"), newest("value"), F.sum("actions").alias("actions"), F.max("ts").alias("ts"), newest("seq"))


def decide(state: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """decisions(key, version, status) against state(key, version, status): applied if the version is current and the state open, else a conflict. The first decision on a version wins."""
    first = F.row_number().over(Window.partitionBy(key, "version").orderBy("decision_id"))
    d = decisions.withColumn("turn", first).withColumnRenamed("version", "wanted").withColumnRenamed("status", "new_status")
    ok = (F.col("version") == F.col("wanted")) & (F.col("status") == "OPEN") & (F.col("turn") == 1)
    result = F.when(F.col("version").isNull(), "UNKNOWN").when(ok, "APPLIED").otherwise("CONFLICT")
    return d.join(state, key, "left").select("decision_id", key, "new_status", result.alias("result"))


def erase(people: DataFrame, assignments: DataFrame, erased: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """People with erased names replaced by erased-<id>, and assignments without theirs. Doing it again changes nothing."""
    marked = people.join(erased.select(key).distinct().withColumn("__gone", F.lit(True)), key, "left")
    masked = marked.withColumn(name, F.when(F.col("__gone"), F.concat(F.lit("erased-"), F.col(key).cast("string"))).otherwise(F.col(name))).drop("__gone")
    return masked, assignments.join(erased.select(key), key, "left_anti")


def threshold_at(scored: DataFrame, volume: int) -> DataFrame:
    """The score that as many rows reach as `volume` asks for: the volume-th largest."""
    return scored.orderBy(F.desc("score")).limit(volume).agg(F.min("score").alias("threshold"))


def hash_sample(rows: DataFrame, key: list[str], n: int, seed: int) -> DataFrame:
    """n rows in an order that depends on keys and seed alone."""
    return rows.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)


def prioritised(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """For each key the row of the first table that has one."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("source", F.lit(i))
        out = p if out is None else out.unionByName(p)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("source"))
    return out.withColumn("__k", rank).filter("__k = 1").drop("__k")
