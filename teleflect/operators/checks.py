"""Checks on rows as they come: jumps against the last accepted value, clocks that run ahead, references, counters, rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import vin_problem
from .folds import columns_of
from .intake import intake
from .ranks import ranked

JUMPS = "vin long, seq long, odo_km double, soc_pct double, flags string"


def jump_checks(readings: DataFrame, arrival: str = "seq") -> DataFrame:
    """readings(vin, seq, odo_km, soc_pct, driving, engine) in order of arrival -> JUMPS: what intake says, for readings whose repeats are gone. engine: whether one runs, which may charge the battery; ts, where there is one, tells a counter that starts anew from a late reading."""
    ts = F.col("ts") if "ts" in readings.columns else F.timestamp_micros(F.lit(0).cast("long"))
    rows = readings.select("vin", F.col(arrival).alias("arrival"), "seq", ts.alias("ts"), "odo_km", "soc_pct", "driving", "engine")
    return intake(rows).select(*columns_of(JUMPS))


def clock_ahead(messages: DataFrame, source: list[str], arrival: str, event_ms: str, ingest_ms: str, most_ms: int = 120_000, size: int = 512, every: int = 64, speed: float = 1.0) -> DataFrame:
    """messages with `ahead`: event time over most_ms beyond what ingest time implies; null until `every` messages of its source have come.

    The offset between the clocks is the middle one of the last `size` before, taken anew after every `every` messages:
    a table of one row for that many messages, whose windows hold size / every of them. Messages are numbered in ranges
    of arrival, and the table is cut into stretches, so a source may be as busy as it likes.
    """
    off = F.col(event_ms) - F.lit(speed) * F.col(ingest_ms)
    rows = ranked(messages.withColumn("__off", off), source, [F.col(arrival)], "__n")
    rows = rows.withColumn("__b", F.floor((F.col("__n") - 1) / every).cast("long")).drop("__n")
    blocks = rows.groupBy(*source, "__b").agg(F.collect_list("__off").alias("o"), F.count(F.lit(1)).alias("k"))
    held, stretch = size // every, 256
    into = F.explode(F.when(F.col("__b") % stretch > stretch - held, F.array(F.floor(F.col("__b") / stretch), F.floor(F.col("__b") / stretch) + 1)).otherwise(F.array(F.floor(F.col("__b") / stretch))))
    recent = F.flatten(F.collect_list("o").over(Window.partitionBy(*source, "__s").orderBy("__b").rowsBetween(1 - held, 0)))
    middle = blocks.withColumn("__s", into).withColumn("r", F.array_sort(recent)).filter((F.col("k") == every) & (F.col("__s") == F.floor(F.col("__b") / stretch)))
    middle = middle.select(*source, (F.col("__b") + 1).alias("__b"), F.element_at("r", (F.floor(F.size("r") / 2) + 1).cast("int")).alias("__mid"))
    return rows.join(middle, [*source, "__b"], "left").withColumn("ahead", F.col("__off") - F.col("__mid") > most_ms).drop("__b", "__off", "__mid")


def orphans(rows: DataFrame, parent: DataFrame, keys: dict[str, str], name: str) -> DataFrame:
    """One row: name, and how many rows refer to no parent (keys: column of rows -> column of parent; a null reference is none)."""
    theirs = parent.select(*[F.col(p).alias(c) for c, p in keys.items()]).distinct()
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys])
    return rows.filter(known).join(theirs, list(keys), "left_anti").agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(name).alias("reference"), "orphans")


def counters(parts: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """counter, label, n: rows of each part by a label."""
    out = None
    for name, (df, label) in parts.items():
        own = df.groupBy(label.cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("counter"), "label", "n")
        out = own if out is None else out.unionByName(own)
    return out


def rates_as_expected(rows: DataFrame, flags: dict[str, tuple[Column, float]], slack: float = 0.3) -> DataFrame:
    """anomaly, rate, expected, holds: shares of rows with each flag against what is expected, give or take."""
    one = rows.agg(*[F.avg(c.cast("double")).alias(n) for n, (c, _) in flags.items()])
    want = F.create_map(*[F.lit(x) for n, (_, e) in flags.items() for x in (n, e)])
    out = one.unpivot([], list(flags), "anomaly", "rate").withColumn("expected", want[F.col("anomaly")])
    return out.withColumn("holds", F.col("rate").between(F.col("expected") * (1 - slack), F.col("expected") * (1 + slack)))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows of either side the other lacks, repeats counted, and whether they are the same."""
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    return n(a.exceptAll(b), "only_left").crossJoin(n(b.exceptAll(a), "only_right")).withColumn("same", (F.col("only_left") == 0) & (F.col("only_right") == 0))  # one row each


def run_row(rows: DataFrame, run_id: str) -> DataFrame:
    """What a batch run read: rows, units, span."""
    return rows.agg(F.count(F.lit(1)).alias("rows_read"), F.countDistinct("vin").alias("vins"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).select(F.lit(run_id).alias("run_id"), "*")


def repair_messages(raw: DataFrame, body: str = "value") -> DataFrame:
    """raw with vin, repaired_ts and problem (MALFORMED, INVALID_VIN, INVALID_TIME or null) of messages {"vin": ..., "repairedTs": ISO time}."""
    m = F.from_json(F.col(body), "vin string, repairedTs string")
    rows = raw.withColumn("__m", m).withColumns({"vin": F.col("__m.vin"), "repaired_ts": F.try_to_timestamp(F.col("__m.repairedTs"))})
    problem = F.when(F.col("__m").isNull() | (F.col("__m.vin").isNull() & F.col("__m.repairedTs").isNull()), "MALFORMED").when(vin_problem(F.col("vin")).isNotNull(), "INVALID_VIN").when(F.col("repaired_ts").isNull(), "INVALID_TIME")
    return rows.withColumn("problem", problem).drop("__m")
