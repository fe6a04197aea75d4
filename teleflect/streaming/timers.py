"""Streams that act when event time has passed: hourly rows closed by the next hour or by a timer, and a tick for each hour after that.

A unit's hour closes when a reading of a later one comes; an hour of a unit that has gone quiet closes when the
watermark reaches its start plus two hours. A reading older than the open hour is left out, as its row is written. A
tick fires once for each hour of a group (a depot, a tenant), when all rows of that hour have been closed.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000_000
#: What an hourly row is made from: values that qualify (null where they do not), and what every reading carries.
READING = ("vin", "us", "seq", "coolant_c", "batt_temp_c", "lv_batt_v", "soc_pct", "ambient_c", "speed_kmh", "ignition", "codes", "harsh_brake", "harsh_accel", "idle_s")
HOURLY = "vin long, hour timestamp, n long, coolant_c double, batt_temp_c double, lv_batt_v double, max_coolant_c double, max_batt_temp_c double, soc_pct double, ambient_c double, speed_kmh double, codes long, harsh long, idle_s double"
CLOSED = f"{HOURLY}, closed_at timestamp"
TICK = "grp long, tick timestamp, units long, readings long, codes long, fired_at timestamp"
_MEANS = ("coolant_c", "batt_temp_c", "lv_batt_v", "ambient_c")


def hourly_rows(readings: DataFrame, size: int = HOUR) -> DataFrame:
    """HOURLY of readings(READING) in batch."""
    present = F.col("harsh_brake").isNotNull() | F.col("harsh_accel").isNotNull()
    harsh = F.when(present, F.coalesce("harsh_brake", F.lit(0)) + F.coalesce("harsh_accel", F.lit(0)))
    start = (F.floor(F.col("us") / size) * size).cast("long")
    speed: Column = F.avg(F.when(F.col("ignition"), F.col("speed_kmh")))
    out = readings.groupBy("vin", start.alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in _MEANS], F.max("coolant_c").alias("max_coolant_c"), F.max("batt_temp_c").alias("max_batt_temp_c"), F.max_by("soc_pct", F.when(F.col("soc_pct").isNotNull(), F.struct("us", "seq"))).alias("soc_pct"),
        speed.alias("speed_kmh"), F.sum("codes").cast("long").alias("codes"), F.sum(harsh).cast("long").alias("harsh"), F.sum(F.coalesce("idle_s", F.lit(0.0))).alias("idle_s"),
    )
    return out.withColumn("hour", F.timestamp_micros("hour")).select(*[x.split()[0] for x in HOURLY.split(", ")])


class Hour:
    """One unit's open hour: sums and numbers of what was there."""

    def __init__(self, start: int):
        self.start, self.n, self.codes, self.harsh, self.idle, self.soc = start, 0, 0, None, 0.0, None
        self.sums: dict[str, float] = {}
        self.counts: dict[str, int] = {}
        self.most: dict[str, float] = {}

    def add(self, r: Row) -> None:
        self.n += 1
        values = {c: r[c] for c in _MEANS} | {"speed_kmh": r["speed_kmh"] if r["ignition"] else None}
        for c, v in values.items():
            if v is not None:
                self.sums[c], self.counts[c] = self.sums.get(c, 0.0) + v, self.counts.get(c, 0) + 1
                self.most[c] = max(v, self.most.get(c, v))
        self.soc = self.soc if r["soc_pct"] is None else r["soc_pct"]
        self.codes += r["codes"] or 0
        self.idle += r["idle_s"] or 0.0
        if r["harsh_brake"] is not None or r["harsh_accel"] is not None:
            self.harsh = (self.harsh or 0) + (r["harsh_brake"] or 0) + (r["harsh_accel"] or 0)

    def row(self, vin, at: int) -> tuple:
        mean = lambda c: self.sums[c] / self.counts[c] if c in self.counts else None
        return (vin, self.start, self.n, mean("coolant_c"), mean("batt_temp_c"), mean("lv_batt_v"), self.most.get("coolant_c"), self.most.get("batt_temp_c"), self.soc, mean("ambient_c"), mean("speed_kmh"), self.codes, self.harsh, self.idle, at)


def _as_times(schema: str) -> str:
    return ", ".join(f"{x.split()[0]} {'timestamp' if x.split()[0] == schema.split(', ')[-1].split()[0] else 'long' if x.split()[1] == 'timestamp' else x.split()[1]}" for x in schema.split(", "))


def _moment(us: int):
    import datetime as dt

    return dt.datetime.fromtimestamp(us // 1_000_000, dt.timezone.utc).astimezone().replace(tzinfo=None) + dt.timedelta(microseconds=us % 1_000_000)


class HourProcessor(StatefulProcessor):
    def __init__(self, size: int):
        self.size, self.out = size, Row(*[x.split()[0] for x in CLOSED.split(", ")])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("hour", "state binary")

    def _timer(self, start: int) -> int:
        return (start + 2 * self.size) // 1000

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """Hours that open and close within one call need no timer: only the one left open gets it, in place of the one found open."""
        open_: Hour | None = pickle.loads(self.state.get()[0]) if self.state.exists() else None
        found = None if open_ is None else open_.start
        for r in sorted(rows, key=lambda r: (r["us"], r["seq"])):
            start = r["us"] // self.size * self.size
            if open_ is not None and start < open_.start:
                continue
            if open_ is not None and start > open_.start:
                yield self._closed(open_, key[0], r["us"])
                open_ = None
            if open_ is None:
                open_ = Hour(start)
            open_.add(r)
        if open_.start != found:
            if found is not None:
                self.handle.deleteTimer(self._timer(found))
            self.handle.registerTimer(self._timer(open_.start))
        self.state.update((pickle.dumps(open_),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            open_: Hour = pickle.loads(self.state.get()[0])
            if self._timer(open_.start) <= expiredTimerInfo.getExpiryTimeInMs():
                self.state.clear()
                yield self._closed(open_, key[0], open_.start + 2 * self.size)

    def _closed(self, hour: Hour, vin, at: int) -> Row:
        row = hour.row(vin, at)
        return self.out(*row[:-1], _moment(row[-1]))

    def close(self) -> None: ...


def closed_hours(readings: DataFrame, late: str = "0 seconds", size: int = HOUR) -> DataFrame:
    """CLOSED of a stream of readings(READING, ts): each unit's hours once, when they close; closed_at is their event time from here on."""
    rows = readings.withWatermark("ts", late).select(*READING, "ts")
    out = rows.groupBy("vin").transformWithState(HourProcessor(size), _as_times(CLOSED), "append", "eventTime", eventTimeColumnName="closed_at")
    return out.withColumn("hour", F.timestamp_micros("hour"))


class TickProcessor(StatefulProcessor):
    def __init__(self, size: int):
        self.size, self.out = size, Row(*[x.split()[0] for x in TICK.split(", ")])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getMapState("hours", "end long", "units long, readings long, codes long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new: dict[int, list[int]] = {}
        for r in rows:
            own = new.setdefault(r["end_us"], [0, 0, 0])
            for i, n in enumerate((1, r["n"], r["codes"])):
                own[i] += n
        for end, n in new.items():
            held = self.state.getValue((end,)) if self.state.containsKey((end,)) else (0, 0, 0)
            self.state.updateValue((end,), tuple(a + b for a, b in zip(held, n, strict=True)))
            self.handle.registerTimer((end + self.size) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        end = expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.size
        if self.state.containsKey((end,)):
            units, readings, codes = self.state.getValue((end,))
            self.state.removeKey((end,))
            yield self.out(key[0], end, units, readings, codes, _moment(end + self.size))

    def close(self) -> None: ...


def ticks(closed: DataFrame, group: Column, size: int = HOUR) -> DataFrame:
    """TICK of a stream of closed hours: one row for each group and hour, when the hour's rows are complete."""
    rows = closed.select(group.cast("long").alias("grp"), (F.unix_micros("hour") + size).alias("end_us"), "n", "codes", "closed_at")
    out = rows.groupBy("grp").transformWithState(TickProcessor(size), _as_times(TICK), "append", "eventTime", eventTimeColumnName="fired_at")
    return out.withColumn("tick", F.timestamp_micros("tick"))
