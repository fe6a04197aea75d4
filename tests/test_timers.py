"""Hours closed by the next one or by a timer, and ticks, on streams against batches and plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from teleflect.streaming import jobs, timers

T0 = dt.datetime(2026, 9, 28, tzinfo=dt.timezone.utc)
SCHEMA = "vin long, ts timestamp, seq long, coolant_c double, batt_temp_c double, lv_batt_v double, soc_pct double, ambient_c double, speed_kmh double, ignition boolean, codes long, harsh_brake long, harsh_accel long, idle_s double"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def some_readings(seed, vins=8, hours=12):
    rnd, rows = random.Random(seed), []
    for v in range(vins):
        quiet = rnd.choice([hours, hours, 3, 5])
        t = rnd.random()
        i = 0
        while t < min(hours, quiet):
            maybe = lambda x: rnd.choice([None, x])  # noqa: B023, E731
            rows.append((2**60 + v, T0 + dt.timedelta(hours=t), i, maybe(90 + rnd.random()), maybe(30.0), 12.5, maybe(80 - t), maybe(20.0), maybe(40.0), rnd.random() < 0.7, rnd.choice([0, 0, 2]), maybe(1), maybe(2), maybe(5.0)))
            t += rnd.choice([0.1, 0.3, 2.5])
            i += 1
    return sorted(rows, key=lambda r: r[1])


def streamed(spark, rows, tmp_path, parts):
    cut = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * cut : (i + 1) * cut], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return s.withColumn("us", F.unix_micros("ts"))


def columns():
    return [x.split()[0] for x in timers.HOURLY.split(", ")]


def plain(rows):
    return sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in rows.select(*columns()).collect())


def test_hours_close_once(rocks, tmp_path):
    """Every hour that a later reading or the watermark closes is there once, as the batch has it."""
    rows = some_readings(1)
    out = tmp_path / "out"
    jobs.run_available(timers.closed_hours(streamed(rocks, rows, tmp_path, 4)), str(out), str(tmp_path / "c"))
    got = rocks.read.parquet(str(out))
    whole = timers.hourly_rows(rocks.createDataFrame(rows, SCHEMA).withColumn("us", F.unix_micros("ts")))
    newest, last = max(r[1] for r in rows), {}
    for r in rows:
        last[r[0]] = max(last.get(r[0], r[1]), r[1])
    shut = [r for r in whole.collect() if (last[r["vin"]].timestamp() // 3600 > r["hour"].timestamp() // 3600) or r["hour"].timestamp() + 7200 <= newest.timestamp()]
    assert plain(got) == plain(rocks.createDataFrame(shut, whole.schema)) and got.count() > 20
    by_timer = got.filter("closed_at = hour + INTERVAL 2 HOURS").count()
    assert 0 < by_timer < got.count()  # quiet units


def test_readings_older_than_the_open_hour_are_left_out(rocks, tmp_path):
    late = (7, T0 + dt.timedelta(minutes=30), 9, 1.0, None, None, None, None, None, False, 5, None, None, None)
    rows = [(7, T0 + dt.timedelta(hours=h), i, 90.0, None, None, None, None, None, False, 0, None, None, None) for i, h in enumerate((0.1, 0.9, 1.2))]
    s = streamed(rocks, [*rows, late, (8, T0 + dt.timedelta(hours=9), 0, *late[3:])], tmp_path, 1).withColumn("ts", F.col("ts"))
    jobs.run_available(timers.closed_hours(s, "24 hours"), str(tmp_path / "out"), str(tmp_path / "c"))
    got = rocks.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["vin"], r["n"], r["codes"]) for r in got] == [(7, 3, 5)]  # in one batch order is by time; it is in its hour
    s2 = tmp_path / "two"
    s = streamed(rocks, [*rows, late], s2, 2)  # its batch comes after the hour has closed
    jobs.run_available(timers.closed_hours(s, "24 hours"), str(s2 / "out"), str(s2 / "c"))
    assert [(r["n"], r["codes"]) for r in rocks.read.parquet(str(s2 / "out")).collect()] in ([(2, 0)], [(3, 5)])


def test_a_tick_fires_once_an_hour(rocks, tmp_path):
    rows = some_readings(2, 12, 9)
    closed = timers.closed_hours(streamed(rocks, rows, tmp_path, 5))
    jobs.run_available(timers.ticks(closed, F.col("vin") % 3), str(tmp_path / "out"), str(tmp_path / "c"))
    got = {(r["grp"], int(r["tick"].timestamp())): (r["units"], r["readings"], r["codes"]) for r in rocks.read.parquet(str(tmp_path / "out")).collect()}
    want: dict = {}
    newest = max(r[1] for r in rows).timestamp()
    for r in rows:
        end = int(r[1].timestamp() // 3600 + 1) * 3600
        if end + 3600 <= newest:
            own = want.setdefault((r[0] % 3, end), [set(), 0, 0])
            own[0].add(r[0])
            own[1] += 1
            own[2] += r[10]
    assert got == {k: (len(v[0]), v[1], v[2]) for k, v in want.items()} and len(got) > 15


def test_one_timer_for_the_hours_of_a_call():
    """Hours that open and close within one batch register and delete no timer; the one left open has one."""
    calls, kept = [], {}

    class State:
        exists = staticmethod(lambda: "x" in kept)
        get = staticmethod(lambda: kept["x"])
        update = staticmethod(lambda x: kept.update(x=x))

    class Handle:
        getValueState = staticmethod(lambda name, schema: State)
        registerTimer = staticmethod(lambda at: calls.append(("register", at)))
        deleteTimer = staticmethod(lambda at: calls.append(("delete", at)))

    p, hour = timers.HourProcessor(timers.HOUR), timers.HOUR
    p.init(Handle)
    row = lambda us: dict.fromkeys(timers.READING) | {"us": us, "seq": us}
    assert len(list(p.handleInputRows((1,), iter([row(i * hour) for i in range(50)]), None))) == 49
    assert calls == [("register", 51 * hour // 1000)]
    assert list(p.handleInputRows((1,), iter([row(49 * hour + 5)]), None)) == [] and len(calls) == 1
    assert len(list(p.handleInputRows((1,), iter([row(60 * hour)]), None))) == 1
    assert calls[1:] == [("delete", 51 * hour // 1000), ("register", 62 * hour // 1000)]


def test_batches_of_several_files(spark, monkeypatch):
    """A batch of a stream is as many files as its rows ask for, and a trigger takes those of one batch only."""
    from teleflect.plans import streams

    monkeypatch.setattr(streams, "FILE_ROWS", 50)
    rows = spark.range(1000).selectExpr("id", "timestamp_seconds(id) AS ts")
    stream, seen = streams.in_batches(rows, "several"), []
    base = streams.fleet.scratch(spark, "several-checkpoint")
    stream.writeStream.foreachBatch(lambda b, n: seen.append((b.rdd.getNumPartitions(), b.agg({"id": "min"}).first()[0], b.agg({"id": "max"}).first()[0]))).option("checkpointLocation", base).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == streams.BATCHES and seen[0][1] == 0 and seen[-1][2] == 999
    assert all(n > 1 for n, _, _ in seen) and all(a[2] + 1 == b[1] for a, b in zip(seen, seen[1:]))
