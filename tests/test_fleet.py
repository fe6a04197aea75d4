"""Small hand-made cases of the fleet operators."""

import datetime as dt
import math
import random
import uuid

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from teleflect.functions import exprs as X
from teleflect.operators import baselines as B
from teleflect.operators import campaigns as C
from teleflect.operators import detect as D
from teleflect.operators import evaluate as E
from teleflect.operators import joins as J
from teleflect.operators import queue as Q
from teleflect.operators import views as V
from teleflect.params import Baselines, Campaign, Fix, Metric
from teleflect.sources import raw
from teleflect.streaming import jobs

T0 = dt.datetime(2026, 9, 28, 4, tzinfo=dt.UTC)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_uuid5(spark):
    ns = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    assert one(spark, X.uuid5(ns, F.lit("python.org"))) == "886313e1-3b8a-5372-9b90-0c9aee199e5d"
    names = [f"név-{i}" for i in range(40)]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(X.uuid5(ns, F.col("n")).alias("u")).collect()
    assert [r["u"] for r in got] == [str(uuid.uuid5(uuid.UUID(ns), n)) for n in names]


def test_vin(spark):
    cases = {"1HGCM82633A004352": None, "1HGCM82643A004352": "CHECK_DIGIT", "1HGCM8263OA004352": "CHARACTERS", "1HGCM82633A00435": "LENGTH", "1hgcm82633a004352": "CHARACTERS", None: "LENGTH"}
    got = spark.createDataFrame([(v,) for v in cases], "v string").select("v", X.vin_problem(F.col("v")).alias("p")).collect()
    assert {r["v"]: r["p"] for r in got} == cases


def test_geohash(spark):
    assert one(spark, X.geohash5(F.lit(57.64911), F.lit(10.40744))) == "u4pru"
    assert one(spark, X.geohash5(F.lit(90.0), F.lit(180.0))) == "zzzzz"


@pytest.mark.parametrize(("n", "rate"), [(5, 0.7), (3, 2.5), (10, 4.0), (1, 0.1)])
def test_poisson_tail(spark, n, rate):
    exact = 1 - sum(math.exp(-rate) * rate**k / math.factorial(k) for k in range(n))
    assert one(spark, X.poisson_tail(F.lit(n), F.lit(rate))) == pytest.approx(exact, abs=1e-12)
    assert C.tail(n, rate) == pytest.approx(exact, abs=1e-12)


def test_poisson_edges(spark):
    assert one(spark, X.poisson_tail(F.lit(0), F.lit(1.0))) == 1.0
    assert one(spark, X.poisson_tail(F.lit(2), F.lit(0.0))) == 0.0
    assert one(spark, X.poisson_tail(F.lit(18), F.lit(0.5))) < 1e-15


@pytest.mark.parametrize(("n", "rate"), [(50, 150.0), (3, 90.0), (30, 30.0), (9, 4.5), (400, 399.0), (401, 402.5), (2000, 1900.0), (5, 900.0), (2000, 2100.0)])
def test_poisson_tail_of_large_groups(spark, n, rate):
    below = sum(math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(n))
    assert one(spark, X.poisson_tail(F.lit(n), F.lit(rate))) == pytest.approx(1 - below, abs=1e-10)
    assert C.tail(n, rate) == pytest.approx(1 - below, abs=1e-10)


def test_campaigns_keep_large_groups(spark, monkeypatch):
    from teleflect.plans import queries as Q

    groups = spark.createDataFrame([("0|1|2", 0, 1, 1, 3), ("1|1|2", 0, 1, 2, 50)], "family_key string, grp long, first_bucket long, last_bucket long, members long")
    monkeypatch.setattr(Q, "group_touching_buckets", lambda spark, sf: groups)
    monkeypatch.setattr(Q.fleet, "registry", lambda spark, sf: spark.range(400).select(F.col("id").alias("vin"), F.lit(1).cast("long").alias("model_id"), F.lit(2).cast("long").alias("duty_type_id")))
    monkeypatch.setattr(Q, "rates", lambda spark, sf: spark.createDataFrame([("COOLING", 1, 2, 100.0, 50)], "family string, model_id long, duty_type_id long, vehicle_days double, codes long"))
    got = {r["family_key"]: r["p_value"] for r in Q.campaign_open_poisson(spark, "").collect()}
    assert got == {"0|1|2": pytest.approx(C.tail(3, 4.0), abs=1e-6), "1|1|2": pytest.approx(C.tail(50, 8.0), abs=1e-6)}


def test_hours_to_limit(spark):
    f = lambda level, rate: one(spark, X.hours_to_limit(F.lit(level), F.lit(rate), 110, 0.5))
    assert (f(100.0, 2.0), f(100.0, 0.1), f(100.0, -2.0), f(112.0, 2.0)) == (5.0, None, None, 0.0)


def history(spark):
    rows = []
    for vin, level in ((1, 90.0), (2, 97.0)):
        for day in range(4):
            for k in range(25):
                rows.append((vin, day * 100 + k, T0 + dt.timedelta(days=day, hours=2 + k / 2), level + 0.5 * math.sin(k / 3)))
    return spark.createDataFrame(rows, "vin long, seq long, ts timestamp, y double")


def test_window_levels_do_not_depend_on_how_rows_are_dealt(spark):
    """A window's values are added up in order of time: bit for bit the same level from any layout."""
    rnd = random.Random(3)
    rows = [(v, "m", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), round(rnd.uniform(0, 100), 2)) for v in range(40) for i in range(25)]
    want = {v: 0.0 for v in range(40)}
    for v, _, _, y in rows:
        want[v] += y
    for parts in (1, 5, 16):
        rnd.shuffle(rows)
        df = spark.createDataFrame(rows, "vin long, metric string, ts timestamp_ntz, y double").repartition(parts)
        assert {r["vin"]: r["level"] for r in B.window_stats(df).collect()} == {v: x / 25 for v, x in want.items()}


def test_window_levels_are_added_up_as_the_table_has_them(spark, tmp_path):
    """Bit for bit what one pass over the files gives, also where they are not in order of time."""
    from teleflect.plans import queries

    rnd = random.Random(5)
    rows = [(i, dt.datetime(2024, 1, 3) + dt.timedelta(minutes=rnd.randint(0, 4000)), i % 40, "view", round(rnd.uniform(0, 100), 2), '{"k": 1}') for i in range(1000)]
    for part in (rows[:600], rows[600:]):
        spark.createDataFrame(part, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    want: dict[int, float] = {}
    for f in sorted((tmp_path / "events.parquet").glob("*.parquet")):
        for r in pq.read_table(f).to_pylist():
            want[r["user_id"]] = want.get(r["user_id"], 0.0) + r["value"]
    assert {r["vin"]: r["level"] for r in queries.windows(spark, str(tmp_path)).collect()} == {v: x / 25 for v, x in want.items()}


def test_own_normal(spark):
    veh = spark.createDataFrame([(1, 1, 1, 1, 3), (2, 1, 1, 2, 3)], "vin long, model_id int, duty_type_id int, depot_id int, region_id int")
    n = B.own_normal(B.window_stats(history(spark).withColumn("metric", F.lit("coolant_c"))), veh, Baselines())
    got = {r["vin"]: r for r in n.collect()}
    assert abs(got[1]["median"] - 90) < 0.3 and abs(got[2]["median"] - 97) < 0.3
    assert all(0 <= r["mad"] < 0.3 and r["windows"] >= 4 for r in got.values())
    assert {(r["region_id"], r["vins"]) for r in B.cohort_normal(n, veh).collect()} == {(0, 2), (3, 2)}


def test_codes_and_rates(spark):
    veh = spark.createDataFrame([(1, 1, 1, 1, 3), (2, 1, 1, 1, 3)], "vin long, model_id int, duty_type_id int, depot_id int, region_id int")
    fam = spark.createDataFrame([("P0217", "COOLING"), ("P0420", "EXHAUST")], "code string, family string")
    rows = history(spark).withColumn("dtc", F.when((F.col("vin") == 1) & (F.col("seq") == 3), "P0217|P9999"))
    codes, days = B.code_rows(rows, fam), B.days_seen(rows)
    assert {(r["family"], r["codes_per_day"]) for r in B.codes_per_day(codes, days).collect()} <= {("COOLING", 0.25), ("OTHER", 0.25), ("COOLING", 0.2), ("OTHER", 0.2)}
    rates = {r["family"]: r for r in B.fault_rates(codes, days, veh, fam).collect()}
    assert set(rates) == {"COOLING", "EXHAUST", "OTHER"} and rates["EXHAUST"]["codes"] == 0 and rates["COOLING"]["codes"] == 1


def test_trend_line(spark):
    line = D.Line(12.0)
    for h in (0, 1, 2, 4, 3.5, 5):
        line.add(h, 10 + 2 * h)
    assert line.slope == pytest.approx(2) and line.now == pytest.approx(20)
    single = D.Line(12.0)
    single.add(0, 5)
    assert single.slope is None and single.now == 5


def test_window_trend_is_the_fold(spark):
    rnd = random.Random(3)
    rows = [(1, i, T0 + dt.timedelta(hours=i * 0.5), 50 + rnd.random() * 9) for i in range(120)]
    df = spark.createDataFrame(rows, "vin long, seq long, ts timestamp, y double")
    line, want = D.Line(12.0), []
    for _, i, _, y in rows:
        line.add(i * 0.5, y)
        want.append((line.n, line.mean, line.slope))
    for r, (n, mean, slope) in zip(D.weighted_trend(df, ["vin"]).orderBy("seq").collect(), want, strict=True):
        assert r["weight"] == pytest.approx(n) and r["mean"] == pytest.approx(mean)
        assert (r["slope"] is None) == (slope is None) and (slope is None or r["slope"] == pytest.approx(slope, abs=1e-7))


def test_k_of_n(spark):
    flags = [True, False, True, True, True, False, False, False]
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate(flags)], "vin int, i int, f boolean")
    got = D.k_of_n(df, ["vin"], "i", F.col("f")).orderBy("i").collect()
    assert [r["confirmed"] for r in got] == [False, False, False, False, True, True, False, False]
    assert [r["run"] for r in got] == [1, 1, 1, 2, 3, 1, 2, 3]


def test_code_ring(spark):
    at = [0, 2, 1, 24.5]
    df = spark.createDataFrame([(1, T0 + dt.timedelta(hours=h)) for h in at], "vin int, ts timestamp")
    got = D.codes_in_24h(df, ["vin"]).orderBy("hour").collect()
    assert [r["n24"] for r in got] == [1, 2, 3, 3]


METRICS = {"coolant_c": ("COOLING", Metric())}
SCHEMA = "vin long, seq long, ts timestamp, kind string, name string, y double, usual double, median double, mad double, slope_median double, slope_mad double, peer_dev double, peer_slope double, peer_fast double"


def row(i, h, kind="READING", name="coolant_c", y=None, peer=None, usual=None, vin=1):
    normal = (90.0, 0.6, 0.0, 0.1) if kind == "READING" else (None,) * 4
    return (vin, i, T0 + dt.timedelta(hours=h), kind, name, y, usual, *normal, peer, None, None)


def readings(spark, f, hours=72, vin=1, peer=None):
    return spark.createDataFrame([row(i, i / 2, y=float(f(i / 2)), peer=peer(i / 2) if peer else None, vin=vin) for i in range(hours * 2)], SCHEMA)


def detected(df):
    return D.detect_fold(df, METRICS).orderBy("seq").collect()


def actions(df):
    return [(r["action"], r["severity"]) for r in detected(df) if r["action"]]


def test_fold_quiet_drift_and_close(spark):
    rnd = random.Random(1)
    assert actions(readings(spark, lambda h: 90 + rnd.gauss(0, 0.8))) == []
    opened = actions(readings(spark, lambda h: 90 + (0 if h < 24 else min(20, (h - 24)))))
    assert opened[0][0] == "OPEN"
    back = actions(readings(spark, lambda h: 90 + (8 if 20 < h < 40 else 0), 160))
    assert [a for a, _ in back] == ["OPEN", "CLOSE"]


def test_fold_spike_and_runaway(spark):
    assert actions(readings(spark, lambda h: 140 if h == 30 else 90)) == []
    run = actions(readings(spark, lambda h: 90 if h < 20 else min(108, 90 + (h - 20) * 2.2), 30))
    assert ("ESCALATE", "CRITICAL") in run or ("OPEN", "CRITICAL") in run


def test_fold_skips_repeats_and_order(spark):
    df = readings(spark, lambda h: 90 + (0 if h < 24 else 6))
    twice = df.unionByName(df.filter("seq % 3 = 0")).orderBy(F.rand(1))
    key = lambda d: [(r["seq"], r["z"], r["action"]) for r in detected(d)]
    assert key(twice) == key(df)


def test_fold_minus_peers(spark):
    """What all peers do alike is no incident; what a unit does beyond them is."""
    heat = lambda h: 6.0 if h >= 24 else 0.0
    hot = lambda h: 90 + heat(h)
    assert [a for a, _ in actions(readings(spark, hot))] == ["OPEN"]
    assert actions(readings(spark, hot, peer=heat)) == []
    assert [a for a, _ in actions(readings(spark, lambda h: hot(h) + heat(h), peer=heat))] == ["OPEN"]


def test_fold_repair_starts_again(spark):
    """After a repair the trend is new: the old fault does not confirm again, late readings from before it are ignored, and the incident closes by readings."""
    rows = [row(i, i / 2, y=98.0 if 20 < i / 2 < 40 else 90.0) for i in range(160)]
    late = [row(500, 39.0, y=99.0)]
    repair = [row(81, 40.25, kind="REPAIR", name="")]
    out = detected(spark.createDataFrame([*rows, *repair, *late], SCHEMA))
    close = next(r for r in out if r["action"] == "CLOSE")
    without = next(r for r in detected(spark.createDataFrame(rows, SCHEMA)) if r["action"] == "CLOSE")
    assert close["seq"] < without["seq"] and not any(r["seq"] == 500 for r in out)


def test_fold_code_rate(spark):
    """Codes well above usual open an incident of their own; a confirmed signal makes it one of the signal; without codes it ends."""
    quiet = [row(i, i / 2, y=90.0) for i in range(140)]
    many = [row(1000 + i, 30 + i / 10, kind="CODES", name="COOLING", y=1.0, usual=0.2) for i in range(4)]
    in_order = lambda rows: [(*r[:1], i, *r[2:]) for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[1])))]
    out = [(r["action"], r["trigger"], r["severity"]) for r in detected(spark.createDataFrame(in_order([*quiet, *many]), SCHEMA)) if r["action"]]
    assert out == [("OPEN", "CODE_RATE", "WARN"), ("CLOSE", "CODE_RATE", "WARN")]
    drift = [row(i, i / 2, y=90.0 if i < 62 else 96.0) for i in range(90)]
    out = [(r["action"], r["trigger"], r["severity"]) for r in detected(spark.createDataFrame(in_order([*drift, *many]), SCHEMA)) if r["action"]]
    assert out == [("OPEN", "CODE_RATE", "WARN"), ("ESCALATE", "SIGNAL", "HIGH")]
    usual = [(*r[:6], 5.0, *r[7:]) for r in many]
    assert not [r for r in detected(spark.createDataFrame(in_order([*quiet, *usual]), SCHEMA)) if r["action"]]


def test_with_peers_is_a_plain_count(spark):
    from teleflect.params import Detect

    rnd, rows, p = random.Random(9), [], Detect(min_peers=2, min_weight=1.0)
    for vin in range(6):
        for i in range(30):
            rows.append((vin, "m", vin * 1000 + i, T0 + dt.timedelta(hours=i * 0.4), 50 + rnd.random() * 5 + vin, 50.0 + vin, 1.0, 0.1, 0.2))
    df = spark.createDataFrame(rows, "vin long, metric string, seq long, ts timestamp, y double, median double, mad double, slope_median double, slope_mad double")
    veh = spark.createDataFrame([(v, v % 2, 0 if v < 5 else 1) for v in range(6)], "vin long, region_id int, duty_type_id int")
    newest = {}
    for vin in range(6):
        line = D.Line(p.tau_h)
        for v, _, seq, ts, y, median, *_ in [r for r in rows if r[0] == vin]:
            line.add(ts.timestamp() / 3600, y)
            newest[vin, int(ts.timestamp() // 3600)] = line.mean - median
    import statistics

    for r in D.with_peers(df, veh, p).collect():
        hour, out = int(r["ts"].timestamp() // 3600), None
        for scope in (lambda v: (v % 2, v < 5), lambda v: v % 2):
            own = [d for (v, h), d in newest.items() if h == hour and scope(v) == scope(r["vin"])]
            if len(own) >= 2:
                out = statistics.median(own)
                break
        assert r["peer_dev"] == pytest.approx(out, abs=1e-8)


def test_trend_over_a_long_history(spark):
    """Time spans of thousands of tau: no overflow, and the same values as the fold."""
    rows = [(1, i, T0 + dt.timedelta(hours=h), 50.0 + (i * 7 % 11)) for i, h in enumerate(sorted([x * 3.0 for x in range(40)] + [4500 + x for x in range(30)] + [4799, 4801, 9000]))]
    df = spark.createDataFrame(rows, "vin long, seq long, ts timestamp, y double")
    line = D.Line(12.0)
    for r, (_, _, ts, y) in zip(D.weighted_trend(df, ["vin"]).orderBy("seq").collect(), rows, strict=True):
        line.add((ts - T0).total_seconds() / 3600, y)
        assert r["weight"] == pytest.approx(line.n, rel=1e-9) and r["mean"] == pytest.approx(line.mean, rel=1e-9)


def test_streams_are_the_batch(spark, tmp_path):
    """Detection and the replay window on a stream in several batches give what the batch gives."""
    df = readings(spark, lambda h: 90 + (0 if h < 24 else 6)).unionByName(readings(spark, lambda h: 90 + (8 if 20 < h < 40 else 0), 80, vin=2))
    for i, (a, z) in enumerate(((0, 40), (40, 90), (90, 1000))):
        df.filter(f"seq >= {a} and seq < {z}").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}.parquet"))
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = jobs.fold_stream(D.detect_input(s), ["vin"], ["seq", "kind", "name"], lambda r: D.Vehicle(METRICS, D.Detect()), D.vehicle_step, D.FOLD)
        jobs.run_available(out, str(tmp_path / "out"), str(tmp_path / "c1"))
        messages = s.select("vin", "seq", "ts", F.col("seq").alias("arrival"))
        jobs.run_available(jobs.replay_stream(messages.unionByName(messages)), str(tmp_path / "replayed"), str(tmp_path / "c2"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    key = lambda d: sorted((r["vin"], r["seq"], r["action"], round(r["z"], 9)) for r in d.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(D.detect_fold(df, METRICS))
    got = {(r["outcome"], r["count"]) for r in spark.read.parquet(str(tmp_path / "replayed")).groupBy("outcome").count().collect()}
    assert got == {("NEW", df.count()), ("DUPLICATE", df.count())}


def test_qualifying(spark):
    on, off, p = "IGNITION_ON", "IGNITION_OFF", "PERIODIC"
    cases = [(on, 0, True, False, 30.0, []), (p, 10, True, False, 30.0, []), (p, 30, True, False, 30.0, []), (p, 40, True, True, 30.0, []), (p, 50, True, False, 0.0, []), (p, 60, False, False, 30.0, []), (p, 70, True, False, 30.0, ["LATE"]),
             (p, 80, True, False, 30.0, ["OUT_OF_RANGE:coolant_c"]), ("HEARTBEAT", 90, True, False, 30.0, []), (off, 95, False, False, 0.0, []), (p, 96, True, False, 30.0, [])]
    df = spark.createDataFrame([(1, i, T0 + dt.timedelta(minutes=m), e, ig, ch, sp, 90.0, 12.5, fl) for i, (e, m, ig, ch, sp, fl) in enumerate(cases)], "vin long, seq long, ts timestamp, evt string, ignition boolean, charging boolean, speed_kmh double, coolant_c double, lv_batt_v double, quality_flags array<string>")
    got = sorted((r["metric"], r["seq"]) for r in D.qualifying(df, {"coolant_c": (-40, 150), "lv_batt_v": (6, 18)}).collect())
    assert got == [("coolant_c", 2), ("coolant_c", 10), ("lv_batt_v", 1), ("lv_batt_v", 2), ("lv_batt_v", 3), ("lv_batt_v", 4), ("lv_batt_v", 7), ("lv_batt_v", 10)]


def test_jump_checks_do_not_carry_what_they_flag(spark):
    from teleflect.operators import checks as K

    rows = [(1, 0, 100.0, 50.0, True, False), (1, 1, 40.0, 50.2, True, False), (1, 2, 101.0, 55.0, True, False), (1, 3, 100.995, 50.6, True, False), (1, 4, 102.0, 60.0, False, False), (1, 5, 103.0, 80.0, True, False), (1, 2, 50.0, 1.0, True, False), (1, 6, 104.0, 90.0, True, True)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "vin long, seq long, odo_km double, soc_pct double, driving boolean, engine boolean, arrival int")
    got = [r["flags"] for r in K.jump_checks(df, "arrival").collect()]
    assert got == ["", "ODOMETER_BACKWARDS", "SOC_RISING_WHILE_DRIVING", "", "", "", ""]  # the repeated message is gone


def test_clock_ahead_is_a_plain_ring(spark):
    from teleflect.operators import checks as K

    rnd = random.Random(2)
    rows = [("a", i, 1000 * i + rnd.randint(0, 500) + (700_000 if i % 37 == 5 else 0), 1000 * i) for i in range(900)]
    want, ring, now = [], [], None
    for _, _, e, g in rows:
        want.append(None if now is None else e - g - now > 120_000)
        ring = [*ring, e - g][-512:]
        if (len(want)) % 64 == 0:
            now = sorted(ring)[len(ring) // 2]
    df = spark.createDataFrame(rows, "src string, i long, e long, g long")
    assert [r["ahead"] for r in K.clock_ahead(df, ["src"], "i", "e", "g").orderBy("i").collect()] == want


def test_open_at_and_digits(spark):
    from teleflect.operators import pages as P

    spans = spark.createDataFrame([(1, T0, T0 + dt.timedelta(hours=5)), (1, T0 + dt.timedelta(hours=2), T0 + dt.timedelta(hours=3)), (2, T0 + dt.timedelta(hours=9), None)], "vin long, start timestamp, end timestamp")
    rows = spark.createDataFrame([(v, i, T0 + dt.timedelta(hours=i)) for v in (1, 2, 3) for i in (-2, -1, 0, 4, 5, 8, 20)], "vin long, i long, ts timestamp")
    assert sorted((r["vin"], r["i"]) for r in P.open_at(rows, spans, ["vin"], "ts", "o").collect() if r["o"]) == [(1, -1), (1, 0), (1, 4), (2, 8), (2, 20)]
    digits = {5: "5", 999: "999", 1000: "1,000", 123456: "1,23,456", 1234567: "12,34,567", 12345678: "1,23,45,678"}
    got = spark.createDataFrame([(n,) for n in digits], "n long").select("n", P.grouped_digits(F.col("n")).alias("t")).collect()
    assert {r["n"]: r["t"] for r in got} == digits


def test_most_similar_in_blocks_is_brute_force(spark):
    rnd = random.Random(8)
    rows = [(i, [rnd.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 6) if (n := math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))) else 0.0
    want = {(i, r + 1, j, s) for i, v in rows if i % 7 == 0 for r, (s, j) in enumerate(sorted((-cos(v, w), j) for j, w in rows if j != i)[:3]) for s in [-s + 0.0]}
    got = {(r["id"], r["rank"], r["other_id"], r["similarity"] + 0.0) for r in C.most_similar(df.filter("id % 7 = 0"), df, block=5, chunk=9).collect()}
    assert got == want


def test_importance_finds_the_column_that_tells(spark):
    from teleflect.operators import learn as L

    rnd = random.Random(3)
    rows = [(i, x := rnd.random(), rnd.random(), rnd.random() > 0.5, rnd.choice("ab"), int(x > 0.8)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, tells double, noise double, flag boolean, kind string, label int")
    model = L.train(df, ["tells", "noise"], ["flag"], ["kind"], iterations=3, depth=2)
    drop = {r["feature"]: r["drop"] for r in L.importance(model, df, ["tells", "noise"], ["flag"], ["kind"]).collect()}
    assert drop["tells"] > 0.3 and max(abs(v) for k, v in drop.items() if k != "tells") < 0.1


def test_touching_groups(spark):
    df = spark.createDataFrame([("k", d, v) for v, d in enumerate((0, 1, 44, 45))], "key string, b long, vin int")
    assert C.touching_groups(df, "key", "b").count() == 2
    more = df.unionByName(spark.createDataFrame([("k", d, 9) for d in range(2, 44)], "key string, b long, vin int"))
    r = C.touching_groups(more, "key", "b").collect()
    assert len(r) == 1 and r[0]["members"] == 5


def book_events(spark, rows, **p):
    df = spark.createDataFrame([("K", i, ts, kind, vin, runaway, 60, 4.0) for i, (ts, kind, vin, runaway) in enumerate(rows)], "family_key string, seq long, ts timestamp, kind string, vin long, runaway boolean, vans int, per_1000 double")
    return [(r["kind"], r["members"]) for r in C.campaign_fold(df, Campaign(**p)).collect()]


def h(n):
    return T0 + dt.timedelta(hours=n)


def test_book_opens_grows_merges_closes(spark):
    assert book_events(spark, [(h(i), "INCIDENT", i, False) for i in range(7)]) == [("OPENED", 5), ("GREW", 6), ("GREW", 7)]
    apart = [(h(0), "INCIDENT", 1, False), (h(1), "INCIDENT", 2, False), (h(44), "INCIDENT", 3, False), (h(45), "INCIDENT", 4, False), (h(30), "INCIDENT", 5, False)]
    assert book_events(spark, apart[:4]) == []
    late = [(*x[:1], *x[1:]) for x in apart]
    book, out = C.Book(Campaign(), 60, 0.1), []
    for ts, _, vin, _ in late:
        out += book.incident(vin, int(ts.timestamp() // 86400), 0)
    assert [e[1] for e in out] == ["MERGED", "OPENED"] or [e[1] for e in out][-1] == "OPENED"
    five = [(h(i), "INCIDENT", i, False) for i in range(5)] + [(h(10 + i), "FIXED", i, False) for i in range(5)]
    assert book_events(spark, five)[-1] == ("CLOSED", 5)


def test_book_joins_once_and_stays_dismissed(spark):
    rows = [(h(i), "INCIDENT", i, False) for i in range(6)] + [(h(6), "INCIDENT", 0, False), (h(7), "DISMISS", 0, False)] + [(h(8 + i), "INCIDENT", 10 + i, False) for i in range(3)]
    assert book_events(spark, rows) == [("OPENED", 5), ("GREW", 6), ("DISMISSED", 6), ("REOPENED", 9)]


def test_bays_and_bookings(spark):
    rows = [("d", v, s, p, ttl) for v, s, p, ttl in (("RUN", 0.9, True, 5.0), ("A", 0.8, False, None), ("B", 0.7, False, None), ("C", 0.6, False, None), ("LOW", 0.1, False, None))]
    df = spark.createDataFrame(rows, "depot_id string, vin string, score double, pinned boolean, hours_left double")
    got = {r["vin"]: (r["slot"], r["wait_days"]) for r in Q.fill_bays(Q.rank(df), spark.createDataFrame([("d", 2)], "depot_id string, bays int")).collect()}
    assert got == {"RUN": ("TODAY", 0), "A": ("TODAY", 0), "B": ("TOMORROW", 1), "C": ("TOMORROW", 1), "LOW": ("WAITING", 2)}
    q = spark.createDataFrame([(1, i, i, i == 1, i <= 4, {3: "TODAY", 5: "TOMORROW"}.get(i), 2) for i in range(1, 6)], "depot_id long, vin long, rank int, pinned boolean, eligible boolean, booking string, per_day int")
    placed = {r["vin"]: r["slot"] for r in Q.place_bookings(q).collect()}
    assert placed == {1: "TODAY", 3: "TODAY", 5: "TOMORROW", 2: "TOMORROW", 4: "WAITING"}


def test_fix_verdict(spark):
    fixed = T0.replace(tzinfo=None)
    rep = spark.createDataFrame([(1, fixed), (2, fixed), (3, fixed)], "vin int, repaired timestamp_ntz")
    rows = [(1, fixed + dt.timedelta(hours=i), 0.5) for i in range(11)] + [(2, fixed + dt.timedelta(hours=i), 0.5) for i in range(12)] + [(3, fixed + dt.timedelta(hours=i), 4.0) for i in range(24)]
    hourly = spark.createDataFrame(rows, "vin int, ts timestamp_ntz, z double")
    now = F.lit(fixed + dt.timedelta(hours=30)).cast("timestamp_ntz")
    assert {r["vin"]: r["verdict"] for r in Q.fix_verdict(rep, hourly, now, Fix()).collect()} == {1: "PENDING", 2: "FIXED", 3: "NOT_FIXED"}


def test_valid_at_and_overlaps(spark):
    ranges = spark.createDataFrame([(1, h(0), h(30), 10), (1, h(30), None, 11), (2, h(5), h(6), 7)], "vin int, a timestamp, b timestamp, depot int")
    facts = spark.createDataFrame([(1, h(-1)), (1, h(0)), (1, h(29)), (1, h(30)), (2, h(5)), (2, h(9)), (3, h(1))], "vin int, ts timestamp")
    got = [(r["vin"], r["depot"]) for r in J.valid_at(facts, ranges, "vin", "ts", "a", "b", "depot").orderBy("vin", "ts").collect()]
    assert got == [(1, 11), (1, 10), (1, 10), (1, 11), (2, 7), (2, 7), (3, None)]
    bad = spark.createDataFrame([(1, h(0), h(5)), (1, h(4), None)], "vin int, a timestamp, b timestamp")
    assert J.overlaps(bad, "vin", "a", "b").count() == 1 and J.overlaps(ranges, "vin", "a", "b").count() == 0


def test_changes_and_insert_if_absent(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "w"), (4, "n")], "k int, v string")
    assert {(r["k"], r["change"]) for r in J.changes(a, b, ["k"], ["v"]).collect()} == {(2, "UPDATED"), (3, "WITHDRAWN"), (4, "CREATED")}
    assert [r["k"] for r in J.insert_if_absent(b, a, ["k"]).collect()] == [4]


def test_replay_outcomes():
    state, out = None, []
    for seq, at in ((10, 1), (12, 2), (12, 3), (11, 4), (11, 5), (5000, 6), (13, 5), (20, 9)):
        o, state = jobs.judge(state, seq, at)
        out.append(o)
    assert out == ["NEW", "NEW", "DUPLICATE", "LATE_NEW", "DUPLICATE", "NEW", "TOO_OLD", "SEQ_RESET"]


def test_replay_of_shuffled_messages(spark):
    rnd = random.Random(5)
    seqs = [s for s in range(200) for _ in range(1 + (s % 4 == 0))]
    rnd.shuffle(seqs)
    df = spark.createDataFrame([(1, i, s, T0 + dt.timedelta(seconds=i)) for i, s in enumerate(seqs)], "vin long, arrival long, seq long, ts timestamp")
    out = jobs.replay_outcomes(df).toPandas()
    assert (out["outcome"] == "DUPLICATE").sum() == 50 and out[out["outcome"] != "DUPLICATE"]["seq"].nunique() == 200


def test_raw_shapes_agree(spark):
    a = '{"vehicle":{"vin":"1HGCM82633A004352"},"t":"2026-09-28T04:00:00Z","n":7,"evt":"PERIODIC","pos":{"la":1.0,"lo":2.0},"spd":40,"odo":9,"eng":{"coolantTempF":194.0,"rpm":900},"ign":true,"chg":false,"codes":["P0217","XX1"]}'
    b = '{"vehicle":{"vin":"1HGCM82633A004352"},"time":"2026-09-28T04:00:00Z","seqNo":7,"event":"PERIODIC","position":{"lat":1.0,"lon":2.0},"speedKmh":40,"odometerKm":9,"engine":{"coolant":{"tempC":90.0},"rpm":900},"ignition":true,"charging":false,"codes":["P0217","XX1"]}'
    c = '{"id":"1HGCM82633A004352","ts":1790568000000,"sq":7,"e":"P","g":[1.0,2.0],"s":40,"o":9,"ct":90.0,"ig":1,"ch":0,"dtc":"P0217|XX1","hb":-1}'
    bad = ["{", '{"x":1}', c.replace('"sq":7,', ""), c.replace("33A", "43A"), None, "[1]"]
    df = spark.createDataFrame([("t", 0, i, v) for i, v in enumerate([a, b, c, *bad])], "topic string, partition int, offset long, value string")
    good, dead = raw.split(df, families={"P0217": "COOLING"})
    rows = good.orderBy("offset").collect()
    assert len(rows) == 3
    for x in ("vin", "seq", "event_ts", "evt", "lat", "lon", "coolant_c", "ignition", "charging", "dtc", "fault_families", "event_id", "quality_flags"):
        assert rows[0][x] == rows[1][x] == rows[2][x], x
    assert rows[2]["harsh_brake"] is None and rows[0]["quality_flags"] == ["INVALID_DTC"]
    assert [r["error_code"] for r in dead.orderBy("offset").collect()] == ["MALFORMED_JSON", "UNKNOWN_SHAPE", "SCHEMA_INVALID", "INVALID_VIN", "MALFORMED_JSON", "MALFORMED_JSON"]


def test_waiting_cost_and_clues(spark):
    cost = lambda left, hazard, days: one(spark, V.waiting_cost(F.lit(left).cast("double"), F.lit(hazard), F.lit(days), 51_000))
    assert (cost(12.0, 0.05, 1), cost(None, 0.05, 1), cost(48.0, 0.05, 1), cost(12.0, 0.05, 0)) == (51_000, 2_550, 25_500, 0)
    clues = one(spark, V.level_clues(F.lit(97.0), F.lit(90.0), F.lit(4.0), F.lit(0.8), F.lit(5.2), "°C"))
    assert clues == ["7.0 °C above its own normal", "rising 0.8 °C an hour", "limit in 6 h"]
    assert one(spark, V.level_clues(F.lit(90.1), F.lit(90.0), F.lit(0.1), F.lit(0.0), F.lit(None).cast("double"), "°C")) == []


def test_average_precision(spark):
    df = spark.createDataFrame([("g", i, s, y) for i, (s, y) in enumerate(((0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0)))], "g string, id int, score double, label int")
    assert E.average_precision(df, ["g"]).first()["average_precision"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_most_similar_and_cosine(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id long, vector array<double>")
    got = C.most_similar(v.filter("id = 1"), v, 2).orderBy("rank").collect()
    assert [r["other_id"] for r in got] == [2, 3]


def test_guard_restarts_after_agreeing_readings():
    from teleflect.params import Detect

    u, normal = D.Unit(Metric(), Detect()), (90.0, 0.6, 0.0, 0.1)
    for i in range(20):
        u.step(i * 0.5, 90.0, normal)
    assert [u.step(10 + i * 0.5, 140.0, normal) is None for i in range(3)] == [True, True, True]
    assert u.last[1] == 140.0


def test_entry_without_corpus_operators(tmp_path):
    """The registry works without the llm subpackage and the pipeline."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "teleflect", tmp_path / "teleflect", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and not any(k.startswith('op') and k[2].isdigit() for k in e.queries()); assert 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_history_round_trip(spark, tmp_path):
    from teleflect.sources import files

    df = history(spark).withColumn("event_ts", F.col("ts"))
    files.write_history(df, str(tmp_path / "lake"))
    back = files.read_history(spark, str(tmp_path / "lake"))
    assert back.count() == df.count() and back.select("dt").distinct().count() >= 4


def test_errors_name_the_path(spark):
    good = {"id": "1HGCM82633A004352", "ts": 1790568000000, "sq": 7, "e": "P", "g": [1.0, 2.0], "s": 40, "o": 9, "ct": 90.0, "ig": 1, "ch": 0, "dtc": "P0217|XX1"}
    import json

    cases = {"sq": ("7", "sq is not a whole number of 0 or more"), "ig": (2, "ig is not 0 or 1"), "e": ("ZZ", "e is not a known event"), "ct": ("hot", "ct is not a number"), "g": (["x", 2.0], "g[0] is not a number"), "dtc": ([1], "dtc is not a text"), "id": (None, "id is not a text"), "s": (None, None), "hb": (1.5, "hb is not a whole number")}
    rows = [("t", 0, i, json.dumps(good | {k: v})) for i, (k, (v, _)) in enumerate(cases.items())] + [("t", 0, 90, '{"x": 1, "y": 2}'), ("t", 0, 91, "[]"), ("t", 0, 92, None), ("t", 0, 93, json.dumps(good | {"id": "1HGCM82643A004352"}))]
    _, dead = raw.split(spark.createDataFrame(rows, "topic string, partition int, offset long, value string"))
    got = {r["offset"]: r["error_detail"] for r in dead.collect()}
    for i, (_, said) in enumerate(cases.values()):
        assert got.get(i) == (said and f"SCHEMA_INVALID flat {said}")
    assert got[90] == "UNKNOWN_SHAPE no shape keys x y" and got[91] == got[92] == "MALFORMED_JSON no shape no JSON object" and got[93] == "INVALID_VIN flat identifier CHECK_DIGIT"
    nested = '{"vehicle":{"vin":"1HGCM82633A004352"},"time":"soon","seqNo":7,"event":"PERIODIC","position":{"lat":1.0,"lon":2.0},"speedKmh":40,"odometerKm":9,"ignition":true,"charging":false,"engine":{"coolant":{"tempC":"x"}}}'
    two = [nested, nested.replace('"soon"', '"2026-09-28T04:00:00Z"'), nested.replace('"soon"', '"2026-09-28T04:00:00Z"').replace('"x"', "7"), nested.replace('{"vin":"1HGCM82633A004352"}', "5")]
    rows = raw.decode(spark.createDataFrame([(i, x) for i, x in enumerate(two)], "i int, value string")).orderBy("i").collect()
    assert [r["detail"] for r in rows] == ["time is not an ISO 8601 time", "engine.coolant.tempC is not a number", None, "vehicle.vin is not a text"] and rows[2]["r"]["coolant_c"] == 7.0


def test_dimension_and_feature_files(spark, tmp_path):
    """CSV with a header: empty fields are null, types are those asked for; features survive their round trip, booleans in any spelling."""
    from teleflect.sources import files

    (tmp_path / "depots.csv").write_text('id,name,bays\n1,"North, 1",3\n2,,\n')
    got = [tuple(r) for r in files.read_dimension(spark, str(tmp_path / "depots.csv"), "id long, name string, bays int").orderBy("id").collect()]
    assert got == [(1, "North, 1", 3), (2, None, None)]
    df = spark.createDataFrame([(1, 0.25, True, "a"), (2, None, False, None), (3, 1.5, None, "b,c")], "vin long, x double, late boolean, kind string")
    files.export_features(df, str(tmp_path / "features"))
    assert all(p.suffix == ".gz" for p in (tmp_path / "features").glob("part-*"))
    back = files.read_features(spark, str(tmp_path / "features"), ("late",))
    assert sorted(map(tuple, back.collect())) == [(1, 0.25, True, "a"), (2, None, False, None), (3, 1.5, None, "b,c")]
    (tmp_path / "flags.csv").write_text("vin,ok\n1,t\n2,TRUE\n3,0\n4,1\n")
    assert [r["ok"] for r in files.read_features(spark, str(tmp_path / "flags.csv"), ("ok",)).orderBy("vin").collect()] == [True, True, False, True]


def test_reconcile_decodes_a_message_once(spark):
    """The counts read stored rows of judged: no message is parsed in their plan."""
    from teleflect.plans import queries as fleet_queries

    out = fleet_queries.reconcile_counts(spark, "/root/testdata/sf0.001")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    decoding = raw.split(fleet_queries.messages(spark, "/root/testdata/sf0.001"))[1]
    assert "__held" in plan(decoding) and "__held" not in plan(out)
    assert out.first()["difference"] == 0


def test_peers_trends_are_worked_out_once(spark):
    """Both medians come from one pass whose result is stored, so no trend is left in the plan of the rows."""
    from teleflect.params import Detect

    rows = [(v, "level", v * 10 + i, dt.datetime(2024, 1, 1, i), float(i + v), 1.0, 1.0, 0.0, 1.0) for v in range(6) for i in range(4)]
    df = spark.createDataFrame(rows, "vin long, metric string, seq long, ts timestamp, y double, median double, mad double, slope_median double, slope_mad double")
    veh = spark.createDataFrame([(v, 1, v % 2) for v in range(6)], "vin long, region_id long, duty_type_id long")
    out = D.with_peers(df, veh, Detect(min_peers=4, min_weight=1.0))
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.filter("peer_dev is not null").count() > 0


def test_composed_queries_read_events_once(spark):
    """Within one query of many others, messages are parsed and units listed once; outside, nothing is stored."""
    from teleflect.plans import fleet, queries

    sf, plan = "/root/testdata/sf0.001", lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    alone = fleet.readings(spark, sf)
    with fleet.shared():
        held = fleet.readings(spark, sf)
        assert fleet.readings(spark, sf) is held and fleet.registry(spark, sf) is fleet.registry(spark, sf)
        assert "get_json_object" in plan(alone) and "get_json_object" not in plan(held)
        risk = queries.at_risk_last4(spark, sf)
    assert "get_json_object" in plan(fleet.readings(spark, sf))
    assert sorted(map(tuple, held.collect()), key=str) == sorted(map(tuple, alone.collect()), key=str)
    assert sorted(map(tuple, risk.collect()), key=str) == sorted(map(tuple, queries.at_risk_last4(spark, sf).collect()), key=str)
    assert "get_json_object" not in plan(queries.QUERIES["detect_fold"](spark, sf))


def test_queue_with_reasons_reads_events_once(spark):
    from teleflect.plans import pages

    out = pages.queue_with_reasons(spark, "/root/testdata/sf0.001")
    assert "get_json_object" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == out.select("vin").distinct().count() > 0
