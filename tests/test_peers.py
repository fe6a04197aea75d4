"""Detection with the peers of the moment: the three folds against one plain loop, and the stream against the folds."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from teleflect.operators import detect as D
from teleflect.operators import peers as P
from teleflect.params import Detect, Metric
from teleflect.streaming import jobs

T0 = dt.datetime(2026, 9, 28, tzinfo=dt.timezone.utc)
METRICS = {"m": ("COOLING", Metric())}
SCHEMA = "vin long, seq long, ts timestamp, kind string, name string, y double, usual double, median double, mad double, slope_median double, slope_mad double, region_id long, duty_type_id long"
P4 = Detect(min_peers=4, min_weight=1.5)


def fleet(seed, vins=14, n=40, heat=6.0):
    """Units of one region in two duties (of which one is small) with a warm spell for all, a faulty one, a repair, codes, and gaps."""
    rnd, rows = random.Random(seed), []
    for v in range(vins):
        for i in range(n):
            h = i * 0.5 + rnd.random() * 0.3
            if rnd.random() < 0.1:
                continue
            y = 90.0 + rnd.gauss(0, 0.3) + (heat if 6 < h < 14 else 0) + (9 if v == 3 and h > 8 else 0)
            rows.append((2**60 + v, v * 1000 + i * 3, T0 + dt.timedelta(hours=h), "READING", "m", None if rnd.random() < 0.03 else y, 1.0, 90.0, 0.5, 0.0, 0.05, 1, 0 if v < 11 else 1))
        if v in (3, 5):
            rows.append((2**60 + v, v * 1000 + 91, T0 + dt.timedelta(hours=15.4), "REPAIR", "", None, None, None, None, None, None, 1, 0))
        if v == 6:
            rows += [(2**60 + v, v * 1000 + 1 + 6 * k, T0 + dt.timedelta(hours=k + 0.35), "CODES", "COOLING", 4.0, 1.0, None, None, None, None, 1, 0) for k in range(4)]
    return rows


def plain(rows, p, share=0.25):
    """One loop over all rows in order of time, with every unit's trends and a table of newest deviations for each scope."""
    trends, newest, cache, out, vehicles, repaired = {}, {}, {}, [], {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        vin, seq, ts, kind, name, y, usual, med, mad, smed, smad, region, duty = r
        us, answer = int(ts.timestamp() * 1e6 + 0.5), (None, None, None)
        if kind == "REPAIR":
            trends = {k: u for k, u in trends.items() if k[0] != vin}
            repaired[vin] = us
        if kind == "READING":
            found = None
            if y is not None and us >= repaired.get(vin, 0):
                u = trends.setdefault((vin, name), D.Unit(METRICS[name][1], p))
                if u.take(us / 3.6e9, y) and u.slow.n >= p.min_weight:
                    found = (u.slow.mean - med, (u.slow.slope or 0.0) - smed if u.slow.slope is not None else 0.0, u.fast.slope or 0.0)
            answers = []
            for scope in ((region, duty, name), (region, name)):
                own = newest.setdefault(scope, {})
                held = cache.setdefault(scope, {"hour": None, "since": 0, "x": None})
                if found:
                    own[vin] = (us, found)
                    held["since"] += 1
                if held["hour"] != us // P.HOUR or held["since"] >= max(2, share * len(own)):
                    for v in [v for v, (at, _) in own.items() if at < us - (p.peer_window_h + 24) * P.HOUR]:
                        del own[v]
                    near = [d for at, d in own.values() if abs(at - us) <= p.peer_window_h * P.HOUR]
                    held |= {"hour": us // P.HOUR, "since": 0, "x": tuple(statistics.median(c) for c in zip(*near)) if len(near) >= p.min_peers else None}
                answers.append(held["x"])
            answer = answers[0] or answers[1] or answer
        v = vehicles.setdefault(vin, D.Vehicle(METRICS, p))
        out += [x[:2] + x[3:] for x in D.vehicle_step(v, (vin, seq, us, kind, name, y, usual, med, mad, smed, smad, *answer))]
    return out


def key(rows):
    return sorted(repr(tuple(round(x, 7) if isinstance(x, float) else x for x in r)) for r in rows)


def without_ts(df):
    return [tuple(r[c] for c in df.columns if c != "ts") for r in df.collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_three_folds_are_one_loop(spark, seed):
    rows = fleet(seed)
    shuffled = rows[:]
    random.Random(seed).shuffle(shuffled)
    got = without_ts(P.detect_with_peers(spark.createDataFrame(shuffled, SCHEMA), METRICS, P4))
    assert key(got) == key(plain(rows, P4)) and len(got) > 300


def test_a_warm_spell_is_no_fault(spark):
    rows = fleet(3)
    opened = lambda d: {r["vin"] - 2**60 for r in d.collect() if r["action"] == "OPEN" and r["trigger"] == "SIGNAL"}
    with_peers = opened(P.detect_with_peers(spark.createDataFrame(rows, SCHEMA), METRICS, P4))
    alone = opened(D.detect_fold(spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(None).cast("double") for c in D.INPUT[11:]}), METRICS, P4))
    assert with_peers == {3} and len(alone) > 8


def test_peers_stream_is_the_batch(spark, tmp_path):
    rows = fleet(4)
    df, name = spark.createDataFrame(rows, SCHEMA), "spark.sql.streaming.stateStore.providerClass"
    for a, z in ((-1, 6), (6, 11.2), (11.2, 99)):
        df.filter((F.col("ts") > F.lit(T0 + dt.timedelta(hours=a))) & (F.col("ts") <= F.lit(T0 + dt.timedelta(hours=z)))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get(name)
    jobs.use_rocksdb(spark)
    try:
        s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        jobs.run_available(jobs.detect_with_peers_stream(s, METRICS, P4), str(tmp_path / "out"), str(tmp_path / "c"))
    finally:
        spark.conf.set(name, before)
    assert key(without_ts(spark.read.parquet(str(tmp_path / "out")))) == key(without_ts(P.detect_with_peers(df, METRICS, P4)))


def test_several_trends_in_one_sort(spark):
    rnd = random.Random(5)
    rows, t = [], 0.0
    for i in range(400):
        t += rnd.choice([0.2, 1, 7, 300 if i % 90 == 89 else 2])
        rows.append((i % 2, i, T0 + dt.timedelta(hours=t), 50 + rnd.gauss(0, 3)))
    df = spark.createDataFrame(rows, "vin long, seq long, ts timestamp, y double")
    both = D.weighted_trends(df, ["vin"], {"": 12.0, "_fast": 3.0})
    one = D.weighted_trend(df, ["vin"], 3.0).withColumnsRenamed({c: f"{c}_x" for c in ("weight", "mean", "slope")})
    lines = {}
    for r in both.join(one.select("seq", "weight_x", "mean_x", "slope_x"), "seq").orderBy("seq").collect():
        slow, fast = lines.setdefault(r["vin"], (D.Line(12.0), D.Line(3.0)))
        for line, suffix in ((slow, ""), (fast, "_fast"), (None, None)):
            if line is None:
                continue
            line.add((r["ts"].astimezone(dt.timezone.utc) - T0).total_seconds() / 3600, r["y"])
            assert r[f"weight{suffix}"] == pytest.approx(line.n, rel=1e-9) and r[f"mean{suffix}"] == pytest.approx(line.mean, rel=1e-9)
        assert (r["weight_fast"], r["mean_fast"]) == (pytest.approx(r["weight_x"]), pytest.approx(r["mean_x"]))
    with pytest.raises(ValueError, match="longest"):
        D.weighted_trends(df, ["vin"], {"": 100.0, "_fast": 3.0})
