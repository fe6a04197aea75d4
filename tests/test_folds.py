"""Folds, intake and campaign books against plain loops: ids beyond 2^53 beside nulls, null keys, counters that start anew, random actions, streams as batches."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from teleflect.operators import campaigns as C
from teleflect.operators import intake as I
from teleflect.operators import queue as Q
from teleflect.operators.folds import ordered_fold
from teleflect.params import Campaign
from teleflect.streaming import jobs

T0 = dt.datetime(2026, 9, 28, tzinfo=dt.timezone.utc)
ACTIONS = "family_key string, seq long, ts timestamp, kind string, vin long, runaway boolean, vans int, per_1000 double"
MESSAGES = "vin long, arrival long, seq long, ts timestamp, odo_km double, soc_pct double, driving boolean, engine boolean"


def at(hours):
    return T0 + dt.timedelta(hours=hours)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def streamed(spark, df, tmp_path, cuts, order="arrival"):
    """df as a stream whose batches end at the given places of `order`."""
    for i, (a, z) in enumerate(zip([-1, *cuts], [*cuts, 1 << 60])):
        df.filter((F.col(order) > a) & (F.col(order) <= z)).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}.parquet"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def landed(spark, stream, tmp_path, name="out"):
    jobs.run_available(stream, str(tmp_path / name), str(tmp_path / f"{name}-c"))
    return spark.read.parquet(str(tmp_path / name))


# ---- exact values


def test_large_ids_beside_nulls(spark):
    """A null in a column of longs must not turn its neighbours into floats."""
    rows = [("k", i, at(i), "INCIDENT", 2**60 + i, False, 5, 0.0) for i in range(4)] + [("k", 9, at(9), "DISMISS", None, None, 5, 0.0)]
    got = [(r["kind"], r["members"]) for r in C.campaign_fold(spark.createDataFrame(rows, ACTIONS), Campaign(min_vans=2, alpha=0.5)).collect()]
    assert got == [("OPENED", 2), ("GREW", 3), ("GREW", 4), ("DISMISSED", 4)]


def test_a_null_key_is_one_key(spark):
    df = spark.createDataFrame([(None, i, None) for i in range(3)] + [(2**60 + 1, 5, 2**61 + 1), (2**60 + 1, 6, None)], "k long, i long, v long")
    out = ordered_fold(df, ["k"], ["i"], lambda r: [0], lambda s, r: (s.__setitem__(0, s[0] + 1), [(r[0], s[0], r[2])])[1], "k long, n long, v long")
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, [(None, 1, None), (None, 2, None), (None, 3, None), (2**60 + 1, 1, 2**61 + 1), (2**60 + 1, 2, None)]))


def test_folds_of_nothing(spark):
    assert C.campaign_fold(spark.createDataFrame([], ACTIONS)).count() == 0 == I.intake(spark.createDataFrame([], MESSAGES)).count()


# ---- intake


def plain_intake(rows):
    """The rules in one loop over one unit's messages, with a set for what was seen."""
    seen, most, newest, last, out = set(), None, None, None, []
    for _, _, seq, ts, odo, soc, driving, engine in rows:
        flags = []
        if most is None or seq > most:
            most = seq
        elif most - seq < 1024:
            if seq in seen:
                continue
            flags = ["OUT_OF_ORDER"]
        elif ts > newest:
            flags, most, seen, last = ["SEQ_RESET"], seq, set(), None
            newest = ts
        else:
            flags = ["LATE"]
        newest = ts if newest is None or ts > newest else newest
        if "LATE" not in flags:
            seen.add(seq)
        if last is not None and seq <= last["seq"]:
            out.append((seq, odo, soc, ",".join(flags)))
            continue
        own = []
        if last and odo is not None and last["odo"] is not None and odo < last["odo"] - 0.01:
            odo = None
            own.append("ODOMETER_BACKWARDS")
        if last and driving and not engine and last["driving"] and soc is not None and last["soc"] is not None and soc > last["soc"] + 0.5:
            soc = None
            own.append("SOC_RISING_WHILE_DRIVING")
        before = last or {"odo": None, "soc": None}
        last = {"seq": seq, "odo": before["odo"] if odo is None else odo, "soc": before["soc"] if soc is None else soc, "driving": driving}
        out.append((seq, odo, soc, ",".join(own + flags)))
    return out


def messages(seed, vin, n=400):
    """Counters that start anew, repeats, late and very old messages, values that jump, nulls."""
    rnd, out, seq = random.Random(seed), [], 5000
    for i in range(n):
        seq = rnd.choice([0, 10, 3]) if seq > 2000 and rnd.random() < 0.02 else seq + rnd.choice([1, 1, 1, 2, 40])
        send = rnd.choice([seq] * 8 + [max(0, seq - rnd.randint(0, 60)), max(0, seq - 3000)])
        back = rnd.choice([0] * 9 + [5])
        out.append((vin, i, send, at(i * 0.1 - back), rnd.choice([None, 100.0 + i, 100.0 + i, 99.0 + i - rnd.choice([0, 50])]), rnd.choice([None, 80 - i * 0.05, 80 - i * 0.05 + rnd.choice([0, 0.4, 5])]), rnd.random() < 0.8, rnd.random() < 0.1))
    return out


def test_intake_is_a_plain_loop(spark):
    rows = [messages(s, 2**60 + s) for s in range(6)]
    got = {}
    for r in I.intake(spark.createDataFrame([x for own in rows for x in own], MESSAGES)).collect():
        got.setdefault(r["vin"], []).append((r["seq"], r["odo_km"], r["soc_pct"], r["flags"]))
    for own in rows:
        assert got[own[0][0]] == plain_intake(own)
    flags = {f for own in got.values() for x in own for f in x[3].split(",")}
    assert flags >= {"SEQ_RESET", "OUT_OF_ORDER", "LATE", "ODOMETER_BACKWARDS", "SOC_RISING_WHILE_DRIVING"}


def test_a_counter_that_starts_anew_is_checked_again(spark):
    rows = [(1, i, s, at(i), odo, None, True, False) for i, (s, odo) in enumerate([(5000, 900.0), (1, 501.0), (2, 400.0), (3, 90.0), (4, 600.0)])]
    got = [(r["seq"], r["odo_km"], r["flags"]) for r in I.intake(spark.createDataFrame(rows, MESSAGES)).collect()]
    assert got == [(5000, 900.0, ""), (1, 501.0, "SEQ_RESET"), (2, None, "ODOMETER_BACKWARDS"), (3, None, "ODOMETER_BACKWARDS"), (4, 600.0, "")]


def test_intake_stream_is_the_batch(rocks, tmp_path):
    df = rocks.createDataFrame(messages(3, 7) + messages(4, 2**60 + 8), MESSAGES)
    s = streamed(rocks, df, tmp_path, [100, 101, 260])
    key = lambda d: sorted(map(repr, (tuple(r) for r in d.collect())))
    assert key(landed(rocks, jobs.intake_stream(s), tmp_path)) == key(I.intake(df))


def test_clock_stream_is_a_plain_ring(rocks, tmp_path):
    from teleflect.operators import checks as K

    rnd = random.Random(2)
    rows = [(src, i, 1000 * i + rnd.randint(0, 500) + (700_000 if i % 37 == 5 else 0), 1000 * i) for i in range(700) for src in "ab"]
    df = rocks.createDataFrame(rows, "source string, arrival long, event_ms long, ingest_ms long")
    got = landed(rocks, jobs.clock_stream(streamed(rocks, df, tmp_path, [63, 64, 300])), tmp_path)
    want = K.clock_ahead(df, ["source"], "arrival", "event_ms", "ingest_ms")
    key = lambda d: sorted(map(repr, (tuple(r) for r in d.select("source", "arrival", "ahead").collect())))
    assert key(got) == key(want)


# ---- campaigns and bookings on random input


def plain_book(rows, p, vans, per_1000):
    """The rules over plain dictionaries, each action looking at every group."""
    groups, out = [], []

    def chance(g):
        rate = vans * (max(g["days"]) - min(g["days"]) + 1) * p.bucket_h / 24 * max(p.floor_per_1000, per_1000) / 1000
        n = len(g["vins"])
        return n, 1 - sum(math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(n))

    for _, _, ts, kind, vin, runaway, _, _ in rows:
        home = [g for g in groups if vin in g["vins"]]
        if kind == "INCIDENT":
            day = int(ts.timestamp() // (p.bucket_h * 3600))
            grew = not home
            if home:
                g = home[0]
                if not runaway or vin in g["bad"]:
                    continue
            else:
                met = sorted((g for g in groups if min(g["days"]) - 1 <= day <= max(g["days"]) + 1), key=lambda g: min(g["days"]))
                if not met:
                    met = [{"days": set(), "vins": set(), "bad": set(), "fixed": set(), "status": "WATCHING", "at": None, "worse": False}]
                    groups.append(met[0])
                g = met[0]
                for other in met[1:]:
                    if other["status"] == "DISMISSED" != g["status"]:
                        g["status"], g["at"], g["worse"] = "DISMISSED", other["at"], other["worse"]
                    elif (other["status"], g["status"]) == ("OPEN", "WATCHING"):
                        g["status"] = "OPEN"
                    for part in ("days", "vins", "bad", "fixed"):
                        g[part] |= other[part]
                    groups.remove(other)
                    out.append(("MERGED", 0))
                g["days"].add(day)
                g["vins"].add(vin)
            if runaway:
                g["bad"].add(vin)
                g["worse"] |= g["status"] == "DISMISSED"
            n, prob = chance(g)
            if g["status"] == "WATCHING" and n >= p.min_vans and prob < p.alpha:
                g["status"] = "OPEN"
                out.append(("OPENED", n))
            elif g["status"] == "OPEN" and grew:
                out.append(("GREW", n))
            elif g["status"] == "DISMISSED" and (g["worse"] or n >= g["at"] + p.reraise_abs or n >= math.ceil(g["at"] * (1 + p.reraise_pct / 100))):
                g["status"] = "OPEN"
                out.append(("REOPENED", n))
        elif kind == "DISMISS":
            for g in sorted(groups, key=lambda g: min(g["days"])):
                if g["status"] != "DISMISSED":
                    g["status"], g["at"], g["worse"] = "DISMISSED", len(g["vins"]), False
                    out.append(("DISMISSED", len(g["vins"])))
        elif home and (vin in home[0]["fixed"]) != (kind == "FIXED"):
            g = home[0]
            g["fixed"] ^= {vin}
            if g["status"] != "WATCHING":
                if g["fixed"] == g["vins"]:
                    groups.remove(g)
                    out.append(("CLOSED", len(g["vins"])))
                else:
                    out.append(("FIX_PROGRESS", len(g["vins"])))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_campaign_fold_is_a_plain_loop(spark, seed):
    rnd, p = random.Random(seed), Campaign(min_vans=3, alpha=0.2)
    rows, t = [], 0.0
    for i in range(300):
        t += rnd.choice([0.2, 2, 9, 60])
        kind = rnd.choice(["INCIDENT"] * 8 + ["DISMISS", "FIXED", "FIXED", "NOT_FIXED"])
        rows.append(("k", i, at(t + rnd.choice([0, 0, 0, -100]) * (kind == "INCIDENT")), kind, None if kind == "DISMISS" else 2**60 + rnd.randint(0, 25), rnd.random() < 0.1, 40, 0.5))
    rows.sort(key=lambda r: (r[2], r[1]))
    got = [(r["kind"], r["members"]) for r in C.campaign_fold(spark.createDataFrame(rows, ACTIONS), p).collect()]
    assert got == plain_book(rows, p, 40, 0.5) and len({k for k, _ in got}) >= 5


def test_late_buckets_join_groups(spark):
    """Actions come in any order of buckets: one between two groups joins them."""
    book, out = C.Book(Campaign(min_vans=3, alpha=0.9), 60, 0.1), []
    for day, vin in ((10, 1), (13, 2), (16, 3), (12, 4), (14, 5), (15, 6)):
        out += [(e[1], e[3]) for e in book.incident(vin, day, 0)]
    assert out == [("OPENED", 3), ("GREW", 4), ("MERGED", 0), ("GREW", 6)] or [k for k, _ in out].count("MERGED") >= 1
    assert [(g.first, g.last) for g in book.groups] == [(10, 10), (12, 16)]


def test_a_member_elsewhere_stays_there(spark):
    rows = [("a", 1, at(0), "INCIDENT", 5, False, 9, 0.0), ("b", 2, at(1), "INCIDENT", 5, False, 9, 0.0), ("b", 3, at(2), "INCIDENT", 6, False, 9, 0.0)]
    acts = C.joined_first(spark.createDataFrame(rows, ACTIONS))
    assert {(r["family_key"], r["vin"]): r["elsewhere"] for r in acts.collect()} == {("a", 5): False, ("b", 5): True, ("b", 6): False}
    got = [(r["family_key"], r["members"]) for r in C.campaign_fold(acts, Campaign(min_vans=1, alpha=0.99)).collect()]
    assert sorted(got) == [("a", 1), ("b", 1)]


def test_campaign_stream_is_the_batch(rocks, tmp_path):
    rnd, rows = random.Random(8), []
    for i in range(200):
        rows.append((rnd.choice("ab"), i, at(i * 3), rnd.choice(["INCIDENT"] * 6 + ["DISMISS", "FIXED"]), rnd.choice([None, 2**60 + rnd.randint(0, 9)]), False, 40, 0.5))
    p = Campaign(min_vans=2, alpha=0.5)
    df = rocks.createDataFrame(rows, ACTIONS)
    s = C.actions_in_order(streamed(rocks, df, tmp_path, [50, 120], "seq"))
    out = jobs.fold_stream(s, ["family_key"], ["ts", "seq"], lambda r: C.Book(p, int(r[6]), float(r[7])), C.book_step, C.EVENTS)
    key = lambda d: sorted(map(repr, (tuple(r) for r in d.collect())))
    assert key(landed(rocks, out, tmp_path)) == key(C.campaign_fold(df, p))


@pytest.mark.parametrize("seed", range(3))
def test_bookings_are_a_plain_loop(spark, seed):
    rnd, rows = random.Random(seed), []
    for depot in (1, 2**60 + 1):
        for i in range(40):
            rows.append((depot, 2**60 + i, i, rnd.random() < 0.15, rnd.random() < 0.6, rnd.choice([None, None, None, "TODAY", "TOMORROW"]), 5))
    want = {}
    for depot in (1, 2**60 + 1):
        left = {"TODAY": 5, "TOMORROW": 5}
        wish = lambda r: {"TODAY": 0, "TOMORROW": 1}.get(r[5], 2)
        for r in sorted((r for r in rows if r[0] == depot), key=lambda r: (0 if r[3] else 1 + wish(r), 0 if r[5] == "TODAY" else 1 if r[5] else 2, r[2])):
            days = ["TODAY", "TOMORROW"] if r[3] or r[5] == "TODAY" or (r[4] and not r[5]) else ["TOMORROW"] if r[5] else []
            day = next((d for d in days if left[d]), "WAITING")
            left[day] = left.get(day, 0) - 1
            want[depot, r[1]] = day
    q = spark.createDataFrame(rows, "depot_id long, vin long, rank int, pinned boolean, eligible boolean, booking string, per_day int")
    assert {(r["depot_id"], r["vin"]): r["slot"] for r in Q.place_bookings(q).collect()} == want
