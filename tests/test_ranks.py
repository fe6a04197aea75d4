"""Running totals over ranges, counts in cut windows: against plain loops, with one key that has nearly all rows."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from teleflect.operators import evaluate as E
from teleflect.operators import joins as J
from teleflect.operators import learn as L
from teleflect.operators.ranks import ranked, running_totals

T0 = dt.datetime(2026, 9, 28, tzinfo=dt.timezone.utc)


@pytest.mark.parametrize("parts", [1, 7])
def test_running_totals(spark, parts):
    rnd = random.Random(parts)
    rows = [(rnd.choice(["hot"] * 9 + ["cold", None]), i, rnd.randint(-3, 9)) for i in range(500)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, x long")
    want, sums, counts = {}, {}, {}
    for k, i, x in sorted(rows, key=lambda r: -r[1]):
        sums[k], counts[k] = sums.get(k, 0) + x, counts.get(k, 0) + 1
        want[i] = (sums[k], counts[k])
    got = running_totals(df, ["k"], [F.desc("i")], {"s": F.col("x"), "n": F.lit(1)}, parts)
    assert {r["i"]: (r["s"], r["n"]) for r in got.collect()} == want
    assert sorted(r["rank"] for r in ranked(df, [], [F.col("i")], parts=parts).collect()) == list(range(1, 501))
    assert ranked(df.limit(0), ["k"], [F.col("i")], parts=parts).count() == 0


def test_average_precision_spread_is_the_window(spark):
    rnd = random.Random(4)
    df = spark.createDataFrame([(rnd.choice("ab"), i, rnd.choice([0.0, round(rnd.random(), 2)]), rnd.randint(0, 1)) for i in range(900)], "g string, id int, score double, label int")
    a, b = ({r["g"]: r["average_precision"] for r in E.average_precision(df, ["g"], spread=s).collect()} for s in (False, True))
    assert a == {k: pytest.approx(v, rel=1e-12) for k, v in b.items()} and len(a) == 2


def test_permuted_deals_each_value_once(spark):
    df = spark.createDataFrame([(i % 5, i % 3) for i in range(200)], "a int, b int")
    out = L.permuted(df, "a", 7).collect()
    assert sorted(r["a"] for r in out) == sorted(i % 5 for i in range(200)) and sorted(r["b"] for r in out) == sorted(i % 3 for i in range(200))
    assert sum((r["a"], r["b"]) != (i % 5, i % 3) for i, r in enumerate(out)) > 50


def test_counts_in_a_cut_window(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice(["hot"] * 9 + ["x"]), i, T0 + dt.timedelta(seconds=rnd.choice([rnd.randint(0, 500_000), 86_400 * rnd.randint(0, 5)])), rnd.random() < 0.4) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, i long, ts timestamp, e boolean")
    got = {r["i"]: r["n"] for r in J.counts_in_window(df, ["k"], "ts", F.col("e"), 86_400, 3600, "n").collect()}
    us = lambda t: (t - T0) // dt.timedelta(microseconds=1)
    want = {i: sum(e and a == k and j != i and -86_400_000_000 < us(u) - us(t) <= 3_600_000_000 for a, j, u, e in rows) for k, i, t, _ in rows}
    assert got == want


def test_counts_in_a_window_without_time_or_kind(spark):
    """A row without a time is in no window and has none in its own; one of unknown kind has not the event, and counts what is around it."""
    rows = [("k", 0, T0, True), ("k", 1, T0, None), ("k", 2, None, True), ("k", 3, None, False), ("k", 4, T0 + dt.timedelta(minutes=5), False)]
    df = spark.createDataFrame(rows, "k string, i long, ts timestamp, e boolean")
    got = {r["i"]: r["n"] for r in J.counts_in_window(df, ["k"], "ts", F.col("e"), 86_400, 3600, "n").collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0, 4: 1}


def test_counts_in_a_full_window(spark):
    """Work grows with the rows, not with rows times those in a window: 400,000 rows of one key at times of their own, within a day."""
    n = 400_000
    ts = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 100_000)
    began = time.time()
    out = J.counts_in_window(spark.range(n).select("id", F.lit("hot").alias("k"), ts.alias("ts")), ["k"], "ts", F.col("id") % 2 == 0, 86_400, 3600, "n")
    after = F.least(F.col("id") + 36_000, F.lit(n - 1))  # the last row within an hour
    want = F.floor(after / 2) + 1 - F.when(F.col("id") % 2 == 0, 1).otherwise(0)
    assert out.filter(F.col("n") == want).count() == n and time.time() - began < 60
