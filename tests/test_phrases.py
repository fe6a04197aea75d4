"""Phrases by type: which hold, in which order, and what they say."""

import pytest
from pyspark.sql import functions as F

from teleflect.operators import campaigns as C
from teleflect.operators import phrases as S


def rows(spark, values, schema, phrases):
    return [(r["type"], r["text"], r["value"], r["unit"]) for r in spark.createDataFrame([values], schema).select(phrases.alias("x")).first()["x"]]


INCIDENT = "deviation double, normal double, unit string, slope double, slope_usual double, z_slope double, peer_level double, peers long, where string, calm double, hours_left double, hard_limit double, runaway boolean, code string, family string, codes24 long, codes_usual double, by_codes boolean"


def test_incident_clues(spark):
    full = (7.04, 90.0, "C", 0.456, 0.2, 1.5, 0.4, 12, "in the same duty", 0.75, 5.25, 110.0, True, "P0217", "COOLING", 4, 0.5, False)
    got = rows(spark, full, INCIDENT, S.incident_clues())
    assert [x[0] for x in got] == ["LEVEL", "SLOPE", "PEERS", "TIME_TO_LIMIT", "RUNAWAY", "DTC_RATE"]
    assert got[0][1:] == ("7.0 C above its usual 90.0 C", 7.04, "C") and got[1][1] == "moving up by 0.46 C an hour, 2.3 times its usual pace" and got[1][3] == "C/h"
    assert got[2][1] == "12 others in the same duty show no such shift" and got[3][1] == "5.3 h until 110.0 C at this pace" and got[5][1].startswith("4 COOLING codes within a day, last of them P0217; 0.5")
    calm = (-2.0, 12.5, "V", 0.456, 0.2, 1.49, -3.0, 12, "in the region", 0.75, None, 110.0, False, None, "LV", 0, None, False)
    got = rows(spark, calm, INCIDENT, S.incident_clues())
    assert [x[0] for x in got] == ["LEVEL", "PEERS"] and "below" in got[0][1] and got[1][1].startswith("12 others in the region are 3.0 V below")
    by_codes = (*full[:10], None, None, False, "P0217", "COOLING", 4, 0.5, True)
    assert [x[0] for x in rows(spark, by_codes, INCIDENT, S.incident_clues())] == ["DTC_RATE"]


QUEUE = f"incidents {S.INCIDENTS}, campaigns {S.CAMPAIGNS}, at_risk array<string>, not_fixed_day string, codes24 long, behaviour double, in_service boolean, booked string"


def test_queue_reasons_of_all_types(spark):
    bad = ("COOLING", "CRITICAL", True, "SIGNAL", "C", 110.0, 4.6, 9.0, 1.0, 2.0)
    critical = ("BATTERY", "CRITICAL", False, "SIGNAL", None, None, 4.0, None, None, None)
    codes = ("EXHAUST", "WARN", False, "CODE_RATE", None, None, None, None, None, None)
    rising = ("LV", "HIGH", False, "SIGNAL", "V", None, None, -0.5, 0.125, 1.5)
    plain = ("OTHER", "WARN", None, "SIGNAL", None, None, None, None, None, None)
    groups = [("MEMBER", "COOLING", "P1", 7, None, None), ("SISTER", "COOLING", "P1", 7, 2.0, "C"), ("SISTER", "LV", "P2", 3, None, None)]
    got = rows(spark, ([bad, critical, codes, rising, plain], groups, ["level"], "2026-09-01", 3, 1.5, True, "TODAY"), QUEUE, S.queue_reasons())
    assert [x[0] for x in got] == ["RUNAWAY", "RUNAWAY", "INCIDENT", "INCIDENT", "INCIDENT", "CAMPAIGN", "AT_RISK", "AT_RISK", "AT_RISK", "NOT_FIXED", "CODES", "BEHAVIOUR", "IN_SERVICE", "BOOKED"]
    said = [x[1] for x in got]
    assert said[0] == "out of hand: 5 h left until 110.0 C" and said[1] == "out of hand: BATTERY" and said[3] == "LV: 0.5 V below its usual, by 0.13 V more each hour" and said[4] == "OTHER: not as usual"
    assert said[6].endswith("of P1, 2.0 C above its usual") and said[7].endswith("campaign of P2") and said[-1] == "has a bay today"
    assert rows(spark, (None, None, None, None, 0, 1.4, False, None), QUEUE, S.queue_reasons()) == []


CAMPAIGN = "members long, model string, duty string, place string, family string, unit string, dev double, slope double, codes array<struct<code:string,vins:bigint>>, days long, lambda double, key_per_1000 double, regional_per_1000 double, version string, members_with long, sisters_with long, sisters long, shown boolean, cost double, cost_text string"


def test_campaign_clues_of_all_types(spark):
    full = (7, "M1", "D2", "P3", "COOLING", "C", 4.0, 0.2, [("P1", 4), ("P2", 1)], 2, 0.35, 10.0, 3.0, "v2", 6, 1, 20, True, 380_000.0, "3,80,000")
    got = rows(spark, full, CAMPAIGN, S.campaign_clues())
    assert [x[0] for x in got] == ["PLACE", "TREND", "CODES", "FIRMWARE", "SURPRISE", "REGION", "MONEY"]
    assert got[1][1].endswith("and gain 0.20 C an hour") and got[2][1:3] == ("codes in common: P1 (4), P2 (1)", 4.0) and "are well: 3.0 against 10.0" in got[5][1]
    poor = (7, "M1", "D2", "P3", "COOLING", "C", None, None, [], 1, 0.35, 10.0, 4.0, None, None, None, None, False, 0.0, None)
    got = rows(spark, poor, CAMPAIGN, S.campaign_clues())
    assert [x[0] for x in got] == ["PLACE", "SURPRISE", "REGION"] and "no rarer" in got[2][1]


def test_every_template_is_filled(spark):
    with pytest.raises(KeyError):
        S.worded("LEVEL", amount=F.lit(1))
    assert all(S.re.findall(r"\{(\w+)\}", t) or "{" not in t for t in S.TEXTS.values())


def test_rates_and_installs_in_their_windows(spark):
    import datetime as dt

    t = lambda d: dt.datetime(2026, 9, 1) + dt.timedelta(days=d)
    inc = spark.createDataFrame([("c", "p", 1, t(0)), ("c", "q", 2, t(0)), ("c", "q", 3, t(2)), ("c", "q", 3, t(2.5)), ("c", "q", 4, t(5)), ("d", "q", 9, t(2))], "k string, place string, vin long, ts timestamp_ntz")
    sizes = spark.createDataFrame([("c", "p", 10), ("c", "q", 20)], "k string, place string, vans long")
    asked = spark.createDataFrame([("c", "p", t(3)), ("c", "p", t(30)), ("c", "q", t(3)), ("c", "q", t(2.9))], "k string, place string, until timestamp_ntz")
    got = {(r["place"], r["until"]): (r["vins"], r["per_1000"]) for r in C.rate_in_window(inc, ["k"], "place", sizes, asked, 3).collect()}
    assert got == {("p", t(3)): (1, pytest.approx(1000 / 60)), ("p", t(30)): (0, 0.0), ("q", t(3)): (0, 0.0), ("q", t(2.9)): (1, pytest.approx(1000 / 30))}
    units = spark.createDataFrame([("g", 1, t(3)), ("g", 2, t(3)), ("g", 3, t(3))], "group string, vin long, first_ts timestamp_ntz")
    installs = spark.createDataFrame([(1, "a", t(0)), (1, "b", t(0.1)), (1, "c", t(3)), (1, "d", t(3.1)), (2, "a", t(0))], "vin long, version string, ts timestamp_ntz")
    assert {r["vin"]: r["version"] for r in C.installed_before(installs, units, "group").collect()} == {1: "c", 2: None, 3: None}
