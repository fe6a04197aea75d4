"""What is known of an incident, a campaign or a unit in the queue, as rows (type, text, value, unit).

Which rows hold is one matter, decided by columns; how they are worded is another, one table of templates. So readers
may sort and count by type and value, and a text may change without touching a rule.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .views import tenths

TEXTS = {
    # an incident
    "LEVEL": "{amount} {unit} {side} its usual {normal} {unit}",
    "SLOPE": "moving {way} by {amount} {unit} an hour, {times} times its usual pace",
    "PEERS_CALM": "{peers} others {where} show no such shift",
    "PEERS_SHIFTED": "{peers} others {where} are {amount} {unit} {side} their usual, which is taken off here",
    "TIME_TO_LIMIT": "{hours} h until {limit} {unit} at this pace",
    "RUNAWAY": "several readings in a row point past the limit",
    "DTC_RATE": "{count} {family} codes within a day, last of them {code}; {usual} a day are usual",
    # a place in the queue
    "Q_LIMIT": "out of hand: {hours} h left until {limit} {unit}",
    "Q_CRITICAL": "out of hand: {family}",
    "Q_CODES": "{family}: more codes than it usually sends",
    "Q_LEVEL": "{family}: {amount} {unit} {side} its usual",
    "Q_PLAIN": "{family}: not as usual",
    "Q_RISING": ", by {amount} {unit} more each hour",
    "Q_MEMBER": "one of {members} in the {family} campaign of {place}",
    "Q_SISTER": "sister of {members} units in the {family} campaign of {place}",
    "Q_SISTER_LEVEL": ", {amount} {unit} {side} its usual",
    "Q_RISK": "may be next: {reason}",
    "Q_NOT_FIXED": "still not right after the repair of {day}",
    "Q_CODES24": "{count} codes since this time yesterday",
    "Q_BEHAVIOUR": "driven {amount} times as harshly as its duty's middle",
    "Q_IN_SERVICE": "needed tomorrow",
    "Q_BOOKED": "has a bay {day}",
    # a campaign
    "PLACE": "{members} units of model {model} on duty {duty} in {place} share a {family} fault",
    "TREND": "half of them are {amount} {unit} or more {side} their usual",
    "TREND_RISING": " and gain {amount} {unit} an hour",
    "CODES": "codes in common: {codes}",
    "FIRMWARE": "{with_} of {members} run {version}, among sisters {sisters_with} of {sisters}",
    "REGION_CALM": "elsewhere the same units are well: {theirs} against {ours} incidents a thousand unit-days",
    "REGION_TOO": "elsewhere it is no rarer: {theirs} against {ours} incidents a thousand unit-days",
    "SURPRISE": "{members} within {days} d, when chance alone gives {expected}",
    "MONEY": "leaving it costs about {cost}",
}


def hundredths(x: Column) -> Column:
    """A number that is not negative with two decimals, a half goes up."""
    return (F.floor(x * 100 + 0.5 + 1e-7) / 100).cast("decimal(12,2)").cast("string")


def whole(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long").cast("string")


def side(x: Column) -> Column:
    return F.when(x >= 0, "above").otherwise("below")


def worded(template: str, **facts: Column) -> Column:
    """TEXTS[template] with columns in its places."""
    parts = [p for p in re.split(r"(\{\w+\})", TEXTS[template]) if p]
    return F.concat(*[facts[p[1:-1]].cast("string") if p.startswith("{") else F.lit(p) for p in parts])


def row(kind: str, text: Column, value: Column, unit: Column | str) -> Column:
    return F.struct(F.lit(kind).alias("type"), text.alias("text"), value.cast("double").alias("value"), (F.lit(unit) if isinstance(unit, str) else unit).alias("unit"))


def incident_clues() -> Column:
    """Rows from columns deviation, normal, unit, slope, slope_usual (how fast it moves as a rule), z_slope, peer_level, peers, where, calm (a shift of peers below this is none), hours_left, hard_limit, runaway, code, family, codes24, codes_usual, by_codes."""
    c = F.col
    peer = F.when(F.abs("peer_level") < c("calm"), worded("PEERS_CALM", peers=c("peers"), where=c("where"))).otherwise(worded("PEERS_SHIFTED", peers=c("peers"), where=c("where"), amount=tenths(F.abs("peer_level")), unit=c("unit"), side=side(c("peer_level"))))
    way = F.when(c("slope") >= 0, "up").otherwise("down")
    return F.array_compact(
        F.array(
            F.when(~c("by_codes") & c("deviation").isNotNull(), row("LEVEL", worded("LEVEL", amount=tenths(F.abs("deviation")), unit=c("unit"), side=side(c("deviation")), normal=tenths(F.abs("normal"))), c("deviation"), c("unit"))),
            F.when(~c("by_codes") & c("slope").isNotNull() & (c("z_slope") >= 1.5), row("SLOPE", worded("SLOPE", way=way, amount=hundredths(F.abs("slope")), unit=c("unit"), times=tenths(F.abs("slope") / c("slope_usual"))), c("slope"), F.concat("unit", F.lit("/h")))),
            F.when(~c("by_codes") & (c("peers") > 0), row("PEERS", peer, c("peer_level"), c("unit"))),
            F.when(c("hours_left").isNotNull() & c("hard_limit").isNotNull(), row("TIME_TO_LIMIT", worded("TIME_TO_LIMIT", hours=tenths(c("hours_left")), limit=tenths(c("hard_limit")), unit=c("unit")), c("hours_left"), "h")),
            F.when(c("runaway"), row("RUNAWAY", worded("RUNAWAY"), F.coalesce("hours_left", F.lit(0.0)), "h")),
            F.when(c("by_codes") | (c("codes24") > 0), row("DTC_RATE", worded("DTC_RATE", count=c("codes24"), family=c("family"), code=c("code"), usual=tenths(c("codes_usual"))), c("codes24"), "codes/24h")),
        )
    )


def _incident_reason(i: Column) -> Column:
    known = i["deviation"].isNotNull() & i["unit"].isNotNull()
    limit = i["hours_left"].isNotNull() & i["hard_limit"].isNotNull()
    bad = F.coalesce(i["runaway"], F.lit(False)) | (i["severity"] == "CRITICAL")
    rising = F.when(known & (i["slope"] > 0) & (i["z_slope"] >= 1.5), worded("Q_RISING", amount=hundredths(i["slope"]), unit=i["unit"])).otherwise("")
    level = F.when(known, worded("Q_LEVEL", family=i["family"], amount=tenths(F.abs(i["deviation"])), unit=i["unit"], side=side(i["deviation"]))).otherwise(worded("Q_PLAIN", family=i["family"]))
    critical = F.when(limit, worded("Q_LIMIT", hours=whole(i["hours_left"]), limit=tenths(i["hard_limit"]), unit=i["unit"])).otherwise(worded("Q_CRITICAL", family=i["family"]))
    return F.when(bad, row("RUNAWAY", critical, i["hours_left"], "h")).when(i["trigger"] == "CODE_RATE", row("INCIDENT", worded("Q_CODES", family=i["family"]), F.lit(None), "")).otherwise(row("INCIDENT", F.concat(level, rising), i["deviation"], F.coalesce(i["unit"], F.lit(""))))


def _campaign_reason(g: Column) -> Column:
    level = F.when(g["deviation"].isNotNull() & g["unit"].isNotNull(), worded("Q_SISTER_LEVEL", amount=tenths(F.abs(g["deviation"])), unit=g["unit"], side=side(g["deviation"]))).otherwise("")
    facts = {"members": g["members"], "family": g["family"], "place": g["place"]}
    return F.when(g["role"] == "MEMBER", row("CAMPAIGN", worded("Q_MEMBER", **facts), g["members"], "units")).otherwise(row("AT_RISK", F.concat(worded("Q_SISTER", **facts), level), g["members"], "units"))


#: Types of the two lists that queue_reasons reads.
INCIDENTS = "array<struct<family:string,severity:string,runaway:boolean,trigger:string,unit:string,hard_limit:double,hours_left:double,deviation:double,slope:double,z_slope:double>>"
CAMPAIGNS = "array<struct<role:string,family:string,place:string,members:bigint,deviation:double,unit:string>>"


def queue_reasons() -> Column:
    """Rows of all nine types, in order, from a queue row: incidents (INCIDENTS), campaigns (CAMPAIGNS), at_risk (list of texts), not_fixed_day, codes24, behaviour, in_service, booked."""
    c = F.col
    none = lambda x, kind: F.coalesce(x, F.array().cast(kind))
    risks = F.transform(none(c("at_risk"), "array<string>"), lambda r: row("AT_RISK", worded("Q_RISK", reason=r), F.lit(None), ""))
    rest = F.array_compact(
        F.array(
            F.when(c("not_fixed_day").isNotNull(), row("NOT_FIXED", worded("Q_NOT_FIXED", day=c("not_fixed_day")), F.lit(None), "")),
            F.when(c("codes24") > 0, row("CODES", worded("Q_CODES24", count=c("codes24")), c("codes24"), "codes/24h")),
            F.when(c("behaviour") >= 1.5, row("BEHAVIOUR", worded("Q_BEHAVIOUR", amount=tenths(c("behaviour"))), c("behaviour"), "x")),
            F.when(c("in_service"), row("IN_SERVICE", worded("Q_IN_SERVICE"), F.lit(None), "")),
            F.when(c("booked").isNotNull(), row("BOOKED", worded("Q_BOOKED", day=F.lower("booked")), F.lit(None), "")),
        )
    )
    return F.concat(F.transform(none(c("incidents"), INCIDENTS), _incident_reason), F.transform(none(c("campaigns"), CAMPAIGNS), _campaign_reason), risks, rest)


def campaign_clues() -> Column:
    """Rows of all seven types from a campaign row: members, model, duty, place, family, unit, dev, slope, codes (list of struct code, vins), days, lambda, key_per_1000, regional_per_1000, version, members_with, sisters_with, sisters, shown, cost."""
    c = F.col
    rising = F.when(c("slope") > 0, worded("TREND_RISING", amount=hundredths(c("slope")), unit=c("unit"))).otherwise("")
    codes = F.array_join(F.transform("codes", lambda x: F.concat(x["code"], F.lit(" ("), x["vins"].cast("string"), F.lit(")"))), ", ")
    rates = {"theirs": tenths(c("regional_per_1000")), "ours": tenths(c("key_per_1000"))}
    return F.array_compact(
        F.array(
            row("PLACE", worded("PLACE", **{k: c(k) for k in ("members", "model", "duty", "place", "family")}), c("members"), "units"),
            F.when(c("dev").isNotNull(), row("TREND", F.concat(worded("TREND", amount=tenths(F.abs("dev")), unit=c("unit"), side=side(c("dev"))), rising), c("dev"), c("unit"))),
            F.when(F.size("codes") > 0, row("CODES", worded("CODES", codes=codes), F.get("codes", F.lit(0))["vins"], "units")),
            F.when(c("shown"), row("FIRMWARE", worded("FIRMWARE", with_=c("members_with"), members=c("members"), version=c("version"), sisters_with=c("sisters_with"), sisters=c("sisters")), c("members_with"), "units")),
            row("SURPRISE", worded("SURPRISE", members=c("members"), days=c("days"), expected=tenths(c("lambda"))), c("members"), "units"),
            row("REGION", F.when(c("regional_per_1000") * 3 < c("key_per_1000"), worded("REGION_CALM", **rates)).otherwise(worded("REGION_TOO", **rates)), c("regional_per_1000"), "per 1,000 unit-days"),
            F.when(c("cost") > 0, row("MONEY", worded("MONEY", cost=c("cost_text")), c("cost"), "")),
        )
    )
