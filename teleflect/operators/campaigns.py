"""Incidents that share a cause: touching buckets, chance tests, comparisons with sisters, and the ordered fold of a key's book."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import bucket, poisson_tail
from ..params import Campaign
from .folds import ordered_fold


def touching_groups(incidents: DataFrame, key: str, bucket_col: str) -> DataFrame:
    """key, grp, first_bucket, last_bucket, members: day buckets of a key at most one apart form one group."""
    days = incidents.select(key, F.col(bucket_col).alias("b")).distinct()
    w = Window.partitionBy(key).orderBy("b")
    new = F.when(F.col("b") - F.lag("b").over(w) <= 1, 0).otherwise(1)
    days = days.withColumn("new", new).withColumn("grp", F.sum("new").over(w)).drop("new")
    return incidents.join(days.withColumnRenamed("b", bucket_col), [key, bucket_col]).groupBy(key, "grp").agg(
        F.min(bucket_col).alias("first_bucket"), F.max(bucket_col).alias("last_bucket"), F.countDistinct("vin").alias("members"))


def chance(groups: DataFrame, p: Campaign = Campaign()) -> DataFrame:
    """groups(members, first_bucket, last_bucket, vans, baseline_per_1000, regional_per_1000) with lambda, its source, p_value and whether it opens."""
    days = (F.col("last_bucket") - F.col("first_bucket") + 1) * (p.bucket_h / 24)
    floor, base, regional = F.lit(p.floor_per_1000), F.coalesce("baseline_per_1000", F.lit(0.0)), F.coalesce("regional_per_1000", F.lit(0.0))
    rate = F.greatest(floor, base, regional)
    source = F.when(rate == floor, "floor").when(rate == base, "baseline").otherwise("regional")
    out = groups.withColumns({"lambda": F.col("vans") * F.greatest(days, F.lit(0.0)) * rate / 1000, "rate_source": source})
    out = out.withColumn("p_value", poisson_tail(F.col("members"), F.col("lambda")))
    return out.withColumn("opens", (F.col("members") >= p.min_vans) & (F.col("p_value") < p.alpha))


def rate_elsewhere(incidents: DataFrame, cohort: list[str], place: str, sizes: DataFrame, days: float) -> DataFrame:
    """cohort, place, vins, per_1000: distinct units with incidents of the cohort in all other places, per 1,000 unit-days there. sizes(cohort, place, vans).

    A unit belongs to one place, so the rest is the total minus the place's own.
    """
    own = incidents.groupBy(*cohort, place).agg(F.countDistinct("vin").alias("own"))
    both = sizes.join(own, [*cohort, place], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    w = Window.partitionBy(*cohort)
    other, vans = F.sum("own").over(w) - F.col("own"), F.sum("vans").over(w) - F.col("vans")
    out = both.select(*cohort, place, other.alias("vins"), vans.alias("other_vans"))
    return out.withColumn("per_1000", F.when(F.col("other_vans") > 0, F.lit(1000.0) * F.col("vins") / (F.col("other_vans") * days)).otherwise(0.0))


def rate_in_window(incidents: DataFrame, cohort: list[str], place: str, sizes: DataFrame, asked: DataFrame, days: int) -> DataFrame:
    """asked(cohort, place, until) with vins, other_vans and per_1000: distinct units with incidents of the cohort in other places in (until - days, until], per 1,000 unit-days there (0 without units).

    A question meets the incidents of its cohort by day, so it reads the days of its window and no others.
    """
    day = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 86_400_000_000).cast("long")
    rows = incidents.select(*cohort, F.col(place).alias("__place"), "vin", F.col("ts").alias("__ts"), day("ts").alias("__day"))
    each = asked.select(*cohort, place, "until").distinct().withColumn("__day", F.explode(F.sequence(day("until") - days, day("until"))))
    span = F.expr(f"INTERVAL {days} DAYS")
    met = each.join(rows, [*cohort, "__day"]).filter((F.col("__place") != F.col(place)) & (F.col("__ts") > F.col("until") - span) & (F.col("__ts") <= F.col("until")))
    seen = met.groupBy(*cohort, place, "until").agg(F.countDistinct("vin").alias("vins"))
    other = (F.sum("vans").over(Window.partitionBy(*cohort)) - F.col("vans")).alias("other_vans")
    out = asked.join(sizes.select(*cohort, place, other), [*cohort, place], "left").join(seen, [*cohort, place, "until"], "left").withColumns({"vins": F.coalesce("vins", F.lit(0).cast("long")), "other_vans": F.coalesce("other_vans", F.lit(0).cast("long"))})
    return out.withColumn("per_1000", F.when(F.col("other_vans") > 0, F.lit(1000.0) * F.col("vins") / (F.col("other_vans") * days)).otherwise(0.0))


def installed_before(installs: DataFrame, units: DataFrame, group: str, days: int = 3) -> DataFrame:
    """units(group, vin, first_ts) with version: that of the unit's newest install in (first_ts - days, first_ts], null where there is none. installs(vin, version, ts)."""
    near = units.join(installs, "vin").filter((F.col("ts") > F.col("first_ts") - F.expr(f"INTERVAL {days} DAYS")) & (F.col("ts") <= F.col("first_ts")))
    newest = near.groupBy(group, "vin").agg(F.max_by("version", F.struct("ts", "version")).alias("version"))
    return units.join(newest, [group, "vin"], "left")


def modal_share(members: DataFrame, sisters: DataFrame, group: str, p: Campaign = Campaign()) -> DataFrame:
    """group, version, members_with, members, sisters_with, sisters, shown. members and sisters(group, vin, version or null), versions in their window."""
    size = lambda d, n: d.groupBy(group).agg(F.countDistinct("vin").alias(n))
    count = lambda d, n: d.filter("version is not null").groupBy(group, "version").agg(F.countDistinct("vin").alias(n))
    top = count(members, "members_with").withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("members_with"), "version"))).filter("k = 1").drop("k")
    out = top.join(size(members, "members"), group).join(count(sisters, "sisters_with"), [group, "version"], "left").join(size(sisters, "sisters"), group, "left")
    out = out.withColumns({"sisters_with": F.coalesce("sisters_with", F.lit(0)), "sisters": F.coalesce("sisters", F.lit(0))})
    ours = F.col("members_with") / F.col("members")
    theirs = F.when(F.col("sisters") > 0, F.col("sisters_with") / F.col("sisters")).otherwise(0.0)
    return out.withColumn("shown", (ours >= p.firmware_share) & (F.col("sisters") > 0) & ((ours - theirs) * 100 >= p.firmware_gap_pts))


def top_codes(codes: DataFrame, group: list[str], k: int = 3) -> DataFrame:
    """The k codes that most units of the group have; ties by code."""
    n = codes.groupBy(*group, "code").agg(F.countDistinct("vin").alias("vins"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("vins"), "code"))
    return n.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def most_similar(wanted: DataFrame, catalogue: DataFrame, k: int = 3, block: int = 2_000, chunk: int = 20_000) -> DataFrame:
    """id, other_id, similarity, rank: the k catalogue vectors of the largest cosine, ties by id; itself left out.

    Exact and blockwise: about `block` wanted vectors and `chunk` catalogue vectors meet in a task, which keeps k of
    the latter for each of the former; what is kept is merged by grouping. No side is sent whole to anyone.
    """
    blocks, chunks = (-(-max(1, d.count()) // n) for d, n in ((wanted, block), (catalogue, chunk)))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    vector = F.transform("vector", lambda x: x.cast("double")).alias("vector")
    left = wanted.select("id", vector, part(blocks).alias("b"), each(chunks).alias("c"))
    right = catalogue.select("id", vector, part(chunks).alias("c"), each(blocks).alias("b"))

    def best(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(ours) and len(theirs):
            x, y = np.stack(ours["vector"].to_list()), np.stack(theirs["vector"].to_list())
            nx, ny, ids = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1), theirs["id"].to_numpy()
            for at in range(0, len(x), 256):
                size = nx[at : at + 256, None] * ny[None, :]
                sim = np.round(np.divide(x[at : at + 256] @ y.T, size, out=np.zeros_like(size), where=size > 0), 6)
                for i, row in zip(ours["id"].to_numpy()[at : at + 256], sim, strict=True):
                    row[ids == i] = -np.inf
                    least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                    near = np.flatnonzero((row >= least) & (row > -np.inf))
                    found += [(i, ids[j], row[j]) for j in near[np.lexsort((ids[near], -row[near]))][:k]]
        return pd.DataFrame(found, columns=["id", "other_id", "similarity"])

    kept = left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInPandas(best, "id long, other_id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other_id"))
    return kept.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def at_risk(hourly: DataFrame, key: list[str], p: Campaign = Campaign()) -> DataFrame:
    """hourly(key, ts, z, zs, adj) -> key, ts, high, recent, at_risk, reason: from the newest scored hours."""
    scored = hourly.filter("z is not null")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("ts")))
    last = scored.withColumn("k", rank).filter(F.col("k") <= p.risk_n)
    newest = lambda c: F.max_by(c, "ts")
    out = last.groupBy(*key).agg(F.max("ts").alias("ts"), F.count_if(F.col("z") >= p.risk_z).alias("high"), F.count(F.lit(1)).alias("recent"), newest("zs").alias("zs"), newest("adj").alias("adj"))
    level, slope = F.col("high") >= p.risk_k, F.coalesce((F.col("zs") >= p.risk_slope) & (F.col("adj") > 0), F.lit(False))
    return out.select(*key, "ts", "high", "recent", (level | slope).alias("at_risk"), F.when(level, "LEVEL").when(slope, "SLOPE").alias("reason"))


EVENTS = "family_key string, group_first_bucket long, kind string, ts timestamp, members int, lambda double, p_value double, version int"


def tail(n: int, rate: float) -> float:
    if n <= 0:
        return 1.0
    if rate <= 0:
        return 0.0
    above, total = rate > n, 0.0  # terms fall upward from n, or downward from n - 1
    k = n - 1 if above else n
    term = math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
    while term > total * 1e-17:
        total += term
        term *= k / rate if above else rate / (k + 1)
        k += -1 if above else 1
    return max(0.0, 1 - total) if above else min(1.0, total)


#: What a merged group takes on from the others: the status that stands highest.
RANK = {"WATCHING": 0, "OPEN": 1, "DISMISSED": 2}


@dataclass
class Group:
    """Buckets first to last of a key, its members (unit -> "" or marks RUNAWAY, FIXED) and where it stands."""

    first: int
    last: int
    members: dict[object, set[str]] = field(default_factory=dict)
    status: str = "WATCHING"
    dismissed_at: int | None = None
    worse: bool = False  # a member has run away since the dismissal
    rate: float | None = None
    p: float | None = None
    version: int = 0

    def event(self, kind: str, ts: int) -> tuple:
        self.version += 1
        return (self.first, kind, ts, len(self.members), self.rate, self.p, self.version)

    def mark(self, vin, name: str) -> None:
        self.members.setdefault(vin, set()).add(name)
        self.worse |= name == "RUNAWAY" and self.status == "DISMISSED"


class Book:
    """Live groups of one key as disjoint stretches of buckets that do not touch, changed by actions in order; changes come back as events."""

    def __init__(self, p: Campaign, vans: int, per_1000: float):
        self.p, self.vans, self.per_1000 = p, vans, max(p.floor_per_1000, per_1000)
        self.groups: list[Group] = []  # by first bucket
        self.home: dict[object, Group] = {}  # of each member

    def _settle(self, g: Group, ts: int, grew: bool) -> list[tuple]:
        """The group's chance anew, and the event that its state calls for."""
        p, n = self.p, len(g.members)
        g.rate = self.vans * (g.last - g.first + 1) * p.bucket_h / 24 * self.per_1000 / 1000
        g.p = tail(n, g.rate)
        again = g.dismissed_at is not None and (g.worse or n >= min(math.ceil(g.dismissed_at * (1 + p.reraise_pct / 100)), g.dismissed_at + p.reraise_abs))
        kind = {"WATCHING": "OPENED" if n >= p.min_vans and g.p < p.alpha else None, "OPEN": "GREW" if grew else None, "DISMISSED": "REOPENED" if again else None}[g.status]
        if kind:
            g.status = "OPEN"
            return [g.event(kind, ts)]
        g.version += grew
        return []

    def _stretch(self, day: int, ts: int) -> tuple[Group, list[tuple]]:
        """The group that holds a bucket, after it took in all that touch it."""
        low, high = bisect_left(self.groups, day - 1, key=lambda g: g.last), bisect_right(self.groups, day + 1, key=lambda g: g.first)
        met = self.groups[low:high]
        if not met:
            self.groups.insert(low, Group(day, day))
            return self.groups[low], []
        whole, gone = met[0], met[1:]
        whole.first, whole.last = min(whole.first, day), max(day, met[-1].last)
        leader = max(met, key=lambda g: RANK[g.status])  # the first of the highest
        whole.status, whole.dismissed_at, whole.worse = leader.status, leader.dismissed_at, leader.worse
        self.groups[low:high] = [whole]
        events = []
        for g in gone:
            moved, g.members = g.members, {}
            whole.members.update(moved)
            self.home.update(dict.fromkeys(moved, whole))
            events.append(g.event("MERGED", ts))
        return whole, events

    def incident(self, vin, day: int, ts: int, runaway: bool = False, elsewhere: bool = False) -> list[tuple]:
        """elsewhere: the unit belongs to a live group of another key already, and stays there."""
        home = self.home.get(vin)
        if home is not None and (not runaway or "RUNAWAY" in home.members[vin]) or home is None and elsewhere:
            return []
        group, events = (home, []) if home is not None else self._stretch(day, ts)
        self.home[vin] = group
        group.members.setdefault(vin, set())
        if runaway:
            group.mark(vin, "RUNAWAY")
        return events + self._settle(group, ts, grew=home is None)

    def dismiss(self, ts: int) -> list[tuple]:
        live = [g for g in self.groups if g.status != "DISMISSED"]
        for g in live:
            g.status, g.dismissed_at, g.worse = "DISMISSED", len(g.members), False
        return [g.event("DISMISSED", ts) for g in live]

    def outcome(self, vin, fixed: bool, ts: int) -> list[tuple]:
        g = self.home.get(vin)
        if g is None or ("FIXED" in g.members[vin]) == fixed:
            return []
        g.members[vin] ^= {"FIXED"}
        if g.status == "WATCHING":
            g.version += 1
            return []
        if not all("FIXED" in marks for marks in g.members.values()):
            return [g.event("FIX_PROGRESS", ts)]
        self.groups.remove(g)
        self.home = {v: h for v, h in self.home.items() if h is not g}
        return [g.event("CLOSED", ts)]


def book_step(book: Book, row: tuple) -> list[tuple]:
    """One action on a key's book: the events that it makes. row: ACTIONS."""
    key, ts, _, kind, vin, runaway, _, _, elsewhere = row
    if kind == "INCIDENT":
        made = book.incident(vin, ts // (book.p.bucket_h * 3_600_000_000), ts, bool(runaway), bool(elsewhere))
    else:
        made = book.dismiss(ts) if kind == "DISMISS" else book.outcome(vin, kind == "FIXED", ts)
    return [(key, *e) for e in made]


ACTIONS = ("family_key", "ts", "seq", "kind", "vin", "runaway", "vans", "per_1000", "elsewhere")


def actions_in_order(actions: DataFrame) -> DataFrame:
    """actions as ACTIONS; elsewhere (see Book.incident) is false where there is no such column."""
    there = F.col("elsewhere") if "elsewhere" in actions.columns else F.lit(False)
    return actions.withColumns({"ts": F.col("ts").cast("timestamp"), "elsewhere": there}).select(*ACTIONS)


def campaign_fold(actions: DataFrame, p: Campaign = Campaign()) -> DataFrame:
    """actions(ACTIONS but elsewhere, which may be missing) -> EVENTS. kind: INCIDENT, DISMISS, FIXED or NOT_FIXED, taken in (ts, seq) order."""
    return ordered_fold(actions_in_order(actions), ["family_key"], ["ts", "seq"], lambda r: Book(p, int(r[6]), float(r[7])), book_step, EVENTS)


def joined_first(actions: DataFrame) -> DataFrame:
    """actions(family_key, kind, vin, ts, seq, ...) with `elsewhere`: the unit's first incident was under another key, so it stays there."""
    first = actions.filter("kind = 'INCIDENT'").groupBy("vin").agg(F.min_by("family_key", F.struct("ts", "seq")).alias("__home"))
    out = actions.join(first, "vin", "left")
    return out.withColumn("elsewhere", (F.col("kind") == "INCIDENT") & (F.col("__home") != F.col("family_key"))).drop("__home")


def bucketed(incidents: DataFrame, p: Campaign = Campaign()) -> DataFrame:
    return incidents.withColumn("b", bucket(F.col("ts"), p.bucket_h))
