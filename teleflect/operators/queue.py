"""The work queue of each depot: scores, order, bays, bookings, signatures, repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import Fix, Queue
from .folds import ordered_fold


def score(candidates: DataFrame, p: Queue = Queue()) -> DataFrame:
    """candidates(severity 0..1, hours_left, z_slope, members, at_risk_groups, in_service, behaviour, not_fixed, perhaps at_risk_only) with score and pinned."""
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    trend = F.greatest(unit(F.coalesce("z_slope", F.lit(0.0)) / p.full_z), F.coalesce(unit(1 - F.col("hours_left") / p.horizon_h), F.lit(0.0)))
    share = lambda c: unit(F.log2(1 + F.coalesce(F.col(c), F.lit(0)).cast("double")) / F.log2(F.lit(1.0 + p.full_at)))
    campaign = F.greatest(share("members"), p.at_risk_factor * share("at_risk_groups"))
    behaviour = unit((F.coalesce("behaviour", F.lit(1.0)) - 1) / (p.behaviour_full - 1))
    a, b, c, d, e, f = p.weights
    # a unit that is only at risk (no incident, no membership, no failed repair) counts less
    less = F.when(F.col("at_risk_only"), p.at_risk_factor).otherwise(1.0) if "at_risk_only" in candidates.columns else F.lit(1.0)
    total = (a * F.col("severity") + b * trend) * less + c * campaign + d * F.col("in_service").cast("double") + e * behaviour + f * F.col("not_fixed").cast("double")
    return candidates.withColumns({"score": F.round(total, 6), "pinned": F.col("severity") >= p.critical})


def rank(scored: DataFrame, depot: str = "depot_id") -> DataFrame:
    """Pinned first, by hours left (unknown last), then by score, then by vin."""
    order = [F.desc("pinned"), F.when(F.col("pinned"), F.col("hours_left")).asc_nulls_last(), F.desc("score"), F.asc("vin")]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(depot).orderBy(*order)).cast("long"))


def fill_bays(ranked: DataFrame, bays: DataFrame, p: Queue = Queue(), depot: str = "depot_id") -> DataFrame:
    """ranked with slot (TODAY, TOMORROW, WAITING) and wait_days. bays(depot, bays); who is pinned or scores enough may have a bay."""
    per_day = F.coalesce("bays", F.lit(0)) * p.slots_per_bay
    rows = ranked.join(bays, depot, "left").withColumn("eligible", F.col("pinned") | (F.col("score") >= p.min_score))
    turn = F.row_number().over(Window.partitionBy(depot, "eligible").orderBy("rank"))
    rows = rows.withColumn("slot", F.when(~F.col("eligible"), "WAITING").when(turn <= per_day, "TODAY").when(turn <= 2 * per_day, "TOMORROW").otherwise("WAITING"))
    place = F.row_number().over(Window.partitionBy(depot, "slot").orderBy("rank")) - 1
    wait = F.when(F.col("slot") == "TODAY", 0).when(F.col("slot") == "TOMORROW", 1).otherwise(2 + F.floor(place / F.greatest(per_day, F.lit(1))))
    return rows.withColumn("wait_days", wait.cast("long")).drop("bays")


def signature(queue: DataFrame, depot: str = "depot_id") -> DataFrame:
    """One ordered string for each depot: equal strings, equal queues."""
    items = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "vin", "slot").alias("s"))))
    return queue.groupBy(depot).agg(F.array_join(F.transform(items, lambda x: x["s"]), ",").alias("signature"))


def behaviour_ratio(rates: DataFrame, group: list[str]) -> DataFrame:
    """rates(vin, group, rate) with its ratio to the group's upper median (the element at n // 2); null where that is 0."""
    mid = rates.filter("rate is not null").groupBy(*group).agg(F.array_sort(F.collect_list("rate")).alias("r"))
    mid = mid.select(*group, F.element_at("r", (F.floor(F.size("r") / 2) + 1).cast("int")).alias("upper_median"))
    return rates.join(mid, group, "left").withColumn("ratio", F.when(F.col("upper_median") > 0, F.col("rate") / F.col("upper_median")))


def place_bookings(queue: DataFrame) -> DataFrame:
    """queue(depot_id, vin, rank, pinned, eligible, booking, per_day) -> depot_id, vin, slot, rank, booked. Pinned rows first, then bookings for today, for tomorrow, then the rest; a full day spills over."""
    turn = F.when(F.col("pinned"), 0).when(F.col("booking") == "TODAY", 1).when(F.col("booking") == "TOMORROW", 2).otherwise(3)
    # among pinned rows, those with a booking come first as well
    late = F.when(F.col("booking") == "TODAY", 0).when(F.col("booking").isNotNull(), 1).otherwise(2)
    rows = queue.select("depot_id", turn.alias("turn"), late.alias("late"), "rank", "vin", "pinned", "eligible", F.coalesce("booking", F.lit("")).alias("booking"), "per_day")

    def place(left: dict[str, int], row: tuple) -> list[tuple]:
        depot, turn, late, rank, vin, pinned, eligible, wish, _ = row
        days = ("TODAY", "TOMORROW") if pinned or wish == "TODAY" or (not wish and eligible) else (wish,) if wish else ()
        day = next((d for d in days if left.get(d, 0) > 0), "WAITING")
        if day in left:
            left[day] -= 1
        return [(depot, vin, day, turn * 3 + late, rank, wish != "")]

    placed = ordered_fold(rows, ["depot_id"], ["turn", "late", "rank"], lambda r: dict.fromkeys(("TODAY", "TOMORROW"), int(r[8])), place, "depot_id long, vin long, slot string, turn int, before int, booked boolean")
    day = F.when(F.col("slot") == "TODAY", 0).when(F.col("slot") == "TOMORROW", 1).otherwise(2)
    rank = F.row_number().over(Window.partitionBy("depot_id").orderBy(day, "turn", "before"))
    return placed.select("depot_id", "vin", "slot", rank.alias("rank"), "booked")


def fix_verdict(repairs: DataFrame, hourly: DataFrame, now, p: Fix = Fix()) -> DataFrame:
    """repairs(vin, repaired) and hourly(vin, ts, z), rows at hour starts -> vin, repaired, driven, inside, recent, verdict."""
    t, r = F.col("ts"), F.col("repaired")
    first = F.when(F.date_trunc("hour", r) == r, r).otherwise(F.date_trunc("hour", r) + F.expr("INTERVAL 1 HOUR"))
    end = r + F.expr(f"INTERVAL {p.window_h} HOURS")
    after = repairs.join(hourly.filter("z is not null"), "vin").filter((t >= first) & (t < end) & (t <= now))
    k = F.row_number().over(Window.partitionBy("vin", "repaired").orderBy(F.desc("ts")))
    marked = after.withColumn("k", k)
    seen = marked.groupBy("vin", "repaired").agg(F.count(F.lit(1)).alias("driven"), F.count_if((F.col("k") <= p.inside_n) & (F.abs("z") < p.band)).alias("inside"), F.count_if(F.col("k") <= p.inside_n).alias("recent"))
    out = repairs.select("vin", "repaired").join(seen, ["vin", "repaired"], "left").fillna(0, ["driven", "inside", "recent"])
    verdict = (
        F.when((F.col("driven") >= p.min_driven_h) & (F.col("inside") >= p.inside_k), "FIXED")
        .when((F.col("driven") >= p.not_fixed_after_h) | ((F.lit(now) >= end) & (F.col("driven") >= p.min_driven_h)), "NOT_FIXED")
        .otherwise("PENDING")
    )
    return out.withColumn("verdict", verdict)
