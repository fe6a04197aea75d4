"""Joins on time and keys: validity, latest-before, ranges, semi and anti flags, differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_at(facts: DataFrame, ranges: DataFrame, key: str, ts: str, start: str, end: str, value: str) -> DataFrame:
    """facts with `value` of the range [start, end) that holds ts (open end: null); outside all ranges the newest one.

    Ranges of a key do not overlap (see overlaps), so the last range that starts at or before ts is the only one that
    can hold it: a union and a running last value, in one pass and one shuffle by key, without a range join.
    """
    newest = ranges.groupBy(key).agg(F.max_by(value, start).alias("__newest"))
    marks = ranges.select(F.col(key), F.col(start).alias("__t"), F.struct(F.col(end).alias("end"), F.col(value).alias("value")).alias("__r"), F.lit(None).cast(facts.select(F.struct("*")).schema[0].dataType).alias("__f"))
    rows = facts.select(F.col(key), F.col(ts).alias("__t"), F.lit(None).cast(marks.schema["__r"].dataType).alias("__r"), F.struct("*").alias("__f"))
    w = Window.partitionBy(key).orderBy("__t", F.col("__f").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = marks.unionByName(rows).withColumn("__at", F.last("__r", ignorenulls=True).over(w)).filter("__f is not null")
    inside = F.col("__at").isNotNull() & (F.col("__at.end").isNull() | (F.col("__t") < F.col("__at.end")))
    out = last.join(newest, key, "left").withColumn(value, F.when(inside, F.col("__at.value")).otherwise(F.col("__newest")))
    return out.select("__f.*", value)


def overlaps(ranges: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Ranges that reach into the next one of their key."""
    after = F.lead(start).over(Window.partitionBy(key).orderBy(start))
    return ranges.withColumn("next_start", after).filter(F.col("next_start").isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col("next_start"))))


def latest_before(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, values: list[str]) -> DataFrame:
    """left with the values of the newest right row of its key at or before its time."""
    kind = left.select(F.struct("*")).schema[0].dataType
    r = right.select(F.col(by), F.col(right_ts).alias("__t"), F.struct(F.col(right_ts).alias("__rt"), *values).alias("__r"), F.lit(None).cast(kind).alias("__l"))
    rows = left.select(F.col(by), F.col(left_ts).alias("__t"), F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.struct("*").alias("__l"))
    w = Window.partitionBy(by).orderBy("__t", F.col("__l").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    out = r.unionByName(rows).withColumn("__at", F.last("__r", ignorenulls=True).over(w)).filter("__l is not null")
    return out.select("__l.*", F.col("__at.__rt").alias(right_ts), *[F.col(f"__at.{v}").alias(v) for v in values])


def flag_exists(rows: DataFrame, other: DataFrame, keys: list[str], name: str) -> DataFrame:
    there = other.select(*keys).distinct().withColumn(name, F.lit(True))
    return rows.join(there, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def counts_in_window(rows: DataFrame, keys: list[str], ts: str, event: Column, before_s: int, after_s: int, name: str) -> DataFrame:
    """Per row: how many rows of its keys with `event` lie in (ts - before, ts + after], itself left out.

    The count up to ts + after less the count up to ts - before: two running sums over one sort, so a row costs the same
    however many rows its window holds (a frame that slides is gone through anew for each row). A key's time is cut into
    stretches of at least a day; a row is also counted in the neighbours that its window reaches, so no key is one task.
    A row without a time is in no window, and none is in its own.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    length = max(86_400, 2 * (before_s + after_s)) * 1_000_000
    at = lambda shift_s: F.floor((F.col("__us") + shift_s * 1_000_000) / length).cast("long")
    by_time = Window.partitionBy(*keys, "__in").orderBy("__us")
    upto = lambda shift_s: F.coalesce(F.sum("__e").over(by_time.rangeBetween(Window.unboundedPreceding, shift_s * 1_000_000)), F.lit(0))
    flagged = rows.withColumns({"__us": us, "__e": F.coalesce(event, F.lit(False)).cast("int")}).withColumn("__own", at(0))
    dealt = flagged.withColumn("__in", F.explode(F.array_distinct(F.array(at(-after_s), "__own", at(before_s)))))
    # a copy in another stretch only counts, and does so only if it has the event
    mine = F.col("__in").eqNullSafe(F.col("__own"))
    dealt = dealt.filter(mine | (F.col("__e") == 1))
    out = dealt.withColumn(name, F.when(F.col("__us").isNull(), 0).otherwise(upto(after_s) - upto(-before_s) - F.col("__e")).cast("long"))
    return out.filter(mine).select(*rows.columns, name)


def changes(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, old_*, new_*, change (CREATED, UPDATED, WITHDRAWN) of the rows that differ."""
    b = before.select(*keys, *[F.col(v).alias(f"old_{v}") for v in values], F.lit(True).alias("__b"))
    a = after.select(*keys, *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("__a"))
    same = reduce(lambda x, y: x & y, [F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}")) for v in values])
    kind = F.when(F.col("__b").isNull(), "CREATED").when(F.col("__a").isNull(), "WITHDRAWN").when(~same, "UPDATED")
    return b.join(a, keys, "full_outer").withColumn("change", kind).filter("change is not null").drop("__a", "__b")


def insert_if_absent(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
