"""What people look at (their phrases are in phrases.py): boards, pages, cards, suggestions, the change feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import uuid5
from .joins import changes


def member_medians(members: DataFrame, group: list[str]) -> DataFrame:
    """group, members, dev, slope: medians over members, nulls left out."""
    return members.groupBy(*group).agg(F.countDistinct("vin").alias("members"), F.median("deviation").alias("dev"), F.median("slope").alias("slope"))


def cost_if_not_fixed(members: Column, at_risk: Column, breakdown: float, planned: float) -> Column:
    return (members + F.coalesce(at_risk, F.lit(0))) * max(0.0, breakdown - planned)


def grouped_digits(n: Column) -> Column:
    """A whole number with the last three digits apart and pairs before them: 12,34,567."""
    s = n.cast("long").cast("string")
    head = F.regexp_replace(F.substring(s, F.lit(1), F.length(s) - 3), r"(?<=\d)(?=(\d\d)+$)", ",")
    return F.when(F.length(s) > 3, F.concat(head, F.lit(","), F.right(s, F.lit(3)))).otherwise(s)


def ordered_children(rows: DataFrame, group: list[str], order: str, fields: list[str], name: str, most: int | None = None) -> DataFrame:
    """group, name: the group's rows (its first `most` by order) as one ordered array of structs."""
    if most is not None:
        rows = rows.withColumn("__k", F.row_number().over(Window.partitionBy(*group).orderBy(order))).filter(F.col("__k") <= most)
    return rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias(name))


def with_counts(parents: DataFrame, key: str, counts: dict[str, DataFrame]) -> DataFrame:
    """parents with a number of rows for each child table, 0 where there are none."""
    for name, rows in counts.items():
        parents = parents.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return parents


def merged_signals(parts: dict[str, DataFrame]) -> DataFrame:
    """vin, kinds (sorted), signals, and most of what each part carries as `weight`: signals of several kinds as one candidate a unit."""
    out = None
    for kind, df in parts.items():
        own = df.withColumn("kind", F.lit(kind))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out.groupBy("vin").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.count(F.lit(1)).alias("signals"), F.max("weight").alias("weight"))


def exploded_children(rows: DataFrame, key: list[str], children: str) -> DataFrame:
    """key, ord, child fields: the children of the newest version of each parent (rows hold ts and version)."""
    newest = rows.groupBy(*key).agg(F.max_by(F.col(children), F.struct("ts", "version")).alias("__c"))
    return newest.select(*key, F.posexplode("__c").alias("ord", "__x")).select(*key, "ord", "__x.*")


def member_table(groups: DataFrame, members: DataFrame, at_risk: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """(members with `active`, false where their group is merged or closed; at-risk units that are no members)."""
    table = members.join(groups.select(*group, (~F.col("status").isin("MERGED", "CLOSED")).alias("active")), group)
    return table, at_risk.join(table.filter("active").select(*group, "vin"), [*group, "vin"], "left_anti")


def change_feed(changed: DataFrame, namespace: str, key: list[str], published: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """changed(key, change, version, created_at) with a name-based event_id; those not published yet, oldest first, at most `limit` of them."""
    out = changed.withColumn("event_id", uuid5(namespace, F.concat_ws("|", *[F.col(c).cast("string") for c in key], "change", F.col("version").cast("string"))))
    if published is not None:
        out = out.join(published.select("event_id"), "event_id", "left_anti")
    return out.orderBy("created_at", "event_id").limit(limit) if limit is not None else out


def cards(events: DataFrame, kinds: tuple[str, ...] = ("OPENED", "GREW", "REOPENED")) -> DataFrame:
    """One card for each subject: that of its first event of these kinds (ties by version)."""
    rank = F.row_number().over(Window.partitionBy("subject").orderBy("ts", "version"))
    return events.filter(F.col("kind").isin(*kinds)).withColumn("__k", rank).filter("__k = 1").drop("__k")


def suggestions(wanted: DataFrame, live: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """What the desired set of suggestions does to the live one: CREATED, UPDATED or WITHDRAWN rows."""
    return changes(live, wanted, key, values)


def lead_times(first_flag: DataFrame, first_event: DataFrame, key: str = "vin") -> DataFrame:
    """key, lead_h: hours from a unit's first flag to its first event, where the flag came before."""
    flags, events = first_flag.groupBy(key).agg(F.min("ts").alias("flag_ts")), first_event.groupBy(key).agg(F.min("ts").alias("event_ts"))
    lead = (F.unix_micros(F.col("event_ts").cast("timestamp")) - F.unix_micros(F.col("flag_ts").cast("timestamp"))) / 3.6e9
    return flags.join(events, key).filter("flag_ts < event_ts").select(key, lead.alias("lead_h"))


def open_at(rows: DataFrame, intervals: DataFrame, keys: list[str], ts: str, name: str, ahead_h: int = 1) -> DataFrame:
    """rows with a flag: an interval (start, end or null for open) of their keys that begins by ts + ahead_h and has not ended at ts.

    Starts and rows in one running window by key: the latest end among intervals begun so far tells. No range join.
    """
    far = F.lit("9999-01-01").cast("timestamp")
    at = F.col(ts).cast("timestamp")
    marks = intervals.select(*keys, F.col("start").cast("timestamp").alias("__t"), F.coalesce(F.col("end").cast("timestamp"), far).alias("__end"), F.lit(None).cast(rows.select(F.struct("*")).schema[0].dataType).alias("__r"), F.lit(None).cast("timestamp").alias("__at"))
    asked = rows.select(*keys, (at + F.expr(f"INTERVAL {ahead_h} HOURS")).alias("__t"), F.lit(None).cast("timestamp").alias("__end"), F.struct("*").alias("__r"), at.alias("__at"))
    w = Window.partitionBy(*keys).orderBy("__t", F.col("__r").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    out = marks.unionByName(asked).withColumn("__last", F.max("__end").over(w)).filter("__r is not null")
    return out.select("__r.*", F.coalesce(F.col("__last") > F.col("__at"), F.lit(False)).alias(name))


def elsewhere(members: DataFrame, same: list[str], key: str) -> DataFrame:
    """members with `elsewhere`: the same unit (columns `same`) is a member under another key too."""
    spread = members.groupBy(*same).agg((F.min(key) != F.max(key)).alias("elsewhere"))
    return members.join(spread, same)
