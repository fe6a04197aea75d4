"""Scorecards against the truth, ranking metrics, reconciliation, features and labels for a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import running_totals


def precision_at_k(scored: DataFrame, group: list[str], k: int) -> DataFrame:
    """scored(group, id, score, label): share of true labels among the k largest scores of each group; ties by id."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), "id"))
    return scored.withColumn("k", rank).filter(F.col("k") <= k).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("label").cast("double")).alias("precision"))


def average_precision(scored: DataFrame, group: list[str], spread: bool = False) -> DataFrame:
    """Area under the precision-recall curve: sum of precision times recall gained, equal scores taken together.

    spread: running counts by ranges of the score, for few groups with many different scores.
    """
    at = scored.groupBy(*group, "score").agg(F.sum("label").alias("tp"), F.count(F.lit(1)).alias("n"))
    if spread:
        run = running_totals(at, group, [F.desc("score")], {"tps": F.col("tp"), "ns": F.col("n")})
        run = run.join(at.groupBy(*group).agg(F.sum("tp").alias("all")), group)
    else:
        w = Window.partitionBy(*group).orderBy(F.desc("score"))
        run = at.withColumns({"tps": F.sum("tp").over(w), "ns": F.sum("n").over(w), "all": F.sum("tp").over(Window.partitionBy(*group))})
    return run.groupBy(*group).agg(F.sum(F.when(F.col("all") > 0, F.col("tp") / F.col("all") * F.col("tps") / F.col("ns"))).alias("average_precision"))


def confusion(rows: DataFrame, truth: str, ours: str, values: list) -> DataFrame:
    return rows.groupBy(truth).pivot(ours, values).agg(F.count(F.lit(1))).fillna(0)


def reconcile(raw: DataFrame, canonical: DataFrame, dead: DataFrame, duplicates: DataFrame, offset: list[str]) -> DataFrame:
    """One row: distinct source offsets in, and out by way; difference is 0 when nothing is lost or made up."""
    n = lambda d, name: d.agg(F.countDistinct(F.struct(*offset)).alias(name))
    out = n(raw, "n_in").crossJoin(n(canonical, "n_canonical")).crossJoin(n(dead, "n_dead")).crossJoin(n(duplicates, "n_duplicate"))
    return out.withColumn("difference", F.col("n_in") - F.col("n_canonical") - F.col("n_dead") - F.col("n_duplicate"))


def trailing_features(hourly: DataFrame, key: str, ts: str, value: str, frames: tuple[int, ...] = (3, 6, 24), lag: int = 6) -> DataFrame:
    """Means, maxima and sums over the last rows of each key, and the change since `lag` rows ago."""
    w = Window.partitionBy(key).orderBy(ts)
    out: dict[str, Column] = {}
    for n in frames:
        over = w.rowsBetween(-(n - 1), 0)
        out |= {f"avg_{n}": F.avg(value).over(over), f"max_{n}": F.max(value).over(over), f"sum_{n}": F.sum(value).over(over)}
    return hourly.withColumns(out | {f"delta_{lag}": F.col(value) - F.lag(value, lag).over(w)})


def label_within(hourly: DataFrame, events: DataFrame, key: str, ts: str, event_ts: str, horizon_h: int = 24) -> DataFrame:
    """Label 1 if the key's first event lies in (ts + 1 h, ts + 1 h + horizon]; rows at or after the first event go."""
    first = events.groupBy(key).agg(F.min(event_ts).alias("first_event"))
    rows = hourly.join(first, key, "left")
    tau = F.col(ts) + F.expr("INTERVAL 1 HOUR")
    label = F.col("first_event").isNotNull() & (F.col("first_event") <= tau + F.expr(f"INTERVAL {horizon_h} HOURS"))
    return rows.filter(F.col("first_event").isNull() | (F.col("first_event") > tau)).withColumn("label", label.cast("int")).drop("first_event")


def page(rows: DataFrame, ts: str, key: str, after: tuple | None, limit: int) -> DataFrame:
    """The next rows, newest first, after a (ts, id) cursor."""
    if after is not None:
        rows = rows.filter((F.col(ts) < F.lit(after[0])) | ((F.col(ts) == F.lit(after[0])) & (F.col(key) < F.lit(after[1]))))
    return rows.orderBy(F.desc(ts), F.desc(key)).limit(limit)
