"""The given tables in the roles of a fleet: users are vehicles, events are readings, nations are depots."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch, stored  # noqa: F401  queries take them from here


_SHARED: ContextVar[dict[tuple[str, str], DataFrame] | None] = ContextVar("shared", default=None)


@contextmanager
def shared() -> Iterator[None]:
    """Within it, what goes through `once` is worked out and stored the first time, and read again after that: for queries made of many others."""
    token = _SHARED.set({})
    try:
        yield
    finally:
        _SHARED.reset(token)


def once(sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    held = _SHARED.get()
    if held is None:
        return build()
    if (sf_dir, name) not in held:
        held[sf_dir, name] = stored(build(), name)
    return held[sf_dir, name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vin, seq, ts, evt, y, k; metric: level (views, clicks) or rate (purchases, sign-ups), null for errors."""
    return once(sf_dir, "readings", lambda: _readings(spark, sf_dir))


def placed_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """readings with their place in the table: file and row. Sums that must come out bit for bit as those of a single pass over the table are taken in this order."""
    return _readings(spark, sf_dir, "_metadata.file_name", "_metadata.row_index")


def _readings(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    metric = F.when(F.col("event_type").isin("view", "click"), "level").when(F.col("event_type").isin("purchase", "signup"), "rate")
    return e.select(F.col("user_id").alias("vin"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("evt"), F.col("value").alias("y"), F.get_json_object("props", "$.k").cast("int").alias("k"), metric.alias("metric"), *more)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(sf_dir, "registry", lambda: _registry(spark, sf_dir))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    vin = readings(spark, sf_dir).select("vin").distinct()
    depots = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("depot_id"), (F.col("n_regionkey") + 1).alias("region_id"))
    return vin.select("vin", (F.col("vin") % 8).alias("model_id"), (F.col("vin") % 5).alias("duty_type_id"), (F.col("vin") % 25).alias("depot_id")).join(depots, "depot_id")


def families(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(30).select(F.concat(F.lit("P"), (i + 100).cast("string")).alias("code"), F.when(i < 10, "COOLING").when(i < 20, "BATTERY").otherwise("EXHAUST").alias("family"))


def with_codes(rows: DataFrame) -> DataFrame:
    """Errors carry two codes in one pipe-joined column."""
    code = lambda c: F.concat(F.lit("P"), (c % 40 + 100).cast("string"))
    return rows.withColumn("dtc", F.when(F.col("evt") == "error", F.concat_ws("|", code(F.col("k")), code(F.col("k") + 7))))


def broadcast_if_small(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """df, hinted for a broadcast only if a count shows few rows; its rows are narrow."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


#: The same roles for the SQL side.
SQL = """
WITH RECURSIVE r AS (SELECT user_id AS vin, event_id AS seq, ts, event_type AS evt, value AS y, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
  CASE WHEN event_type IN ('view', 'click') THEN 'level' WHEN event_type IN ('purchase', 'signup') THEN 'rate' END AS metric FROM events),
veh AS (SELECT vin, vin % 8 AS model_id, vin % 5 AS duty_type_id, vin % 25 AS depot_id, n_regionkey + 1 AS region_id FROM (SELECT DISTINCT user_id AS vin FROM events) JOIN nation ON n_nationkey = vin % 25),
fam AS (SELECT 'P' || (100 + i) AS code, CASE WHEN i < 10 THEN 'COOLING' WHEN i < 20 THEN 'BATTERY' ELSE 'EXHAUST' END AS family FROM range(30) AS t(i)),
codes AS (SELECT vin, ts, 'P' || (100 + kk % 40) AS code FROM (SELECT vin, ts, unnest([k, k + 7]) AS kk FROM r WHERE evt = 'error')),
cf AS (SELECT vin, ts, codes.code, coalesce(family, 'OTHER') AS family FROM codes LEFT JOIN fam ON codes.code = fam.code),
periods AS (SELECT vin, metric, w, n, level, CASE WHEN span >= 1 THEN rise END AS slope FROM (
  SELECT vin, metric, CAST(floor(h / 72) AS BIGINT) AS w, count(*) AS n, avg(y) AS level, max(h) - min(h) AS span, regr_slope(y, h) AS rise FROM (SELECT vin, metric, y, epoch(ts) / 3600.0 AS h FROM r WHERE metric IS NOT NULL) GROUP BY 1, 2, 3) WHERE n >= 2),
mids AS (SELECT vin, metric, median(level) AS level_mid, median(slope) AS slope_mid FROM periods GROUP BY vin, metric),
gone_off AS (SELECT p.vin, p.metric, p.w, p.level - m.level_mid AS off_l, p.slope - m.slope_mid AS off_s, v.region_id, v.duty_type_id FROM periods p JOIN mids m USING (vin, metric) JOIN veh v USING (vin)),
peers_near AS (SELECT region_id, duty_type_id, metric, w, count(off_l) AS k_l, median(off_l) AS mid_l, count(off_s) AS k_s, median(off_s) AS mid_s FROM gone_off GROUP BY region_id, duty_type_id, metric, w),
peers_wide AS (SELECT region_id, metric, w, median(off_l) AS mid_l, median(off_s) AS mid_s FROM gone_off GROUP BY region_id, metric, w),
left_over AS (SELECT g.vin, g.metric, off_l - if(a.k_l >= 10, a.mid_l, b.mid_l) AS rest_l, off_s - if(a.k_s >= 10, a.mid_s, b.mid_s) AS rest_s FROM gone_off g
  JOIN peers_near a ON (a.region_id, a.duty_type_id, a.metric, a.w) = (g.region_id, g.duty_type_id, g.metric, g.w) JOIN peers_wide b ON (b.region_id, b.metric, b.w) = (g.region_id, g.metric, g.w)),
rest_mids AS (SELECT vin, metric, median(rest_l) AS mid_l, median(rest_s) AS mid_s FROM left_over GROUP BY vin, metric),
spreads AS (SELECT o.vin, o.metric, median(abs(rest_l - mid_l)) AS mad, median(abs(rest_s - mid_s)) AS slope_mad FROM left_over o JOIN rest_mids m USING (vin, metric) GROUP BY o.vin, o.metric),
totals AS (SELECT vin, metric, count(*) AS windows, CAST(sum(n) AS BIGINT) AS readings FROM periods GROUP BY vin, metric),
own_norm AS (SELECT vin, metric, level_mid AS median, mad, coalesce(slope_mid, 0) AS slope_median, coalesce(slope_mad, 0) AS slope_mad, windows, readings FROM totals JOIN mids USING (vin, metric) JOIN spreads USING (vin, metric) WHERE windows >= 3),
placed_norm AS (SELECT model_id, duty_type_id, unnest([region_id, 0]) AS region_id, metric, o.median, mad, slope_median, slope_mad FROM own_norm o JOIN veh USING (vin)),
group_norm AS (SELECT model_id, duty_type_id, region_id, metric, median(p.median) AS median, median(mad) AS mad, median(slope_median) AS slope_median, median(slope_mad) AS slope_mad, count(*) AS vins FROM placed_norm p GROUP BY model_id, duty_type_id, region_id, metric),
days AS (SELECT vin, CAST(count(DISTINCT CAST(ts AS DATE)) AS DOUBLE) AS days FROM r GROUP BY vin),
counted AS (SELECT model_id, duty_type_id, depot_id, family, 1 AS one FROM cf JOIN veh USING (vin)),
driven AS (SELECT model_id, duty_type_id, depot_id, sum(days) AS vehicle_days FROM days JOIN veh USING (vin) GROUP BY 1, 2, 3),
fault AS (SELECT family, model_id, duty_type_id, depot_id, vehicle_days, CAST(sum(one) AS BIGINT) AS codes, 1000.0 * sum(one) / vehicle_days AS per_1000 FROM (
  SELECT * FROM counted JOIN driven USING (model_id, duty_type_id, depot_id) UNION ALL BY NAME SELECT driven.*, family, 0 AS one FROM driven, (SELECT family FROM fam UNION SELECT 'OTHER')) GROUP BY family, model_id, duty_type_id, depot_id, vehicle_days),
hr AS (SELECT vin, date_trunc('hour', ts) AS hour, count(*) AS n, avg(y) AS mean, max(y) AS most, max_by(y, seq) AS last_y, count(*) FILTER (evt = 'error') AS codes FROM r GROUP BY ALL)
"""
