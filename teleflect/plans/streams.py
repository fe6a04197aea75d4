"""Queries that run as streams over the given tables: readings in order of time as a feed of several batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import peers as P
from ..operators import tenancy as T
from ..params import Detect, Metric
from ..streaming import enrich, jobs, timers
from . import fleet
from .more import INTAKE_SQL, arriving
from .queries import normal, query, rounded

BATCHES = 4
FILE_ROWS = 100_000


def in_batches(rows: DataFrame, name: str, order: str = "ts") -> DataFrame:
    """rows as a stream of BATCHES batches, each a stretch of the order in files of some FILE_ROWS rows: as many tasks write and read a batch as its size asks for."""
    spark, base = rows.sparkSession, fleet.scratch(rows.sparkSession, name)
    at = F.col(order).cast("double") if order != "ts" else F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    edges = rows.select(at.alias("x")).agg(F.percentile_approx("x", [i / BATCHES for i in range(1, BATCHES)], F.lit(10_000))).first()[0] or []
    number = sum((F.when(at > e, 1).otherwise(0) for e in edges), F.lit(0))
    held = fleet.stored(rows.withColumn("__batch", number), f"{name}-rows")
    sizes = {r["__batch"]: r["count"] for r in held.groupBy("__batch").count().collect()}  # a row for each batch
    files = max(1, min(sizes.get(i, 0) for i in range(BATCHES)) // FILE_ROWS)  # the same number for each, as a trigger takes so many
    for i in range(BATCHES):
        own = held.filter(F.col("__batch") == i).drop("__batch")
        (own.coalesce(1) if files == 1 else own.repartition(files)).write.mode("append").parquet(f"{base}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")


def landed(stream: DataFrame, name: str) -> DataFrame:
    """A stream run until its input is read, and what it wrote."""
    spark = stream.sparkSession
    base, setting = fleet.scratch(spark, name), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    jobs.use_rocksdb(spark)
    try:
        jobs.run_available(stream, f"{base}/out", f"{base}/checkpoint")
    finally:
        spark.conf.set(setting, before)
    return spark.read.parquet(f"{base}/out")


def hour_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Readings as timers.READING: levels are coolant, rates the battery, errors carry two codes."""
    r, k = fleet.readings(spark, sf), F.col("k")
    at = F.col("ts").cast("timestamp")
    own = {"coolant_c": F.when(F.col("metric") == "level", F.col("y")), "batt_temp_c": F.when(F.col("metric") == "rate", F.col("y")), "lv_batt_v": F.lit(12.5), "soc_pct": F.when(k % 3 == 0, k.cast("double")), "ambient_c": F.when(k % 4 != 0, k / 2), "speed_kmh": k.cast("double")}
    rest = {"ignition": k % 5 != 0, "codes": F.when(F.col("evt") == "error", 2).otherwise(0).cast("long"), "harsh_brake": F.when(k % 2 == 0, k % 3).cast("long"), "harsh_accel": F.lit(None).cast("long"), "idle_s": F.when(k % 7 == 0, 1.5)}
    return r.select("vin", F.unix_micros(at).alias("us"), "seq", *[v.cast("double").alias(c) for c, v in own.items()], *[v.alias(c) for c, v in rest.items()], at.alias("ts"))


CLOSED_SQL = """, h AS (SELECT vin, date_trunc('hour', ts) AS hour, count(*) AS n, avg(CASE WHEN metric = 'level' THEN y END) AS coolant_c, avg(CASE WHEN metric = 'rate' THEN y END) AS batt_temp_c, 12.5 AS lv_batt_v, max(CASE WHEN metric = 'level' THEN y END) AS max_coolant_c, max(CASE WHEN metric = 'rate' THEN y END) AS max_batt_temp_c,
  CAST(max_by(k, ts) FILTER (k % 3 = 0) AS DOUBLE) AS soc_pct, avg(CASE WHEN k % 4 <> 0 THEN k / 2.0 END) AS ambient_c, avg(CASE WHEN k % 5 <> 0 THEN k END) AS speed_kmh, sum(CASE WHEN evt = 'error' THEN 2 ELSE 0 END) AS codes, sum(CASE WHEN k % 2 = 0 THEN k % 3 END) AS harsh, sum(CASE WHEN k % 7 = 0 THEN 1.5 ELSE 0 END) AS idle_s FROM r GROUP BY ALL),
c AS (SELECT h.* FROM h JOIN (SELECT vin, max(hour) AS last FROM h GROUP BY vin) l USING (vin), (SELECT max(ts) AS newest FROM r) WHERE hour < last OR hour + INTERVAL 2 HOUR <= newest)
"""
_ROUNDED = ("coolant_c", "batt_temp_c", "lv_batt_v", "max_coolant_c", "max_batt_temp_c", "soc_pct", "ambient_c", "speed_kmh", "idle_s")


@query(CLOSED_SQL + "SELECT vin, hour, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in _ROUNDED) + ", CAST(codes AS BIGINT) AS codes, CAST(harsh AS BIGINT) AS harsh FROM c")
def stream_closed_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Every unit's hourly rows, closed by its next hour or, for a quiet unit, by a timer."""
    closed = landed(timers.closed_hours(in_batches(hour_readings(spark, sf), "hour-readings")), "closed-hours")
    return rounded(closed.drop("closed_at").withColumn("hour", F.col("hour").cast("timestamp_ntz")))


@query(CLOSED_SQL + "SELECT CAST(vin % 25 AS BIGINT) AS grp, hour + INTERVAL 1 HOUR AS tick, count(*) AS units, CAST(sum(n) AS BIGINT) AS readings, CAST(sum(codes) AS BIGINT) AS codes FROM c, (SELECT max(ts) AS newest FROM r) WHERE hour + INTERVAL 2 HOUR <= newest GROUP BY ALL")
def stream_hourly_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """A tick for each depot and hour that has rows, when they are complete: hours are closed and ticks fire in one query."""
    closed = timers.closed_hours(in_batches(hour_readings(spark, sf), "hour-readings"))
    return landed(timers.ticks(closed, F.col("vin") % 25), "ticks").drop("fired_at").withColumn("tick", F.col("tick").cast("timestamp_ntz"))


@query(INTAKE_SQL)
def stream_intake(spark: SparkSession, sf: str) -> DataFrame:
    """jump_checks on a stream: replay window, believed values and resets in one state for each unit."""
    rows = arriving(spark, sf)
    return landed(jobs.intake_stream(in_batches(rows, "arriving", "arrival")), "intake").select("vin", "seq", "odo_km", "soc_pct", "flags")


def peer_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Levels with their normal and their unit's place, as the folds read them."""
    places = fleet.registry(spark, sf).select("vin", "region_id", "duty_type_id")
    own = normal(spark, sf).filter("metric = 'level'").select("vin", "median", "mad", "slope_median", "slope_mad")
    r = fleet.readings(spark, sf).filter("metric = 'level'").join(own, "vin").join(places, "vin")
    return r.select("vin", "seq", "ts", F.lit("READING").alias("kind"), F.lit("level").alias("name"), "y", F.lit(None).cast("double").alias("usual"), "median", "mad", "slope_median", "slope_mad", "region_id", "duty_type_id")


@query()
def detect_with_peers(spark: SparkSession, sf: str) -> DataFrame:
    """Levels scored less what the peers of the moment do. The folds feed back on themselves, so SQL has no say; tests hold them against one loop."""
    p = Detect(tau_h=240.0, fast_tau_h=60.0, min_peers=5, peer_window_h=24.0)
    return P.detect_with_peers(peer_rows(spark, sf), {"level": ("COOLING", Metric(spike_max=1e9, max_rate_per_min=1e9, hard_limit=None))}, p)


# ---- tenants


OWNERS = {
    "nation": T.Owner("n_regionkey", None, "n_nationkey"), "customer": T.Owner("c_nationkey", "nation", "c_custkey"), "supplier": T.Owner("s_nationkey", "nation", "s_suppkey"), "orders": T.Owner("o_custkey", "customer", "o_orderkey"),
    "lineitem": T.Owner("l_orderkey", "orders"), "region": T.Owner("r_regionkey", None, "r_regionkey"), "events": T.Owner("user_id", "customer"),
}
SHARED = ("part",)


@query(" UNION ALL ".join(
    f"SELECT '{name}' AS name, tenant, (SELECT count(*) FROM {source} WHERE {owner} = tenant) AS n FROM (SELECT unnest([0, 1, 4]) AS tenant)"
    for name, source, owner in (
        ("nation", "nation", "n_regionkey"), ("region", "region", "r_regionkey"), ("customer", "customer JOIN nation ON c_nationkey = n_nationkey", "n_regionkey"), ("supplier", "supplier JOIN nation ON s_nationkey = n_nationkey", "n_regionkey"),
        ("orders", "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey", "n_regionkey"), ("lineitem", "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey", "n_regionkey"),
        ("events", "events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey", "n_regionkey"),
    )
).replace("AS name, tenant,", "AS name, CAST(tenant AS BIGINT) AS tenant,") + " UNION ALL SELECT 'part', CAST(t AS BIGINT), (SELECT count(*) FROM part) FROM (SELECT unnest([0, 1, 4]) AS t) UNION ALL SELECT 'none', NULL, 0", roles=False)
def secured_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of every secured view for three tenants, and for none of them (all views together)."""
    names = (*OWNERS, *SHARED)
    views = T.secure(spark, {n: fleet.table(spark, sf, n) for n in names}, OWNERS, SHARED)
    out = None
    for tenant in (0, 1, 4, None):
        T.as_tenant(spark, None if tenant is None else str(tenant))
        part = None
        for name, view in zip(names, views, strict=True):
            one = spark.table(view).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name if tenant is not None else "none").alias("name"), F.lit(tenant).cast("long").alias("tenant"), "n")
            part = one if part is None else part.unionByName(one)
        part = fleet.stored(part.groupBy("name", "tenant").agg(F.sum("n").alias("n")), "secured")  # while the session is this tenant's
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT tenant, topic, n, CASE WHEN tenant = '2' THEN n ELSE 0 END AS own FROM (SELECT CASE WHEN vin % 25 >= 20 THEN 'unknown' ELSE CAST(n_regionkey AS VARCHAR) END AS tenant, CASE WHEN evt = 'error' THEN 'incident' ELSE 'reading' END AS topic, count(*) AS n FROM r JOIN nation ON n_nationkey = vin % 25 GROUP BY ALL)")
def stream_tenant_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Changes enriched with their depot's tenant, the dimension read for each batch (the last five depots are not in it), and one tenant's own feed."""
    rows = fleet.readings(spark, sf).select("vin", "seq", "ts", (F.col("vin") % 25).alias("depot_id"), F.when(F.col("evt") == "error", "incident").otherwise("reading").alias("topic"))
    base = fleet.scratch(spark, "tenant-feed")
    dimension = lambda s: fleet.table(s, sf, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").cast("long").alias("depot_id"), F.col("n_regionkey").alias("tenant"))
    enrich.follow(in_batches(rows, "changes"), dimension, "depot_id", "tenant", f"{base}/out", f"{base}/checkpoint")
    count = lambda d, n: d.groupBy(F.col("tenant").cast("string").alias("tenant"), "topic").agg(F.count(F.lit(1)).alias(n))
    whole = count(spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out/batch=*"), "n")
    own = count(enrich.feed_of(spark, f"{base}/out", "tenant", "2"), "own")
    return whole.join(own, ["tenant", "topic"], "left").fillna(0, ["own"])
