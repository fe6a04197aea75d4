"""Fleet queries on the given tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import baselines as B
from ..operators import campaigns as C
from ..operators import detect as D
from ..operators import evaluate as E
from ..operators import joins as J
from ..operators import queue as Q
from ..params import Baselines, Campaign, Detect, Fix, Metric, Queue
from ..sources import raw
from ..streaming import jobs
from . import fleet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The events are sparse for a fleet: longer windows, fewer readings in each.
SPARSE = Baselines(window_h=72, min_readings=2)
DNS = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def query(sql: str | None = None, roles: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (fleet.SQL if roles else "") + sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, whole numbers as longs: the same on either engine."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes])


def windows(spark: SparkSession, sf: str) -> DataFrame:
    return B.window_stats(fleet.placed_readings(spark, sf).filter("metric is not null"), SPARSE, ("file_name", "row_index"))


def normal(spark: SparkSession, sf: str) -> DataFrame:
    """Windows and registry are worked out once: the windows stand in four places of the plan."""
    return B.own_normal(fleet.stored(windows(spark, sf), "windows"), fleet.stored(fleet.registry(spark, sf), "registry"), SPARSE)


def codes(spark: SparkSession, sf: str) -> DataFrame:
    return fleet.once(sf, "codes", lambda: B.code_rows(fleet.with_codes(fleet.readings(spark, sf)), fleet.families(spark)))


# ---- baselines


@query("SELECT vin, metric, w, n, round(level, 6) AS level, round(slope, 6) AS slope FROM periods")
def baseline_windows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(windows(spark, sf))


@query("SELECT vin, metric, round(median, 6) AS median, round(mad, 6) AS mad, round(slope_median, 6) AS slope_median, round(slope_mad, 6) AS slope_mad, windows, readings FROM own_norm")
def baseline_own_normal(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(normal(spark, sf))


@query("SELECT model_id, duty_type_id, CAST(region_id AS BIGINT) AS region_id, metric, round(median, 6) AS median, round(mad, 6) AS mad, round(slope_median, 6) AS slope_median, round(slope_mad, 6) AS slope_mad, vins FROM group_norm")
def baseline_cohort_sets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.cohort_normal(normal(spark, sf), fleet.registry(spark, sf)))


@query("SELECT cf.vin, family, round(count(*) / days, 6) AS codes_per_day FROM cf JOIN days ON cf.vin = days.vin GROUP BY cf.vin, family, days")
def code_rate_per_day(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.codes_per_day(codes(spark, sf), B.days_seen(fleet.readings(spark, sf))), 6)


def rates(spark: SparkSession, sf: str) -> DataFrame:
    return B.fault_rates(codes(spark, sf), B.days_seen(fleet.readings(spark, sf)), fleet.registry(spark, sf), fleet.families(spark))


@query("SELECT family, model_id, duty_type_id, depot_id, vehicle_days, codes, round(per_1000, 6) AS per_1000 FROM fault")
def fault_rate_zero_fill(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rates(spark, sf).select("family", "model_id", "duty_type_id", "depot_id", "vehicle_days", "codes", "per_1000"))


@query("SELECT family, model_id, duty_type_id, CAST(sum(codes) AS BIGINT) AS codes, sum(vehicle_days) AS vehicle_days, round(1000.0 * sum(codes) / nullif(sum(vehicle_days), 0), 6) AS per_1000 FROM fault GROUP BY ALL")
def fault_rate_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.fault_rate_rollup(rates(spark, sf)))


@query("""SELECT v.vin, m.metric, round(coalesce(o.median, a.median, b.median), 6) AS median, round(coalesce(o.mad, a.mad, b.mad), 6) AS mad,
  CASE WHEN o.median IS NOT NULL THEN 'own' WHEN a.median IS NOT NULL THEN 'region' WHEN b.median IS NOT NULL THEN 'all' END AS source
FROM veh v CROSS JOIN (VALUES ('level'), ('rate')) m(metric) LEFT JOIN (SELECT * FROM own_norm WHERE vin % 4 <> 0) o ON o.vin = v.vin AND o.metric = m.metric
LEFT JOIN group_norm a ON a.model_id = v.model_id AND a.duty_type_id = v.duty_type_id AND a.region_id = v.region_id AND a.metric = m.metric
LEFT JOIN group_norm b ON b.model_id = v.model_id AND b.duty_type_id = v.duty_type_id AND b.region_id = 0 AND b.metric = m.metric""")
def fallback_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Vehicles divisible by 4 stand for those too new to have a normal of their own."""
    vehicles, own = fleet.registry(spark, sf), normal(spark, sf)
    wanted = vehicles.withColumn("metric", F.explode(F.array(F.lit("level"), F.lit("rate"))))
    return rounded(B.with_fallback(wanted, own.filter("vin % 4 <> 0"), B.cohort_normal(own, vehicles)))


# ---- rows


ITEM_RANGES = {"l_quantity": (0, 30), "l_extendedprice": (1000, 50000), "l_discount": (0.02, 0.08)}


@query(" UNION ALL ".join(f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, '{m}' AS metric, round({m}, 6) AS y FROM lineitem WHERE {m} BETWEEN {a} AND {b} AND l_returnflag <> 'R'" for m, (a, b) in ITEM_RANGES.items()), roles=False)
def unpivot_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.metric_rows(fleet.table(spark, sf, "lineitem"), ITEM_RANGES, F.col("l_returnflag") != "R", ("l_orderkey", "l_linenumber")))


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    return raw.validate(fleet.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *ITEM_RANGES), ITEM_RANGES)


FLAGS_SQL = ", ".join(f"CASE WHEN NOT {c} BETWEEN {a} AND {b} THEN 'OUT_OF_RANGE:{c}' END" for c, (a, b) in ITEM_RANGES.items())
VALUES_SQL = ", ".join(f"CASE WHEN {c} BETWEEN {a} AND {b} THEN round({c}, 6) END AS {c}" for c, (a, b) in ITEM_RANGES.items())


@query(f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {VALUES_SQL}, concat_ws(',', {FLAGS_SQL}) AS flags FROM lineitem", roles=False)
def range_flags(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(flagged(spark, sf).withColumn("flags", F.array_join("quality_flags", ",")).drop("quality_flags"))


@query(f"SELECT split_part(f, ':', 1) AS flag_type, split_part(f, ':', 2) AS field, count(*) AS n FROM (SELECT unnest([{FLAGS_SQL}]) AS f FROM lineitem) WHERE f IS NOT NULL GROUP BY ALL", roles=False)
def flag_counts(spark: SparkSession, sf: str) -> DataFrame:
    flags = flagged(spark, sf).select(F.explode("quality_flags").alias("f"))
    return flags.groupBy(F.split_part("f", F.lit(":"), F.lit(1)).alias("flag_type"), F.split_part("f", F.lit(":"), F.lit(2)).alias("field")).agg(F.count(F.lit(1)).alias("n"))


GOOD_VIN, BAD_VIN = "1HGCM82633A004352", "1HGCM82643A004352"


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """The raw table, as a feed leaves it: events as raw messages in three shapes; every 17th cut short, every 13th without a seq, every 10th with a bad identifier, every 7th of no known shape."""
    e, i = fleet.readings(spark, sf), F.col("seq")
    vin = F.when(i % 10 == 3, BAD_VIN).otherwise(GOOD_VIN)
    seq = F.when(i % 13 != 0, i)
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    evt, yes = F.lit("PERIODIC"), F.lit(True)
    code = F.concat(F.lit("P0"), F.lpad(F.col("k").cast("string"), 3, "0"))
    a = F.struct(F.struct(vin.alias("vin")).alias("vehicle"), iso.alias("t"), seq.alias("n"), evt.alias("evt"), F.struct(F.lit(12.5).alias("la"), F.lit(77.5).alias("lo")).alias("pos"), F.lit(40.0).alias("spd"), F.lit(100.5).alias("odo"), F.struct((F.col("y") + 32).alias("coolantTempF")).alias("eng"), yes.alias("ign"), F.lit(False).alias("chg"), F.array(code, F.lit("XX9")).alias("codes"))
    b = F.struct(F.struct(vin.alias("vin")).alias("vehicle"), iso.alias("time"), seq.alias("seqNo"), evt.alias("event"), F.struct(F.lit(12.5).alias("lat"), F.lit(77.5).alias("lon")).alias("position"), F.lit(40.0).alias("speedKmh"), F.lit(100.5).alias("odometerKm"), F.struct(F.struct(F.col("y").alias("tempC")).alias("coolant")).alias("engine"), yes.alias("ignition"), F.lit(False).alias("charging"), F.array(code, F.lit("XX9")).alias("codes"))
    c = F.struct(vin.alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), seq.alias("sq"), F.lit("P").alias("e"), F.array(F.lit(12.5), F.lit(77.5)).alias("g"), F.lit(40.0).alias("s"), F.lit(100.5).alias("o"), F.col("y").alias("ct"), F.lit(1).alias("ig"), F.lit(0).alias("ch"), F.concat_ws("|", code, F.lit("XX9")).alias("dtc"))
    body = F.when(i % 3 == 0, F.to_json(a)).when(i % 3 == 1, F.to_json(b)).otherwise(F.to_json(c))
    body = F.when(i % 7 == 0, F.to_json(F.struct(vin.alias("who"), seq.alias("n")))).otherwise(body)
    rows = e.select(F.lit("raw").alias("topic"), F.lit(0).alias("partition"), i.alias("offset"), F.when(i % 17 == 0, F.substring(body, 1, 20)).otherwise(body).alias("value"))
    return fleet.stored(rows.repartition(spark.sparkContext.defaultParallelism, "offset"), "raw-messages")


PROBLEM_SQL = "CASE WHEN seq % 17 = 0 THEN 'MALFORMED_JSON' WHEN seq % 7 = 0 THEN 'UNKNOWN_SHAPE' WHEN seq % 13 = 0 THEN 'SCHEMA_INVALID' WHEN seq % 10 = 3 THEN 'INVALID_VIN' END"


@query("SELECT seq AS \"offset\", CASE WHEN seq % 17 = 0 OR seq % 7 = 0 THEN NULL WHEN seq % 3 = 0 THEN 'nested_f' WHEN seq % 3 = 1 THEN 'nested_c' ELSE 'flat' END AS shape FROM r")
def shape_detect(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).select("offset", raw.shape_of(F.col("value")).alias("shape"))


@query(f"SELECT seq AS \"offset\", '{GOOD_VIN}' AS vin, seq, 'PERIODIC' AS evt, epoch_us(ts) // 1000 AS ms, CASE WHEN seq % 3 = 0 THEN CASE WHEN round(y * 5 / 9, 2) BETWEEN -40 AND 150 THEN round(y * 5 / 9, 2) END WHEN y BETWEEN -40 AND 150 THEN round(y, 2) END AS coolant_c, concat_ws(',', CASE WHEN NOT (CASE WHEN seq % 3 = 0 THEN y * 5 / 9 ELSE y END) BETWEEN -40 AND 150 THEN 'OUT_OF_RANGE:coolant_c' END, 'INVALID_DTC') AS flags, 'P0' || lpad(CAST(k AS VARCHAR), 3, '0') AS dtc FROM (SELECT * FROM r WHERE {PROBLEM_SQL} IS NULL)")
def json_decode_fields(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = raw.split(messages(spark, sf))
    return good.select("offset", "vin", "seq", "evt", F.unix_millis("event_ts").alias("ms"), F.round("coolant_c", 2).alias("coolant_c"), F.array_join("quality_flags", ",").alias("flags"), F.array_join("dtc", ",").alias("dtc"))


SHAPE_SQL = "CASE seq % 3 WHEN 0 THEN 'nested_f' WHEN 1 THEN 'nested_c' ELSE 'flat' END"


@query(f"""SELECT seq AS "offset", p AS error_code, CASE p WHEN 'MALFORMED_JSON' THEN p || ' no shape no JSON object' WHEN 'UNKNOWN_SHAPE' THEN p || ' no shape keys who' || if(seq % 13 = 0, '', ' n')
WHEN 'SCHEMA_INVALID' THEN p || ' ' || {SHAPE_SQL} || ' ' || CASE seq % 3 WHEN 0 THEN 'n' WHEN 1 THEN 'seqNo' ELSE 'sq' END || ' is not a whole number of 0 or more' ELSE p || ' ' || {SHAPE_SQL} || ' identifier CHECK_DIGIT' END AS error_detail FROM (SELECT seq, {PROBLEM_SQL} AS p FROM r) WHERE p IS NOT NULL""")
def dlq_split(spark: SparkSession, sf: str) -> DataFrame:
    _, dead = raw.split(messages(spark, sf))
    return dead.select("offset", "error_code", "error_detail")


@query(f"SELECT count(*) + count(*) FILTER (seq % 10 = 0) AS n_in, count(*) FILTER ({PROBLEM_SQL} IS NULL) AS n_canonical, count(*) FILTER ({PROBLEM_SQL} IS NOT NULL) + count(*) FILTER (seq % 10 = 0 AND {PROBLEM_SQL} IS NOT NULL) AS n_dead, count(*) FILTER (seq % 10 = 0 AND {PROBLEM_SQL} IS NULL) AS n_duplicate, CAST(0 AS BIGINT) AS difference FROM r")
def reconcile_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth message comes again in partition 1; what is canonical twice is a duplicate."""
    rows = messages(spark, sf)
    sent = rows.unionByName(rows.filter("offset % 10 = 0").withColumn("partition", F.lit(1)))
    good, dead = raw.split_judged(fleet.stored(raw.judged(sent), "judged"))
    first = F.row_number().over(Window.partitionBy("seq").orderBy("partition"))
    marked = good.withColumn("k", first)
    return E.reconcile(sent, marked.filter("k = 1"), dead, marked.filter("k > 1"), ["topic", "partition", "offset"])


@query(f"SELECT vin, seq, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM (SELECT vin, seq, sha1(unhex('{DNS.replace('-', '')}') || encode(vin || ':' || seq)) AS h FROM r)")
def uuid5_ids(spark: SparkSession, sf: str) -> DataFrame:
    return fleet.readings(spark, sf).select("vin", "seq", X.uuid5(DNS, F.concat_ws(":", F.col("vin").cast("string"), F.col("seq").cast("string"))).alias("id"))


@query("""SELECT c_custkey, v AS vin, CASE WHEN length(v) <> 17 THEN 'LENGTH' WHEN NOT regexp_full_match(v, '[A-HJ-NPR-Z0-9]{17}') THEN 'CHARACTERS' WHEN d <> substr(v, 9, 1) THEN 'CHECK_DIGIT' END AS problem FROM (
SELECT c_custkey, v, CASE WHEN s % 11 = 10 THEN 'X' ELSE CAST(s % 11 AS VARCHAR) END AS d FROM (SELECT c_custkey, v, list_sum([w[i] * coalesce(TRY_CAST(substr(translate(v, 'ABCDEFGHJKLMNPRSTUVWXYZ', '12345678123457923456789'), i, 1) AS BIGINT), 0) for i in range(1, 18)]) AS s
FROM (SELECT c_custkey, [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2] AS w, CASE WHEN c_custkey % 11 = 0 THEN '1HGCM82O' ELSE '1HGCM826' END || CASE WHEN c_custkey % 10 = 9 THEN 'X' ELSE CAST(c_custkey % 10 AS VARCHAR) END || '3A' || CASE WHEN c_custkey % 7 = 0 THEN '1' ELSE lpad(CAST(c_custkey AS VARCHAR), 6, '0') END AS v FROM customer)))""", roles=False)
def vin_check(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    digit = F.when(k % 10 == 9, "X").otherwise((k % 10).cast("string"))
    vin = F.concat(F.when(k % 11 == 0, "1HGCM82O").otherwise("1HGCM826"), digit, F.lit("3A"), F.when(k % 7 == 0, "1").otherwise(F.lpad(k.cast("string"), 6, "0")))
    return fleet.table(spark, sf, "customer").select("c_custkey", vin.alias("vin")).withColumn("problem", X.vin_problem(F.col("vin")))


@query("""SELECT cell, count(*) AS n FROM (SELECT array_to_string([substr('0123456789bcdefghjkmnpqrstuvwxyz', 1 + CAST(list_sum([b[5 * c + j + 1] * CAST(pow(2, 4 - j) AS BIGINT) for j in range(0, 5)]) AS BIGINT), 1) for c in range(0, 5)], '') AS cell
FROM (SELECT [CASE WHEN i % 2 = 0 THEN (x >> (12 - i // 2)) & 1 ELSE (y >> (11 - i // 2)) & 1 END for i in range(0, 25)] AS b FROM (
SELECT CAST(floor(((c_custkey * 37 % 36000) / 100.0) / 360 * 8192) AS BIGINT) AS x, CAST(floor(((c_custkey * 53 % 18000) / 100.0) / 180 * 4096) AS BIGINT) AS y FROM customer))) GROUP BY cell""", roles=False)
def geohash_cells(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    at = fleet.table(spark, sf, "customer").select(((k * 53 % 18000) / 100.0 - 90).alias("lat"), ((k * 37 % 36000) / 100.0 - 180).alias("lon"))
    return at.groupBy(X.geohash5(F.col("lat"), F.col("lon")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


# ---- order of arrival


@query("SELECT vin, CASE WHEN rn = 1 THEN 'NEW' ELSE 'DUPLICATE' END AS outcome, count(*) AS n FROM (SELECT vin, seq, row_number() OVER (PARTITION BY vin, seq ORDER BY copy) AS rn FROM (SELECT vin, seq, 0 AS copy FROM r UNION ALL SELECT vin, seq, 1 FROM r WHERE seq % 10 = 0)) GROUP BY ALL")
def dedupe_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth message comes twice; each unit's messages pass the replay window in order of arrival."""
    r = fleet.readings(spark, sf).select("vin", "seq", "ts", (F.col("seq") * 2).alias("arrival"))
    sent = r.unionByName(r.filter("seq % 10 = 0").withColumn("arrival", F.col("arrival") + 1))
    return jobs.replay_outcomes(sent).groupBy("vin", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vin, count(*) AS n, count(*) FILTER (seq < before) AS late FROM (SELECT vin, seq, max(seq) OVER (PARTITION BY vin ORDER BY seq + CASE WHEN seq % 5 = 0 THEN 1500 ELSE 0 END, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r) GROUP BY vin")
def late_by_running_max(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth message is held up; late: a larger seq of the unit came before."""
    arrival = F.col("seq") + F.when(F.col("seq") % 5 == 0, 1500).otherwise(0)
    w = Window.partitionBy("vin").orderBy(arrival, "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = fleet.readings(spark, sf).withColumn("before", F.max("seq").over(w))
    return rows.groupBy("vin").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("seq") < F.col("before")).alias("late"))


# ---- joins


@query("""SELECT r.vin, r.seq, coalesce(a.depot, CAST((r.vin + 2) % 25 AS BIGINT)) AS depot FROM r LEFT JOIN (
SELECT vin, vin % 25 AS depot, TIMESTAMP '2024-01-02' AS a, TIMESTAMP '2024-01-11' AS b FROM veh UNION ALL SELECT vin, (vin + 1) % 25, TIMESTAMP '2024-01-11', TIMESTAMP '2024-01-21' FROM veh UNION ALL SELECT vin, (vin + 2) % 25, TIMESTAMP '2024-01-25', NULL FROM veh) a
ON a.vin = r.vin AND r.ts >= a.a AND (a.b IS NULL OR r.ts < a.b)""")
def asof_validity_join(spark: SparkSession, sf: str) -> DataFrame:
    vins, t = fleet.registry(spark, sf).select("vin"), lambda x: F.lit(x).cast("timestamp_ntz")
    parts = [vins.select("vin", ((F.col("vin") + i) % 25).alias("depot"), t(a).alias("a"), t(b).alias("b")) for i, (a, b) in enumerate((("2024-01-02", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-25", None)))]
    ranges = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return J.valid_at(fleet.readings(spark, sf).select("vin", "seq", "ts"), ranges, "vin", "ts", "a", "b", "depot").select("vin", "seq", "depot")


@query("SELECT c.vin, c.seq, e.seq AS error_seq, round(e.y, 6) AS error_y FROM (SELECT * FROM r WHERE evt = 'click') c ASOF LEFT JOIN (SELECT * FROM r WHERE evt = 'error') e ON c.vin = e.vin AND c.ts >= e.ts")
def asof_latest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    r = fleet.readings(spark, sf)
    errors = r.filter("evt = 'error'").select("vin", F.col("ts").alias("error_ts"), F.col("seq").alias("error_seq"), F.col("y").alias("error_y"))
    return rounded(J.latest_before(r.filter("evt = 'click'").select("vin", "seq", "ts"), errors, "vin", "ts", "error_ts", ["error_seq", "error_y"]).select("vin", "seq", "error_seq", "error_y"))


@query("SELECT vin, depot_id, EXISTS (SELECT 1 FROM r WHERE r.vin = veh.vin AND evt = 'error' AND k >= 95) AS severe, EXISTS (SELECT 1 FROM r WHERE r.vin = veh.vin AND evt = 'purchase' AND y > 200) AS costly FROM veh")
def semi_exists_flags(spark: SparkSession, sf: str) -> DataFrame:
    r = fleet.readings(spark, sf)
    out = J.flag_exists(fleet.registry(spark, sf).select("vin", "depot_id"), r.filter("evt = 'error' and k >= 95"), ["vin"], "severe")
    return J.flag_exists(out, r.filter("evt = 'purchase' and y > 200"), ["vin"], "costly")


@query("SELECT vin, model_id, duty_type_id FROM veh WHERE vin NOT IN (SELECT vin FROM r WHERE evt = 'error' AND k < 10)")
def anti_sisters(spark: SparkSession, sf: str) -> DataFrame:
    members = fleet.readings(spark, sf).filter("evt = 'error' and k < 10").select("vin")
    return fleet.registry(spark, sf).join(members, "vin", "left_anti").select("vin", "model_id", "duty_type_id")


@query("SELECT a.seq, (SELECT count(*) FROM j b WHERE b.model_id = a.model_id AND b.duty_type_id = a.duty_type_id AND b.evt = 'error' AND b.ts > a.ts - INTERVAL 24 HOUR AND b.ts <= a.ts + INTERVAL 1 HOUR AND b.seq <> a.seq) AS n_24h FROM j a".join([", j AS (SELECT r.*, model_id, duty_type_id FROM r JOIN veh USING (vin)) ", ""]))
def range_count_24h(spark: SparkSession, sf: str) -> DataFrame:
    rows = fleet.readings(spark, sf).join(fleet.registry(spark, sf), "vin")
    return J.counts_in_window(rows, ["model_id", "duty_type_id"], "ts", F.col("evt") == "error", 24 * 3600, 3600, "n_24h").select("seq", "n_24h")


@query("""SELECT s.model_id, s.duty_type_id, s.depot_id, CAST(sum(coalesce(o.own, 0)) AS BIGINT) AS vins, CAST(sum(o.vans) AS BIGINT) AS other_vans, round(coalesce(1000.0 * sum(o.own) / (nullif(sum(o.vans), 0) * 3), 0), 6) AS per_1000 FROM sz s
LEFT JOIN sz o ON o.model_id = s.model_id AND o.duty_type_id = s.duty_type_id AND o.depot_id <> s.depot_id GROUP BY ALL""".join([", sz AS (SELECT model_id, duty_type_id, depot_id, count(*) AS vans, count(*) FILTER (vin IN (SELECT vin FROM r WHERE evt = 'error' AND k >= 80)) AS own FROM veh GROUP BY ALL) ", ""]))
def cohort_rate_excluding_self(spark: SparkSession, sf: str) -> DataFrame:
    vehicles, cohort = fleet.registry(spark, sf), ["model_id", "duty_type_id"]
    sizes = vehicles.groupBy(*cohort, "depot_id").agg(F.count(F.lit(1)).alias("vans"))
    incidents = fleet.readings(spark, sf).filter("evt = 'error' and k >= 80").join(vehicles, "vin")
    return rounded(C.rate_elsewhere(incidents, cohort, "depot_id", sizes, 3.0))


# ---- trends and confirmation


@query(""", t AS (SELECT vin, seq, y, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY vin)) / 3.6e9 AS t FROM r WHERE metric = 'level'),
s AS (SELECT vin, seq, t, sum(exp(t / 48)) OVER o AS s0, sum(exp(t / 48) * t) OVER o AS s1, sum(exp(t / 48) * t * t) OVER o AS s2, sum(exp(t / 48) * y) OVER o AS sy, sum(exp(t / 48) * t * y) OVER o AS sty FROM t WINDOW o AS (PARTITION BY vin ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT vin, seq, round(s0 * exp(-t / 48), 3) AS weight, round(sy / s0, 3) AS mean, CASE WHEN s2 / s0 - (s1 / s0) * (s1 / s0) >= 0.01 THEN round((sty / s0 - s1 / s0 * (sy / s0)) / (s2 / s0 - (s1 / s0) * (s1 / s0)), 3) END AS slope FROM s""")
def trend_ew_batch(spark: SparkSession, sf: str) -> DataFrame:
    rows = fleet.readings(spark, sf).filter("metric = 'level'").select("vin", "seq", "ts", "y")
    return rounded(D.weighted_trend(rows, ["vin"], 48.0).select("vin", "seq", "weight", "mean", "slope"), 3)


def confirmed(spark: SparkSession, sf: str) -> DataFrame:
    return D.k_of_n(fleet.readings(spark, sf), ["vin"], "seq", F.col("y") > 60, 4, 6)


@query("SELECT vin, seq, CAST(recent AS BIGINT) AS recent, recent >= 4 AS confirmed FROM (SELECT vin, seq, sum(CASE WHEN y > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY vin ORDER BY seq ROWS 5 PRECEDING) AS recent FROM r)")
def kofn_confirm(spark: SparkSession, sf: str) -> DataFrame:
    return confirmed(spark, sf).select("vin", "seq", "recent", "confirmed")


@query("SELECT vin, seq, ab AS abnormal, row_number() OVER (PARTITION BY vin, isl ORDER BY seq) AS run FROM (SELECT vin, seq, ab, sum(ch) OVER (PARTITION BY vin ORDER BY seq) AS isl FROM (SELECT vin, seq, y > 60 AS ab, CASE WHEN (y > 60) = lag(y > 60) OVER (PARTITION BY vin ORDER BY seq) THEN 0 ELSE 1 END AS ch FROM r))")
def run_counters(spark: SparkSession, sf: str) -> DataFrame:
    return confirmed(spark, sf).select("vin", "seq", (F.col("abnormal") == 1).alias("abnormal"), "run")


@query(", h AS (SELECT vin, family, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(*) AS n FROM cf GROUP BY ALL) SELECT vin, family, hour, n, CAST(sum(n) OVER (PARTITION BY vin, family ORDER BY hour RANGE BETWEEN 23 PRECEDING AND CURRENT ROW) AS BIGINT) AS n24 FROM h")
def code_ring_24h(spark: SparkSession, sf: str) -> DataFrame:
    return D.codes_in_24h(codes(spark, sf), ["vin", "family"])


@query(""", d AS (SELECT r.vin, r.metric, region_id, duty_type_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, max_by(y - median, seq) AS dev FROM r JOIN veh USING (vin) JOIN own_norm vb ON vb.vin = r.vin AND vb.metric = r.metric GROUP BY ALL),
a AS (SELECT region_id, duty_type_id, metric, hour, median(dev) AS m FROM d GROUP BY ALL HAVING count(*) >= 2), b AS (SELECT region_id, metric, hour, median(dev) AS m FROM d GROUP BY ALL HAVING count(*) >= 2)
SELECT d.vin, d.metric, d.hour, round(dev, 6) AS dev, round(dev - coalesce(a.m, b.m, 0), 6) AS adj, round((dev - coalesce(a.m, b.m, 0)) / (1.4826 * greatest(mad, 0.5)), 6) AS z FROM d JOIN own_norm vb ON vb.vin = d.vin AND vb.metric = d.metric
LEFT JOIN a ON a.region_id = d.region_id AND a.duty_type_id = d.duty_type_id AND a.metric = d.metric AND a.hour = d.hour LEFT JOIN b ON b.region_id = d.region_id AND b.metric = d.metric AND b.hour = d.hour""")
def peer_adjusted_score(spark: SparkSession, sf: str) -> DataFrame:
    base = normal(spark, sf).select("vin", "metric", "median", "mad")
    rows = fleet.readings(spark, sf).join(base, ["vin", "metric"]).join(fleet.registry(spark, sf), "vin").withColumn("dev", F.col("y") - F.col("median"))
    adjusted = D.minus_peers(D.hourly_deviation(rows), 2).join(base, ["vin", "metric"])
    return rounded(adjusted.select("vin", "metric", "hour", "dev", "adj", X.robust_z(F.col("adj"), F.lit(0.0), F.col("mad"), 0.5).alias("z")))


FAMILY_OF = {"level": ("COOLING", Metric(min_mad=3.0, min_slope_mad=0.5, max_rate_per_min=40.0, spike_max=250.0, hard_limit=200.0)), "rate": ("BATTERY", Metric(min_mad=3.0, min_slope_mad=0.5, max_rate_per_min=40.0, spike_max=250.0, hard_limit=None))}
SPARSE_DETECT = Detect(tau_h=48.0, fast_tau_h=24.0, min_weight=1.5, z_level=2.0, min_peers=3)


def detect_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Readings with their normal and peers, codes by family, and repairs (errors of k = 7 stand for them)."""
    r, veh = fleet.readings(spark, sf), fleet.registry(spark, sf)
    base = normal(spark, sf).select("vin", "metric", "median", "mad", "slope_median", "slope_mad")
    scored = D.with_peers(r.filter("metric is not null").select("vin", "metric", "seq", "ts", "y").join(base, ["vin", "metric"]), veh, SPARSE_DETECT)
    usual = fleet.stored(B.codes_per_day(codes(spark, sf), B.days_seen(r)), "usual")
    family = F.when(F.col("metric") == "level", "COOLING").otherwise("BATTERY")
    reads = scored.withColumn("family", family).join(usual.withColumnRenamed("codes_per_day", "usual"), ["vin", "family"], "left").withColumnsRenamed({"metric": "name"}).withColumn("kind", F.lit("READING"))
    many = B.code_rows(fleet.with_codes(r), fleet.families(spark), ("seq",)).groupBy("vin", "seq", "ts", "family").agg(F.count(F.lit(1)).cast("double").alias("y"))
    coded = many.join(usual.withColumnRenamed("codes_per_day", "usual"), ["vin", "family"], "left").withColumnRenamed("family", "name").withColumn("kind", F.lit("CODES"))
    repairs = r.filter("evt = 'error' and k = 7").select("vin", "seq", "ts", F.lit("").alias("name"), F.lit("REPAIR").alias("kind"))
    return reads.select(*D.INPUT).unionByName(coded, allowMissingColumns=True).unionByName(repairs, allowMissingColumns=True).select(*D.INPUT)


@query()
def detect_fold(spark: SparkSession, sf: str) -> DataFrame:
    """The whole detection; tests hold it against a plain loop, and peers, trends, rings and code rates have queries with SQL of their own."""
    with fleet.shared():
        return D.detect_fold(detect_rows(spark, sf), FAMILY_OF, SPARSE_DETECT)


@query("""SELECT g.vin, g.family, g.hour, CAST(g.n24 AS BIGINT) AS n24, round(greatest(3.0, 4 * u.n / days), 6) AS threshold, g.n24 >= greatest(3.0, 4 * u.n / days) AS active
FROM (SELECT vin, family, hour, sum(n) OVER (PARTITION BY vin, family ORDER BY hour RANGE BETWEEN 23 PRECEDING AND CURRENT ROW) AS n24 FROM (SELECT vin, family, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(*) AS n FROM cf GROUP BY ALL)) g
JOIN (SELECT vin, family, count(*) AS n FROM cf GROUP BY ALL) u USING (vin, family) JOIN days USING (vin)""")
def code_rate_active(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.code_rate(codes(spark, sf), B.codes_per_day(codes(spark, sf), B.days_seen(fleet.readings(spark, sf)))))


@query("SELECT vin, metric, min(ts) AS first_hit FROM (SELECT vin, metric, ts, sum(CASE WHEN y > 97 THEN 1 ELSE 0 END) OVER (PARTITION BY vin, metric ORDER BY seq ROWS 5 PRECEDING) AS k FROM r WHERE metric IS NOT NULL) WHERE k >= 4 GROUP BY vin, metric")
def global_rule_hits(spark: SparkSession, sf: str) -> DataFrame:
    return D.global_hits(fleet.readings(spark, sf).filter("metric is not null"), ["vin", "metric"], F.col("y") > 97)


CANON_SQL = """, canon AS (SELECT vin, seq, ts, CASE WHEN evt = 'signup' AND k < 50 THEN 'IGNITION_ON' WHEN evt = 'signup' THEN 'IGNITION_OFF' ELSE 'PERIODIC' END AS evt, k % 5 <> 0 AS ignition, k % 7 = 0 AS charging, CASE WHEN k % 11 <> 0 THEN k * 1.0 END AS speed_kmh, CASE WHEN y < 90 THEN y END AS coolant_c, 11 + k / 50.0 AS lv_batt_v, k % 13 = 0 AS late FROM r)"""


def canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Events as canonical readings: sign-ups turn the ignition, the number k makes the rest."""
    r, k = fleet.readings(spark, sf), F.col("k")
    evt = F.when((F.col("evt") == "signup") & (k < 50), "IGNITION_ON").when(F.col("evt") == "signup", "IGNITION_OFF").otherwise("PERIODIC")
    flags = F.when(k % 13 == 0, F.array(F.lit("LATE"))).otherwise(F.array().cast("array<string>"))
    return r.select("vin", "seq", "ts", evt.alias("evt"), (k % 5 != 0).alias("ignition"), (k % 7 == 0).alias("charging"), F.when(k % 11 != 0, k * 1.0).alias("speed_kmh"), F.when(F.col("y") < 90, F.col("y")).alias("coolant_c"), (11 + k / 50.0).alias("lv_batt_v"), flags.alias("quality_flags"))


@query(CANON_SQL + """, o AS (SELECT *, last_value(CASE WHEN evt = 'IGNITION_ON' THEN {'t': ts} WHEN evt = 'IGNITION_OFF' THEN {'t': CAST(NULL AS TIMESTAMP)} END IGNORE NULLS) OVER (PARTITION BY vin ORDER BY seq ROWS UNBOUNDED PRECEDING).t AS since FROM canon),
q AS (SELECT *, NOT charging AND coalesce(speed_kmh, 0) > 0 AND (since IS NULL OR epoch(ts) - epoch(since) >= 25 * 60) AS moving FROM o WHERE evt = 'PERIODIC' AND ignition AND NOT late)
SELECT vin, seq, 'coolant_c' AS metric, round(coolant_c, 6) AS y FROM q WHERE moving AND coolant_c BETWEEN -40 AND 150 UNION ALL SELECT vin, seq, 'lv_batt_v', round(lv_batt_v, 6) FROM q WHERE lv_batt_v BETWEEN 6 AND 18""")
def qualifying_readings(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.qualifying(canonical(spark, sf), {"coolant_c": (-40, 150), "lv_batt_v": (6, 18)}).drop("ts"))


# ---- roll-ups


@query("SELECT vin, hour, n, round(mean, 6) AS mean, round(most, 6) AS most, round(last_y, 6) AS last_y, codes FROM hr")
def hourly_rollup(spark: SparkSession, sf: str) -> DataFrame:
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    agg = fleet.readings(spark, sf).groupBy("vin", hour).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.max("y").alias("most"), F.max_by("y", "seq").alias("last_y"), F.count_if(F.col("evt") == "error").alias("codes"))
    return rounded(agg)


@query("SELECT vin, count(*) FILTER (evt = 'error') AS codes, round(avg(y) FILTER (metric = 'level'), 6) AS level, max(seq) AS last_seq FROM r WHERE ts > (SELECT max(ts) FROM r) - INTERVAL 24 HOUR GROUP BY vin")
def trailing_24h_filter(spark: SparkSession, sf: str) -> DataFrame:
    r = fleet.readings(spark, sf)
    end = r.agg(F.max("ts").alias("end"))
    last = r.join(F.broadcast(end), F.col("ts") > F.col("end") - F.expr("INTERVAL 24 HOURS"))
    return rounded(last.groupBy("vin").agg(F.count_if(F.col("evt") == "error").alias("codes"), F.avg(F.when(F.col("metric") == "level", F.col("y"))).alias("level"), F.max("seq").alias("last_seq")))


def hourly_means(spark: SparkSession, sf: str) -> DataFrame:
    return fleet.readings(spark, sf).groupBy("vin", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.avg("y").alias("mean"))


def scored_hours(spark: SparkSession, sf: str) -> DataFrame:
    h = hourly_rollup(spark, sf)
    rows = h.select("vin", F.col("hour").alias("ts"), ((F.col("mean") - 50) / 25).alias("z"), ((F.col("most") - 50) / 30).alias("zs"), (F.col("mean") - 50).alias("adj"))
    return fleet.once(sf, "scored-hours", lambda: rows)


@query(""", s AS (SELECT vin, hour AS ts, (round(mean, 6) - 50) / 25 AS z, (round(most, 6) - 50) / 30 AS zs, round(mean, 6) - 50 AS adj, row_number() OVER (PARTITION BY vin ORDER BY hour DESC) AS k FROM hr),
a AS (SELECT vin, max(ts) AS ts, count(*) FILTER (z >= 0.5) AS high, count(*) AS recent, max_by(zs, ts) AS zs, max_by(adj, ts) AS adj FROM s WHERE k <= 4 GROUP BY vin)
SELECT vin, ts, high, recent, high >= 2 OR (zs >= 1 AND adj > 0) AS at_risk, CASE WHEN high >= 2 THEN 'LEVEL' WHEN zs >= 1 AND adj > 0 THEN 'SLOPE' END AS reason FROM a""")
def at_risk_last4(spark: SparkSession, sf: str) -> DataFrame:
    return C.at_risk(scored_hours(spark, sf), ["vin"], Campaign(risk_z=0.5, risk_k=2, risk_slope=1.0))


@query(""", rep AS (SELECT vin, TIMESTAMP '2024-01-20 00:30:00' + to_hours(vin % 24) AS repaired FROM veh), h AS (SELECT vin, hour AS ts, (round(mean, 6) - 50) / 25 AS z FROM hr),
m AS (SELECT rep.vin, repaired, z, row_number() OVER (PARTITION BY rep.vin ORDER BY ts DESC) AS k FROM rep JOIN h ON h.vin = rep.vin AND ts >= repaired + INTERVAL 30 MINUTE AND ts < repaired + INTERVAL 96 HOUR AND ts <= TIMESTAMP '2024-01-23 12:00:00'),
g AS (SELECT vin, count(*) AS driven, count(*) FILTER (k <= 4 AND abs(z) < 1) AS inside, count(*) FILTER (k <= 4) AS recent FROM m GROUP BY vin)
SELECT rep.vin, repaired, coalesce(driven, 0) AS driven, coalesce(inside, 0) AS inside, coalesce(recent, 0) AS recent, CASE WHEN coalesce(driven, 0) >= 4 AND inside >= 3 THEN 'FIXED' WHEN coalesce(driven, 0) >= 8 OR (TIMESTAMP '2024-01-23 12:00:00' >= repaired + INTERVAL 96 HOUR AND coalesce(driven, 0) >= 4) THEN 'NOT_FIXED' ELSE 'PENDING' END AS verdict FROM rep LEFT JOIN g ON g.vin = rep.vin""")
def fix_verdict(spark: SparkSession, sf: str) -> DataFrame:
    repaired = (F.lit("2024-01-20 00:30:00").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("vin") % 24).cast("int"))).alias("repaired")
    repairs = fleet.registry(spark, sf).select("vin", repaired)
    now = F.lit("2024-01-23 12:00:00").cast("timestamp_ntz")
    return Q.fix_verdict(repairs, scored_hours(spark, sf).select("vin", "ts", "z"), now, Fix(band=1.0, inside_k=3, inside_n=4, min_driven_h=4, not_fixed_after_h=8, window_h=96))


@query("SELECT vin, depot_id, duty_type_id, round(rate, 6) AS rate, round(CASE WHEN um > 0 THEN rate / um END, 4) AS ratio FROM b JOIN (SELECT depot_id, duty_type_id, list_sort(list(rate))[len(list(rate)) // 2 + 1] AS um FROM b GROUP BY ALL) USING (depot_id, duty_type_id)".join([", b AS (SELECT r.vin, depot_id, duty_type_id, count(*) FILTER (evt = 'error') / count(*) AS rate FROM r JOIN veh USING (vin) GROUP BY ALL) ", ""]))
def behaviour_ratio(spark: SparkSession, sf: str) -> DataFrame:
    r = fleet.readings(spark, sf).groupBy("vin").agg((F.count_if(F.col("evt") == "error") / F.count(F.lit(1))).alias("rate")).join(fleet.registry(spark, sf), "vin")
    out = Q.behaviour_ratio(r.select("vin", "depot_id", "duty_type_id", "rate"), ["depot_id", "duty_type_id"])
    return out.select("vin", "depot_id", "duty_type_id", F.round("rate", 6).alias("rate"), F.round("ratio", 4).alias("ratio"))


# ---- campaigns


def incidents(spark: SparkSession, sf: str) -> DataFrame:
    rows = fleet.readings(spark, sf).filter("evt = 'error' and k >= 60").join(fleet.registry(spark, sf), "vin")
    return C.bucketed(rows.withColumn("family_key", F.concat_ws("|", (F.col("k") % 2).cast("string"), F.col("model_id").cast("string"), F.col("duty_type_id").cast("string"))))


GROUPS_SQL = """, inc AS (SELECT r.vin, r.seq, ts, (k % 2) || '|' || model_id || '|' || duty_type_id AS family_key, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS b, model_id, duty_type_id FROM r JOIN veh USING (vin) WHERE evt = 'error' AND k >= 60),
g0 AS (SELECT family_key, b, sum(new) OVER (PARTITION BY family_key ORDER BY b) AS grp FROM (SELECT family_key, b, CASE WHEN b - lag(b) OVER (PARTITION BY family_key ORDER BY b) <= 1 THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT family_key, b FROM inc))),
gs AS (SELECT family_key, CAST(grp AS BIGINT) AS grp, min(b) AS first_bucket, max(b) AS last_bucket, count(DISTINCT vin) AS members FROM inc JOIN g0 USING (family_key, b) GROUP BY ALL)
"""


@query(GROUPS_SQL + "SELECT * FROM gs")
def group_touching_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return C.touching_groups(incidents(spark, sf), "family_key", "b")


@query(GROUPS_SQL + """, sz AS (SELECT model_id, duty_type_id, count(*) AS vans FROM veh GROUP BY ALL), tot AS (SELECT model_id, duty_type_id, sum(vehicle_days) AS days, sum(codes) AS codes FROM fault WHERE family = 'COOLING' GROUP BY ALL),
l AS (SELECT gs.*, sz.vans * (last_bucket - first_bucket + 1) * greatest(2.0, 20.0 * codes / days) / 1000 AS lam, 20.0 * codes / days > 2 AS known FROM gs JOIN sz ON split_part(family_key, '|', 2) = CAST(sz.model_id AS VARCHAR) AND split_part(family_key, '|', 3) = CAST(sz.duty_type_id AS VARCHAR) JOIN tot USING (model_id, duty_type_id)),
pt AS (SELECT l.*, 1 - coalesce((SELECT sum(exp(i * ln(lam) - lam - lgamma(i + 1))) FROM range(0, members) AS x(i)), 0) AS p FROM l)
SELECT family_key, grp, members, round(lam, 6) AS "lambda", CASE WHEN known THEN 'baseline' ELSE 'floor' END AS rate_source, round(greatest(p, 0), 6) AS p_value, members >= 2 AND p < 0.01 AS opens FROM pt""")
def campaign_open_poisson(spark: SparkSession, sf: str) -> DataFrame:
    """Every group against its own cohort: its vehicles, and its rate of cooling codes (a fiftieth of them stands for incidents)."""
    vehicles, cohort = fleet.registry(spark, sf), ["model_id", "duty_type_id"]
    sizes = vehicles.groupBy(*cohort).agg(F.count(F.lit(1)).alias("vans"))
    known = rates(spark, sf).filter("family = 'COOLING'").groupBy(*cohort).agg((F.sum("codes") * 20.0 / F.sum("vehicle_days")).alias("baseline_per_1000"))
    part = lambda i: F.split_part("family_key", F.lit("|"), F.lit(i)).cast("long")
    groups = group_touching_buckets(spark, sf).withColumns({"model_id": part(2), "duty_type_id": part(3)}).join(sizes, cohort).join(known, cohort).withColumn("regional_per_1000", F.lit(0.0))
    out = C.chance(groups, Campaign(min_vans=2, alpha=0.01)).select("family_key", "grp", "members", "lambda", "rate_source", "p_value", "opens")
    return rounded(out, 6)


@query(""", m AS (SELECT DISTINCT model_id AS grp, vin, CASE WHEN vin % 4 <> 0 THEN 'v' || (vin % 3) END AS version FROM veh WHERE vin IN (SELECT vin FROM r WHERE evt = 'error' AND k >= 97)),
s AS (SELECT model_id AS grp, vin, CASE WHEN vin % 4 <> 0 THEN 'v' || (vin % 3) END AS version FROM veh WHERE vin NOT IN (SELECT vin FROM m)),
t AS (SELECT grp, version, members_with FROM (SELECT grp, version, count(*) AS members_with, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, version) AS k FROM m WHERE version IS NOT NULL GROUP BY grp, version) WHERE k = 1)
SELECT t.grp, t.version, members_with, (SELECT count(*) FROM m WHERE m.grp = t.grp) AS members, (SELECT count(*) FROM s WHERE s.grp = t.grp AND s.version = t.version) AS sisters_with, (SELECT count(*) FROM s WHERE s.grp = t.grp) AS sisters FROM t""")
def firmware_style_share(spark: SparkSession, sf: str) -> DataFrame:
    v = fleet.registry(spark, sf).select(F.col("model_id").alias("grp"), "vin", F.when(F.col("vin") % 4 != 0, F.concat(F.lit("v"), (F.col("vin") % 3).cast("string"))).alias("version"))
    hit = fleet.readings(spark, sf).filter("evt = 'error' and k >= 97").select("vin").distinct()
    return C.modal_share(v.join(hit, "vin", "left_semi"), v.join(hit, "vin", "left_anti"), "grp").drop("shown")


@query("SELECT model_id, code, vins, rank FROM (SELECT model_id, code, count(DISTINCT vin) AS vins, row_number() OVER (PARTITION BY model_id ORDER BY count(DISTINCT vin) DESC, code) AS rank FROM cf JOIN veh USING (vin) GROUP BY model_id, code) WHERE rank <= 3")
def top_codes(spark: SparkSession, sf: str) -> DataFrame:
    return C.top_codes(codes(spark, sf).join(fleet.registry(spark, sf), "vin"), ["model_id"])


@query("""SELECT id, other_id, sim AS similarity, rank FROM (SELECT a.vec_id AS id, b.vec_id AS other_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) / sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS sim,
row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) / sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= 3""", roles=False)
def cosine_top3(spark: SparkSession, sf: str) -> DataFrame:
    """The search's queries are the rows whose id is divisible by 50, against all rows."""
    v = fleet.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return C.most_similar(v.filter("id % 50 = 0"), v)


@query()
def campaign_fold(spark: SparkSession, sf: str) -> DataFrame:
    acts = incidents(spark, sf).select("family_key", "seq", "ts", F.lit("INCIDENT").alias("kind"), "vin", (F.col("k") >= 98).alias("runaway"), F.lit(20).alias("vans"), F.lit(4.0).alias("per_1000"))
    fixes = acts.filter("seq % 3 = 0").withColumns({"kind": F.when(F.col("seq") % 2 == 0, "FIXED").otherwise("NOT_FIXED"), "ts": F.col("ts") + F.expr("INTERVAL 30 HOURS"), "runaway": F.lit(False)})
    return C.campaign_fold(acts.unionByName(fixes), Campaign(min_vans=2, alpha=0.05))


# ---- queue


def candidates(spark: SparkSession, sf: str, before: str = "2024-02-01") -> DataFrame:
    r = fleet.readings(spark, sf).filter(F.col("ts") < F.lit(before).cast("timestamp_ntz"))
    worst = F.max(F.when(F.col("evt") == "error", F.col("y")))
    severity = F.when(worst > 250, 1.0).when(worst > 150, 0.7).when(worst > 80, 0.4).otherwise(0.0)
    agg = r.groupBy("vin").agg(severity.alias("severity"), F.when(worst > 200, F.round(300 - worst, 2)).alias("hours_left"), F.max(F.when(F.col("metric") == "rate", F.col("k") / 25.0)).alias("z_slope"), F.count_if((F.col("evt") == "error") & (F.col("k") > 70)).alias("members"), F.count_if(F.col("k") == 50).alias("at_risk_groups"))
    return agg.join(fleet.registry(spark, sf).select("vin", "depot_id"), "vin").withColumns({"in_service": F.col("vin") % 2 == 0, "behaviour": 1 + (F.col("vin") % 4) * 0.5, "not_fixed": F.col("vin") % 9 == 0, "at_risk_only": (F.col("members") == 0) & (F.col("vin") % 9 != 0)})


def ranked(spark: SparkSession, sf: str, before: str = "2024-02-01") -> DataFrame:
    return Q.rank(Q.score(candidates(spark, sf, before)))


def _queue_sql(n: str, before: str) -> str:
    return f""", c{n} AS (SELECT r.vin, depot_id, max(y) FILTER (evt = 'error') AS worst, max(k / 25.0) FILTER (metric = 'rate') AS zs, count(*) FILTER (evt = 'error' AND k > 70) AS members, count(*) FILTER (k = 50) AS arg FROM r JOIN veh USING (vin) WHERE ts < TIMESTAMP '{before}' GROUP BY ALL),
p{n} AS (SELECT vin, depot_id, CASE WHEN worst > 250 THEN 1.0 WHEN worst > 150 THEN 0.7 WHEN worst > 80 THEN 0.4 ELSE 0.0 END AS severity, CASE WHEN worst > 200 THEN round(300 - worst, 2) END AS hl, coalesce(zs, 0) AS zs, members, arg FROM c{n}),
q{n} AS (SELECT vin, depot_id, severity >= 1 AS pinned, hl, round(CAST((0.35 * severity + 0.25 * greatest(least(1, greatest(0, zs / 4)), coalesce(least(1, greatest(0, 1 - hl / 72)), 0))) * CASE WHEN members = 0 AND vin % 9 <> 0 THEN 0.5 ELSE 1 END + 0.2 * greatest(least(1, log2(1 + members) / log2(21)), 0.5 * least(1, log2(1 + arg) / log2(21))) + 0.1 * CASE WHEN vin % 2 = 0 THEN 1 ELSE 0 END + 0.1 * (vin % 4) * 0.5 / 2 + 0.15 * CASE WHEN vin % 9 = 0 THEN 1 ELSE 0 END AS DOUBLE), 6) AS score FROM p{n}),
k{n} AS (SELECT *, row_number() OVER (PARTITION BY depot_id ORDER BY pinned DESC, CASE WHEN pinned THEN hl END ASC NULLS LAST, score DESC, vin) AS rank FROM q{n}),
e{n} AS (SELECT k.*, pinned OR score >= 0.4 AS eligible, 1 + depot_id % 3 AS bays FROM k{n} k),
s{n} AS (SELECT *, CASE WHEN NOT eligible THEN 'WAITING' WHEN row_number() OVER (PARTITION BY depot_id, eligible ORDER BY rank) <= bays THEN 'TODAY' WHEN row_number() OVER (PARTITION BY depot_id, eligible ORDER BY rank) <= 2 * bays THEN 'TOMORROW' ELSE 'WAITING' END AS slot FROM e{n}),
f{n} AS (SELECT *, CASE WHEN slot = 'TODAY' THEN 0 WHEN slot = 'TOMORROW' THEN 1 ELSE 2 + (row_number() OVER (PARTITION BY depot_id, slot ORDER BY rank) - 1) // bays END AS wait_days FROM s{n})
"""


QUEUE_SQL = _queue_sql("", "2024-02-01")


@query(QUEUE_SQL + "SELECT depot_id, vin, score, pinned, rank FROM f")
def queue_score_rank(spark: SparkSession, sf: str) -> DataFrame:
    return ranked(spark, sf).select("depot_id", "vin", "score", "pinned", "rank")


def filled(spark: SparkSession, sf: str, before: str = "2024-02-01") -> DataFrame:
    bays = fleet.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("depot_id"), (1 + F.col("n_nationkey") % 3).alias("bays"))
    return Q.fill_bays(ranked(spark, sf, before), bays, Queue())


@query(QUEUE_SQL + "SELECT depot_id, vin, rank, slot, CAST(wait_days AS BIGINT) AS wait_days FROM f")
def bay_fill(spark: SparkSession, sf: str) -> DataFrame:
    return filled(spark, sf).select("depot_id", "vin", "rank", "slot", "wait_days")


@query(QUEUE_SQL + "SELECT depot_id, string_agg(vin || ':' || slot, ',' ORDER BY rank) AS signature FROM f GROUP BY depot_id")
def queue_signature(spark: SparkSession, sf: str) -> DataFrame:
    return Q.signature(filled(spark, sf).withColumn("vin", F.col("vin").cast("string")))


@query(QUEUE_SQL + _queue_sql("2", "2024-01-20") + "SELECT coalesce(f.vin, f2.vin) AS vin, f2.slot AS old_slot, f.slot AS new_slot, CASE WHEN f2.vin IS NULL THEN 'CREATED' WHEN f.vin IS NULL THEN 'WITHDRAWN' ELSE 'UPDATED' END AS change FROM f FULL JOIN f2 ON f.vin = f2.vin WHERE f.slot IS DISTINCT FROM f2.slot")
def queue_diff(spark: SparkSession, sf: str) -> DataFrame:
    return J.changes(filled(spark, sf, "2024-01-20"), filled(spark, sf), ["vin"], ["slot"])


@query()
def bookings_place(spark: SparkSession, sf: str) -> DataFrame:
    booking = F.when(F.col("vin") % 11 == 0, "TODAY").when(F.col("vin") % 11 == 1, "TOMORROW")
    rows = filled(spark, sf).select("depot_id", "vin", F.col("rank").cast("int"), "pinned", "eligible", booking.alias("booking"), F.lit(2).alias("per_day"))
    return Q.place_bookings(rows)


@query(QUEUE_SQL + "SELECT a.depot_id, a.vin AS louder, b.vin AS calmer, b.rank - a.rank AS gap FROM f a JOIN f b ON a.depot_id = b.depot_id AND a.rank < b.rank AND a.rank <= 3 AND b.rank <= 3")
def snapshot_explode_rank_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot holds each depot's first three as one array; pairs come from exploding it twice."""
    top = filled(spark, sf).filter("rank <= 3").groupBy("depot_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vin"))).alias("items"))
    one = top.select("depot_id", "items", F.explode("items").alias("a")).select("depot_id", "a", F.explode("items").alias("b"))
    return one.filter("a.rank < b.rank").select("depot_id", F.col("a.vin").alias("louder"), F.col("b.vin").alias("calmer"), (F.col("b.rank") - F.col("a.rank")).alias("gap"))


# ---- evaluation


@query("SELECT evt AS role, count(*) AS n, count(*) FILTER (y > 100) AS high, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY y), 6) AS median, round(max(y), 6) AS most, bool_or(k = 99) AS any_99, min(k) AS least_k FROM r GROUP BY evt")
def scorecard_by_role(spark: SparkSession, sf: str) -> DataFrame:
    agg = fleet.readings(spark, sf).groupBy(F.col("evt").alias("role")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") > 100).alias("high"), F.percentile("y", 0.5).alias("median"), F.max("y").alias("most"), F.bool_or(F.col("k") == 99).alias("any_99"), F.min("k").alias("least_k"))
    return rounded(agg)


def scored_labels(spark: SparkSession, sf: str) -> DataFrame:
    return fleet.readings(spark, sf).select(F.to_date("ts").cast("string").alias("day"), F.col("seq").alias("id"), F.col("k").alias("score"), (F.col("y") + F.col("k") > 120).cast("int").alias("label"))


@query("SELECT CAST(day AS VARCHAR) AS day, count(*) AS n, round(avg(CASE WHEN y + k > 120 THEN 1.0 ELSE 0.0 END), 6) AS precision FROM (SELECT CAST(ts AS DATE) AS day, y, k, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY k DESC, seq) AS rn FROM r) WHERE rn <= 10 GROUP BY day")
def precision_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.precision_at_k(scored_labels(spark, sf), ["day"], 10), 6)


@query(""", s AS (SELECT CAST(ts AS DATE) AS day, k, sum(CASE WHEN y + k > 120 THEN 1 ELSE 0 END) AS tp, count(*) AS n FROM r GROUP BY ALL), w AS (SELECT day, tp, sum(tp) OVER (PARTITION BY day ORDER BY k DESC) AS tps, sum(n) OVER (PARTITION BY day ORDER BY k DESC) AS ns, sum(tp) OVER (PARTITION BY day) AS al FROM s)
SELECT CAST(day AS VARCHAR) AS day, round(sum(CASE WHEN al > 0 THEN tp / al * tps / ns END), 6) AS average_precision FROM w GROUP BY day""")
def avg_precision(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.average_precision(scored_labels(spark, sf), ["day"]), 6)


@query("SELECT label, count(*) FILTER (k >= 60) AS \"1\", count(*) FILTER (k < 60) AS \"0\" FROM (SELECT CASE WHEN y + k > 120 THEN 1 ELSE 0 END AS label, k FROM r) GROUP BY label".replace("SELECT label", "SELECT CAST(label AS BIGINT) AS label", 1))
def confusion_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.confusion(scored_labels(spark, sf).withColumn("ours", (F.col("score") >= 60).cast("int")), "label", "ours", [0, 1]))


@query("SELECT vin, hour, " + ", ".join(f"round(avg(mean) OVER (PARTITION BY vin ORDER BY hour ROWS {n - 1} PRECEDING), 8) AS avg_{n}, round(max(mean) OVER (PARTITION BY vin ORDER BY hour ROWS {n - 1} PRECEDING), 8) AS max_{n}, round(sum(mean) OVER (PARTITION BY vin ORDER BY hour ROWS {n - 1} PRECEDING), 8) AS sum_{n}" for n in (3, 6, 24)) + ", round(mean - lag(mean, 6) OVER (PARTITION BY vin ORDER BY hour), 8) AS delta_6 FROM hr")
def features_trailing(spark: SparkSession, sf: str) -> DataFrame:
    f = E.trailing_features(hourly_means(spark, sf), "vin", "hour", "mean").drop("mean")
    return f.select("vin", "hour", *[F.round(c, 8).alias(c) for c in f.columns[2:]])


@query("SELECT hr.vin, hour, CASE WHEN fe IS NOT NULL AND fe <= hour + INTERVAL 25 HOUR THEN 1 ELSE 0 END AS label FROM hr LEFT JOIN (SELECT vin, min(ts) AS fe FROM r WHERE evt = 'error' AND k >= 90 GROUP BY vin) e ON e.vin = hr.vin WHERE fe IS NULL OR fe > hour + INTERVAL 1 HOUR".replace("CASE WHEN fe IS NOT NULL", "CAST(CASE WHEN fe IS NOT NULL", 1).replace("ELSE 0 END AS label", "ELSE 0 END AS BIGINT) AS label", 1))
def label_next24h(spark: SparkSession, sf: str) -> DataFrame:
    severe = fleet.readings(spark, sf).filter("evt = 'error' and k >= 90")
    return rounded(E.label_within(hourly_rollup(spark, sf).select("vin", "hour"), severe, "vin", "hour", "ts"))


# ---- views


@query("SELECT seq, vin, ts FROM r WHERE evt = 'error' AND (ts < TIMESTAMP '2024-01-20' OR (ts = TIMESTAMP '2024-01-20' AND seq < 100000)) ORDER BY ts DESC, seq DESC LIMIT 50")
def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    import datetime

    rows = fleet.readings(spark, sf).filter("evt = 'error'").select("seq", "vin", "ts")
    return E.page(rows, "ts", "seq", (datetime.datetime(2024, 1, 20), 100_000), 50)


@query("SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN c_name END AS c_name, CASE WHEN c_nationkey % 2 = 0 THEN round(c_acctbal, 2) END AS c_acctbal, c_mktsegment FROM customer", roles=False)
def masked_view(spark: SparkSession, sf: str) -> DataFrame:
    """Names and balances only for those who may see them."""
    may = F.col("c_nationkey") % 2 == 0
    c = fleet.table(spark, sf, "customer")
    return c.select("c_custkey", F.when(may, F.col("c_name")).alias("c_name"), F.when(may, F.round("c_acctbal", 2)).alias("c_acctbal"), "c_mktsegment")


@query("SELECT o_orderkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2", roles=False)
def tenant_view(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of one tenant (a region) through their owners."""
    owned = fleet.table(spark, sf, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    customers = fleet.table(spark, sf, "customer").join(F.broadcast(owned), "c_nationkey", "left_semi").select(F.col("c_custkey").alias("o_custkey"))
    return fleet.table(spark, sf, "orders").join(customers, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT r.vin, r.seq, r.metric, round(median - 3 * 1.4826 * greatest(mad, 0.5), 8) AS low, round(median + 3 * 1.4826 * greatest(mad, 0.5), 8) AS high, CASE WHEN y > median + 3 * 1.4826 * greatest(mad, 0.5) THEN 'ABOVE' WHEN y < median - 3 * 1.4826 * greatest(mad, 0.5) THEN 'BELOW' END AS flag FROM r JOIN own_norm vb ON vb.vin = r.vin AND vb.metric = r.metric")
def vehicle_vs_band(spark: SparkSession, sf: str) -> DataFrame:
    low, high = X.band(F.col("median"), F.col("mad"), 0.5)
    rows = fleet.readings(spark, sf).join(normal(spark, sf), ["vin", "metric"]).select("vin", "seq", "metric", "y", low.alias("low"), high.alias("high"))
    flag = F.when(F.col("y") > F.col("high"), "ABOVE").when(F.col("y") < F.col("low"), "BELOW")
    return rounded(rows.withColumn("flag", flag).drop("y"), 8)


# ---- streams


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    s = jobs.file_stream(spark, sf, "events.parquet", "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    return s.select(F.col("user_id").alias("vin"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("y"))


@query("SELECT vin, hour, n, round(total, 6) AS total, round(most, 6) AS most FROM (SELECT vin, hour, n, mean * n AS total, most FROM hr)")
def stream_hourly_rollup(spark: SparkSession, sf: str) -> DataFrame:
    out = fleet.scratch(spark, "hourly")
    jobs.run_updates(jobs.hourly(event_stream(spark, sf)), f"{out}/rows", f"{out}/checkpoint")
    rows = spark.read.parquet(f"{out}/rows")
    now = rows.groupBy("vin", "hour").agg(F.max_by(F.struct("n", "total", "most"), "batch").alias("x"))
    return rounded(now.select("vin", F.col("hour").cast("timestamp_ntz").alias("hour"), "x.n", "x.total", "x.most"))


@query("SELECT vin, count(*) AS n, count(DISTINCT seq) AS seqs FROM r GROUP BY vin")
def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Each message is sent twice; the stream keeps one."""
    out = fleet.scratch(spark, "deduped")
    s = event_stream(spark, sf)
    jobs.run_available(jobs.deduped(s.unionByName(s)), f"{out}/rows", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows").groupBy("vin").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("seq").alias("seqs"))
