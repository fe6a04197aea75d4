"""Fleet queries on checks, pages, feeds, evaluation and the classifier, each with SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import campaigns as C
from ..operators import checks as K
from ..operators import evaluate as E
from ..operators import intake as I
from ..operators import joins as J
from ..operators import learn as L
from ..operators import pages as P
from ..params import Campaign
from . import fleet
from .queries import BAD_VIN, GOOD_VIN, GROUPS_SQL, QUEUE_SQL, codes, filled, hourly_means, incidents, query, rounded, scored_hours
from .queries import group_touching_buckets as groups

NS = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
UUID_SQL = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


def count() -> Column:
    return F.count(F.lit(1))


def errors(spark: SparkSession, sf: str) -> DataFrame:
    return fleet.readings(spark, sf).filter("evt = 'error'")


# ---- checks


#: A unit's n-th message: its counter starts anew at the 15th, its odometer and charge jump now and then.
INTAKE_SQL = """, m AS (SELECT vin, n, CASE WHEN n < 15 THEN 5000 + n ELSE n END AS seq, ts, CASE WHEN k % 11 <> 3 THEN CAST(n * 10 - CASE WHEN k % 13 = 5 THEN 55 ELSE 0 END AS DOUBLE) END AS odo, CASE WHEN k % 7 <> 2 THEN 90 - n * 0.25 + CASE WHEN k % 5 = 1 THEN 6 ELSE 0 END END AS soc, k % 4 <> 0 AS driving, k % 9 = 0 AS engine
  FROM (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY ts, seq) - 1 AS n FROM r)),
s AS (SELECT vin, n, seq, odo, soc, '' AS flags, coalesce(odo, -1e9) AS o, coalesce(soc, 1e9) AS c, driving FROM m WHERE n = 0
  UNION ALL SELECT m.vin, m.n, m.seq, CASE WHEN NOT bad_o THEN m.odo END, CASE WHEN NOT bad_c THEN m.soc END, concat_ws(',', CASE WHEN bad_o THEN 'ODOMETER_BACKWARDS' END, CASE WHEN bad_c THEN 'SOC_RISING_WHILE_DRIVING' END, CASE WHEN m.n = 15 THEN 'SEQ_RESET' END),
    CASE WHEN bad_o OR m.odo IS NULL THEN before_o ELSE m.odo END, CASE WHEN bad_c OR m.soc IS NULL THEN before_c ELSE m.soc END, m.driving
  FROM s JOIN m ON m.vin = s.vin AND m.n = s.n + 1, LATERAL (SELECT CASE WHEN m.n = 15 THEN -1e9 ELSE s.o END AS before_o, CASE WHEN m.n = 15 THEN 1e9 ELSE s.c END AS before_c, m.n <> 15 AND s.driving AS drove) b,
  LATERAL (SELECT coalesce(m.odo < before_o - 0.01, false) AS bad_o, coalesce(drove AND m.driving AND NOT m.engine AND before_c < 1e8 AND m.soc > before_c + 0.5, false) AS bad_c) x)
SELECT vin, seq, odo AS odo_km, soc AS soc_pct, flags FROM s"""


def arriving(spark: SparkSession, sf: str) -> DataFrame:
    n, k = F.row_number().over(Window.partitionBy("vin").orderBy("ts", "seq")) - 1, F.col("k")
    rows = fleet.readings(spark, sf).withColumn("n", n)
    odo = F.when(k % 11 != 3, F.col("n") * 10 - F.when(k % 13 == 5, 55).otherwise(0)).cast("double")
    soc = F.when(k % 7 != 2, 90 - F.col("n") * 0.25 + F.when(k % 5 == 1, 6).otherwise(0))
    return rows.select("vin", F.col("n").alias("arrival"), F.when(F.col("n") < 15, F.col("n") + 5000).otherwise(F.col("n")).cast("long").alias("seq"), "ts", odo.alias("odo_km"), soc.alias("soc_pct"), (k % 4 != 0).alias("driving"), (k % 9 == 0).alias("engine"))


@query(INTAKE_SQL)
def jump_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Odometers that fall back, charge that rises on the road, counters that start anew: what a message shows is judged by what was believed before it, and nothing before a reset counts."""
    return I.intake(arriving(spark, sf)).select("vin", "seq", "odo_km", "soc_pct", "flags")


@query(INTAKE_SQL.replace("SELECT vin, seq, odo AS odo_km, soc AS soc_pct, flags FROM s", "SELECT vin, seq, CASE WHEN n = 15 THEN 'SEQ_RESET' ELSE 'NEW' END AS outcome FROM s"))
def intake_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Every message comes twice: the second is gone."""
    rows = arriving(spark, sf)
    again = rows.withColumns({"arrival": F.col("arrival") * 2, "copy": F.explode(F.array(F.lit(0), F.lit(1)))}).withColumn("arrival", (F.col("arrival") + F.col("copy")).cast("long")).drop("copy")
    return I.intake(again).select("vin", "seq", "outcome")


@query(""", a AS (SELECT seq, vin % 4 AS part, CASE WHEN k = 50 THEN 600000 ELSE k * 100 END - CAST(seq % 1000 AS BIGINT) AS off, row_number() OVER (PARTITION BY vin % 4 ORDER BY seq) - 1 AS n FROM r),
m AS (SELECT part, (n + 1) // 64 AS b, list_sort(list(off) OVER (PARTITION BY part ORDER BY n ROWS 511 PRECEDING)) AS o, n FROM a), t AS (SELECT part, b, o[len(o) // 2 + 1] AS mid FROM m WHERE n % 64 = 63)
SELECT seq, off - mid > 120000 AS ahead FROM a LEFT JOIN t ON t.part = a.part AND t.b = a.n // 64""")
def clock_skew(spark: SparkSession, sf: str) -> DataFrame:
    r = fleet.readings(spark, sf)
    event = F.when(F.col("k") == 50, 600_000).otherwise(F.col("k") * 100).cast("long")
    rows = r.select("seq", (F.col("vin") % 4).alias("part"), event.alias("event_ms"), (F.col("seq") % 1000).alias("ingest_ms"))
    return K.clock_ahead(rows, ["part"], "seq", "event_ms", "ingest_ms").select("seq", "ahead")


@query("SELECT 'lineitem.order' AS reference, count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') UNION ALL SELECT 'orders.customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)", roles=False)
def referential_checks(spark: SparkSession, sf: str) -> DataFrame:
    """References to parents of which some are left out on purpose."""
    t = lambda n: fleet.table(spark, sf, n)
    a = K.orphans(t("lineitem"), t("orders").filter("o_orderstatus <> 'P'"), {"l_orderkey": "o_orderkey"}, "lineitem.order")
    return a.unionByName(K.orphans(t("orders"), t("customer").filter("c_acctbal >= 0"), {"o_custkey": "c_custkey"}, "orders.customer"))


@query("SELECT 'in' AS counter, evt AS label, count(*) AS n FROM r GROUP BY evt UNION ALL SELECT 'metric', metric, count(*) FROM r GROUP BY metric UNION ALL SELECT 'code', code, count(*) FROM codes GROUP BY code")
def batch_counters(spark: SparkSession, sf: str) -> DataFrame:
    r = fleet.readings(spark, sf)
    return K.counters({"in": (r, F.col("evt")), "metric": (r, F.col("metric")), "code": (codes(spark, sf), F.col("code"))})


@query("SELECT anomaly, round(rate, 6) AS rate, expected, rate BETWEEN expected * 0.7 AND expected * 1.3 AS holds FROM (SELECT unnest(['errors', 'high', 'late']) AS anomaly, unnest([avg(if(evt = 'error', 1.0, 0)), avg(if(k >= 90, 1.0, 0)), avg(if(seq < before, 1.0, 0))]) AS rate, unnest([CAST(0.25 AS DOUBLE), 0.1, 0.5]) AS expected FROM (SELECT *, max(seq) OVER (PARTITION BY vin ORDER BY seq + CASE WHEN seq % 5 = 0 THEN 1500 ELSE 0 END, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r))")
def anomaly_rates(spark: SparkSession, sf: str) -> DataFrame:
    arrival = F.col("seq") + F.when(F.col("seq") % 5 == 0, 1500).otherwise(0)
    w = Window.partitionBy("vin").orderBy(arrival, "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = fleet.readings(spark, sf).withColumn("before", F.max("seq").over(w))
    flags = {"errors": (F.col("evt") == "error", 0.25), "high": (F.col("k") >= 90, 0.1), "late": (F.coalesce(F.col("seq") < F.col("before"), F.lit(False)), 0.5)}
    return rounded(K.rates_as_expected(rows, flags))


@query("SELECT vin, round(count(*) FILTER (evt = 'error') / count(DISTINCT CAST(ts AS DATE)), 6) AS errors_a_day, round(avg(y) FILTER (metric = 'level'), 6) AS level, round((epoch(max(ts)) - epoch(min(ts))) / 3600, 6) AS span_h FROM r GROUP BY vin")
def daily_rates(spark: SparkSession, sf: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    agg = fleet.readings(spark, sf).groupBy("vin").agg((F.count_if(F.col("evt") == "error") / F.countDistinct(F.to_date("ts"))).alias("errors_a_day"), F.avg(F.when(F.col("metric") == "level", F.col("y"))).alias("level"), ((F.max(us) - F.min(us)) / 3.6e9).alias("span_h"))
    return rounded(agg)


@query("SELECT count(*) FILTER (k < 50) AS only_left, count(*) FILTER (k >= 90) AS only_right, false AS same FROM r WHERE evt = 'error'")
def set_equality(spark: SparkSession, sf: str) -> DataFrame:
    e = errors(spark, sf).select("vin", "seq", "k")
    return K.same_rows(e.filter("k < 90"), e.filter("k >= 50"))


@query("SELECT 'r1' AS run_id, count(*) AS rows_read, count(DISTINCT vin) AS vins, min(ts) AS first_ts, max(ts) AS last_ts FROM r")
def run_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return K.run_row(fleet.readings(spark, sf), "r1")


@query(f"SELECT seq, CASE WHEN seq % 9 = 0 THEN 'MALFORMED' WHEN seq % 10 = 3 THEN 'INVALID_VIN' WHEN seq % 11 = 0 THEN 'INVALID_TIME' END AS problem, CASE WHEN seq % 9 <> 0 THEN CASE WHEN seq % 10 = 3 THEN '{BAD_VIN}' ELSE '{GOOD_VIN}' END END AS vin FROM r")
def repair_messages(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("seq")
    time = F.when(i % 11 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    body = F.to_json(F.struct(F.when(i % 10 == 3, BAD_VIN).otherwise(GOOD_VIN).alias("vin"), time.alias("repairedTs")))
    rows = fleet.readings(spark, sf).select("seq", F.when(i % 9 == 0, F.substring(body, 1, 9)).otherwise(body).alias("value"))
    return K.repair_messages(rows).select("seq", "problem", "vin")


# ---- joins on state


@query("SELECT vin, (vin + 2) % 25 AS depot, n_name FROM veh JOIN nation ON n_nationkey = (vin + 2) % 25")
def current_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Each unit's open assignment (no end) and its depot's name."""
    vins, day = fleet.registry(spark, sf).select("vin"), lambda x: F.lit(x).cast("timestamp_ntz")
    past = vins.select("vin", (F.col("vin") % 25).alias("depot"), day("2024-01-25").alias("valid_to"))
    now = vins.select("vin", ((F.col("vin") + 2) % 25).alias("depot"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    names = fleet.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("depot"), "n_name")
    return past.unionByName(now).filter("valid_to is null").join(F.broadcast(names), "depot").select("vin", "depot", "n_name")


@query("SELECT a.vin, a.seq, EXISTS (SELECT 1 FROM r b WHERE b.vin = a.vin AND b.evt = 'error' AND b.k >= 90 AND b.ts <= a.ts + INTERVAL 1 HOUR AND (b.k = 99 OR b.ts + INTERVAL 48 HOUR > a.ts)) AS own_open FROM r a")
def incident_open_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of k 90 and more open for two days, those of 99 for good."""
    r = fleet.readings(spark, sf)
    spans = r.filter("evt = 'error' and k >= 90").select("vin", F.col("ts").alias("start"), F.when(F.col("k") < 99, F.col("ts") + F.expr("INTERVAL 48 HOURS")).alias("end"))
    return P.open_at(r.select("vin", "seq", "ts"), spans, ["vin"], "ts", "own_open").select("vin", "seq", "own_open")


@query(GROUPS_SQL + "SELECT DISTINCT vin, family_key, EXISTS (SELECT 1 FROM inc b WHERE b.vin = inc.vin AND b.family_key <> inc.family_key) AS elsewhere FROM inc")
def member_elsewhere(spark: SparkSession, sf: str) -> DataFrame:
    return P.elsewhere(incidents(spark, sf).select("vin", "family_key").distinct(), ["vin"], "family_key")


@query("SELECT vin, kinds, signals, round(weight, 6) AS weight FROM (SELECT vin, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS signals, max(weight) AS weight FROM (SELECT vin, 'INCIDENT' AS kind, y AS weight FROM r WHERE evt = 'error' AND k >= 80 UNION ALL SELECT vin, 'CAMPAIGN', k / 10.0 FROM r WHERE evt = 'error' AND k < 5 UNION ALL SELECT vin, 'AT_RISK', NULL FROM r WHERE evt = 'view' AND k = 42 UNION ALL SELECT vin, 'NOT_FIXED', NULL FROM veh WHERE vin % 9 = 0) GROUP BY vin)")
def merged_signals(spark: SparkSession, sf: str) -> DataFrame:
    r = fleet.readings(spark, sf)
    return rounded(P.merged_signals({
        "INCIDENT": r.filter("evt = 'error' and k >= 80").select("vin", F.col("y").alias("weight")), "CAMPAIGN": r.filter("evt = 'error' and k < 5").select("vin", (F.col("k") / 10.0).alias("weight")),
        "AT_RISK": r.filter("evt = 'view' and k = 42").select("vin"), "NOT_FIXED": fleet.registry(spark, sf).filter("vin % 9 = 0").select("vin"),
    }))


@query("SELECT vin, CAST(ord AS BIGINT) AS ord, CAST(code AS BIGINT) AS code FROM (SELECT vin, unnest([0, 1]) AS ord, unnest([k, k + 7]) AS code FROM (SELECT vin, max_by(k, seq) AS k FROM r WHERE evt = 'error' GROUP BY vin))")
def clue_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Child rows of each unit's newest error: its two codes, in order."""
    rows = errors(spark, sf).select("vin", "ts", F.col("seq").alias("version"), F.array(F.struct(F.col("k").alias("code")), F.struct((F.col("k") + 7).alias("code"))).alias("clues"))
    return rounded(P.exploded_children(rows, ["vin"], "clues"))


STATUS_SQL = GROUPS_SQL + ", st AS (SELECT *, CASE WHEN members >= 4 THEN 'OPEN' WHEN grp % 3 = 0 THEN 'CLOSED' WHEN grp % 3 = 1 THEN 'MERGED' ELSE 'WATCHING' END AS status FROM gs)"


def with_status(spark: SparkSession, sf: str) -> DataFrame:
    g = F.col("grp") % 3
    return groups(spark, sf).withColumn("status", F.when(F.col("members") >= 4, "OPEN").when(g == 0, "CLOSED").when(g == 1, "MERGED").otherwise("WATCHING"))


def member_rows(spark: SparkSession, sf: str) -> DataFrame:
    """family_key, grp, vin and what each member shows: joined by key and bucket, as a bucket is in one group."""
    rows = incidents(spark, sf)
    spans = groups(spark, sf).select("family_key", "grp", F.explode(F.sequence("first_bucket", "last_bucket")).alias("b"))
    return rows.join(spans, ["family_key", "b"]).select("family_key", "grp", "vin", "seq", "ts", "y", "k")


@query(STATUS_SQL + "SELECT DISTINCT family_key, CAST(grp AS BIGINT) AS grp, vin, status NOT IN ('MERGED', 'CLOSED') AS active FROM inc JOIN g0 USING (family_key, b) JOIN st USING (family_key, grp)")
def member_table(spark: SparkSession, sf: str) -> DataFrame:
    members = member_rows(spark, sf).select("family_key", "grp", "vin").distinct()
    return P.member_table(with_status(spark, sf), members, members, ["family_key", "grp"])[0]


@query(STATUS_SQL + "SELECT count(*) FILTER (status = 'OPEN') AS open, count(*) FILTER (status = 'WATCHING') AS watching, count(*) FILTER (status = 'MERGED') AS merged, count(*) FILTER (status = 'CLOSED') AS closed FROM st")
def status_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return with_status(spark, sf).agg(*[F.count_if(F.col("status") == s.upper()).alias(s) for s in ("open", "watching", "merged", "closed")])


@query(STATUS_SQL + f", f AS (SELECT family_key, grp, status, sha1(unhex('{NS.replace('-', '')}') || encode(family_key || '|' || grp || '|' || status || '|' || members)) AS h FROM st) SELECT family_key, grp, status AS change, {UUID_SQL} AS event_id FROM f WHERE status <> 'MERGED'")
def change_feed(spark: SparkSession, sf: str) -> DataFrame:
    """One event for each change; those of merged groups have been published."""
    changed = with_status(spark, sf).select("family_key", "grp", F.col("status").alias("change"), F.col("members").alias("version"), F.col("last_bucket").alias("created_at"))
    done = P.change_feed(changed.filter("change = 'MERGED'"), NS, ["family_key", "grp"])
    return P.change_feed(changed, NS, ["family_key", "grp"], done).select("family_key", "grp", "change", "event_id")


@query(STATUS_SQL + "SELECT family_key, grp, kind, CAST(version AS BIGINT) AS version FROM (SELECT family_key, grp, CASE WHEN members >= 4 THEN 'OPENED' WHEN members = 3 THEN 'GREW' ELSE 'OTHER' END AS kind, members AS version, row_number() OVER (PARTITION BY family_key ORDER BY last_bucket, members) AS k FROM st WHERE members >= 3) WHERE k = 1")
def campaign_cards(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("members")
    events = groups(spark, sf).select(F.col("family_key").alias("subject"), "grp", F.when(n >= 4, "OPENED").when(n == 3, "GREW").otherwise("OTHER").alias("kind"), F.col("last_bucket").alias("ts"), n.alias("version"))
    return P.cards(events).select(F.col("subject").alias("family_key"), "grp", "kind", "version")


# ---- campaigns


CLUE_SQL = GROUPS_SQL + """, mm AS (SELECT family_key, CAST(grp AS BIGINT) AS grp, vin, y - 50 AS dev FROM inc JOIN g0 USING (family_key, b) JOIN (SELECT vin, seq, y FROM r) USING (vin, seq)),
md AS (SELECT family_key, grp, count(DISTINCT vin) AS members, median(dev) AS dev FROM mm GROUP BY ALL)"""


@query(CLUE_SQL + "SELECT family_key, grp, members, round(dev, 6) AS dev, CAST(NULL AS DOUBLE) AS slope FROM md")
def member_medians(spark: SparkSession, sf: str) -> DataFrame:
    rows = member_rows(spark, sf).select("family_key", "grp", "vin", (F.col("y") - 50).alias("deviation"), F.lit(None).cast("double").alias("slope"))
    return rounded(P.member_medians(rows, ["family_key", "grp"]))




@query(GROUPS_SQL + "SELECT family_key, grp, members * 38000.0 AS cost, CASE WHEN members * 38000 >= 10000000 THEN CAST(members * 38000 // 10000000 AS VARCHAR) || ',' || lpad(CAST(members * 38000 // 100000 % 100 AS VARCHAR), 2, '0') || ',' || lpad(CAST(members * 38000 // 1000 % 100 AS VARCHAR), 2, '0') WHEN members * 38000 >= 100000 THEN CAST(members * 38000 // 100000 AS VARCHAR) || ',' || lpad(CAST(members * 38000 // 1000 % 100 AS VARCHAR), 2, '0') ELSE CAST(members * 38000 // 1000 AS VARCHAR) END || ',000' AS cost_text FROM gs")
def campaign_cost(spark: SparkSession, sf: str) -> DataFrame:
    cost = P.cost_if_not_fixed(F.col("members"), F.lit(0), 51_000, 13_000)
    return groups(spark, sf).select("family_key", "grp", cost.alias("cost"), P.grouped_digits(cost).alias("cost_text"))


# ---- pages


@query(QUEUE_SQL + "SELECT depot_id, n_name, count(*) AS vehicles, count(*) FILTER (slot = 'TODAY') AS today, count(*) FILTER (slot = 'WAITING' AND eligible) AS queued, (SELECT count(*) FROM r WHERE evt = 'error' AND k >= 97 AND vin % 25 = depot_id) AS severe FROM f JOIN nation ON n_nationkey = depot_id GROUP BY depot_id, n_name")
def depot_list(spark: SparkSession, sf: str) -> DataFrame:
    q = filled(spark, sf)
    depots = fleet.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("depot_id"), "n_name")
    severe = errors(spark, sf).filter("k >= 97").select((F.col("vin") % 25).alias("depot_id"))
    page = P.with_counts(depots, "depot_id", {"vehicles": q, "today": q.filter("slot = 'TODAY'"), "queued": q.filter("slot = 'WAITING' and eligible"), "severe": severe})
    return page.filter("vehicles > 0")


@query(QUEUE_SQL + "SELECT depot_id, slot, string_agg(CAST(vin AS VARCHAR), ',' ORDER BY rank) AS vins, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY depot_id, slot ORDER BY rank) AS k FROM f) WHERE k <= 20 GROUP BY depot_id, slot")
def depot_board(spark: SparkSession, sf: str) -> DataFrame:
    """The first 20 of each column of a depot's board, in order."""
    page = P.ordered_children(filled(spark, sf).select("depot_id", "slot", "rank", "vin"), ["depot_id", "slot"], "rank", ["vin"], "items", 20)
    return page.select("depot_id", "slot", F.array_join(F.transform("items", lambda x: x["vin"].cast("string")), ",").alias("vins"), F.size("items").cast("long").alias("n"))


@query(QUEUE_SQL + """SELECT depot_id, '[' || string_agg('{"rank":' || rank || ',"vin":' || vin || ',"slot":"' || slot || '"}', ',' ORDER BY rank) || ']' AS snapshot FROM f GROUP BY depot_id""")
def queue_snapshot_json(spark: SparkSession, sf: str) -> DataFrame:
    page = P.ordered_children(filled(spark, sf), ["depot_id"], "rank", ["vin", "slot"], "items")
    return page.select("depot_id", F.to_json("items").alias("snapshot"))


@query(GROUPS_SQL + "SELECT family_key, grp, members, first_bucket, last_bucket, (SELECT string_agg(CAST(vin AS VARCHAR), ',' ORDER BY vin) FROM (SELECT DISTINCT vin, family_key AS fk, grp AS gg FROM inc JOIN g0 USING (family_key, b)) WHERE fk = gs.family_key AND gg = gs.grp) AS vins FROM gs")
def campaign_page(spark: SparkSession, sf: str) -> DataFrame:
    key = ["family_key", "grp"]
    members = P.ordered_children(member_rows(spark, sf).select(*key, "vin").distinct(), key, "vin", [], "items")
    page = groups(spark, sf).join(members, key)
    return page.select(*key, "members", "first_bucket", "last_bucket", F.array_join(F.transform("items", lambda x: x["vin"].cast("string")), ",").alias("vins"))


@query("SELECT vin, model_id, depot_id, (SELECT max(seq) FROM r WHERE r.vin = veh.vin) AS last_seq, (SELECT count(*) FROM codes WHERE codes.vin = veh.vin) AS codes, (SELECT string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq DESC) FROM (SELECT seq FROM r WHERE r.vin = veh.vin AND evt = 'error' ORDER BY seq DESC LIMIT 5)) AS last_errors FROM veh")
def vehicle_page(spark: SparkSession, sf: str) -> DataFrame:
    e = errors(spark, sf).select("vin", (-F.col("seq")).alias("newest"))
    last = P.ordered_children(e, ["vin"], "newest", [], "items", 5).select("vin", F.array_join(F.transform("items", lambda x: (-x["newest"]).cast("string")), ",").alias("last_errors"))
    page = P.with_counts(fleet.registry(spark, sf).select("vin", "model_id", "depot_id"), "vin", {"codes": codes(spark, sf)})
    return page.join(fleet.readings(spark, sf).groupBy("vin").agg(F.max("seq").alias("last_seq")), "vin").join(last, "vin", "left")


@query("SELECT seq, vin, 'VIEW' AS action, n_name AS tenant FROM r JOIN nation ON n_nationkey = vin % 25 WHERE n_regionkey = 1 AND evt = 'view' ORDER BY seq DESC LIMIT 100")
def audit_page(spark: SparkSession, sf: str) -> DataFrame:
    """Views as an audit trail of one tenant (a region), the newest 100."""
    own = fleet.table(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("depot_id"), F.col("n_name").alias("tenant"))
    rows = fleet.readings(spark, sf).filter("evt = 'view'").withColumn("depot_id", F.col("vin") % 25).join(F.broadcast(own), "depot_id")
    return rows.select("seq", "vin", F.lit("VIEW").alias("action"), "tenant").orderBy(F.desc("seq")).limit(100)


@query("SELECT tenant, topic, count(*) AS n FROM (SELECT n_regionkey AS tenant, CASE WHEN evt = 'error' THEN 'incident' ELSE 'reading' END AS topic FROM r JOIN nation ON n_nationkey = vin % 25) GROUP BY ALL".replace("n_regionkey AS tenant", "CAST(n_regionkey AS BIGINT) AS tenant"))
def tenant_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Changes by tenant and topic, as the live feed deals them out."""
    depots = fleet.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("depot_id"), F.col("n_regionkey").cast("long").alias("tenant"))
    rows = fleet.readings(spark, sf).withColumn("depot_id", F.col("vin") % 25).join(F.broadcast(depots), "depot_id")
    return rows.groupBy("tenant", F.when(F.col("evt") == "error", "incident").otherwise("reading").alias("topic")).agg(count().alias("n"))


# ---- ticks and suggestions


RISK_SQL = """, s AS (SELECT vin, hour AS ts, (round(mean, 6) - 50) / 25 AS z FROM hr), tick AS (SELECT max(hour) AS t FROM hr),
risk AS (SELECT t, vin FROM (SELECT b.t, vin, z, row_number() OVER (PARTITION BY b.t, vin ORDER BY ts DESC) AS k FROM s, (SELECT t FROM tick UNION ALL SELECT t - INTERVAL 72 HOUR FROM tick) b WHERE ts <= b.t) WHERE k <= 4 GROUP BY t, vin HAVING count(*) FILTER (z >= 0.5) >= 2)"""


@query(RISK_SQL + "SELECT vin, CASE WHEN n.t IS NULL THEN 'WITHDRAWN' ELSE 'CREATED' END AS change FROM (SELECT vin, t FROM risk WHERE t = (SELECT t FROM tick)) n FULL JOIN (SELECT vin, t FROM risk WHERE t <> (SELECT t FROM tick)) o USING (vin) WHERE n.t IS NULL OR o.t IS NULL")
def at_risk_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """The at-risk list at the newest hour against that of three days before: who came, who went."""
    hours = scored_hours(spark, sf)
    tick = hours.agg(F.max("ts").alias("tick"))  # one row
    p = Campaign(risk_z=0.5, risk_k=2, risk_slope=1e9)
    at = lambda back: C.at_risk(hours.join(F.broadcast(tick), F.col("ts") <= F.col("tick") - F.expr(f"INTERVAL {back} HOURS")), ["vin"], p).filter("at_risk").select("vin", F.lit(1).alias("x"))
    return J.changes(at(72), at(0), ["vin"], ["x"]).select("vin", "change")


@query("SELECT CAST(date_trunc('hour', ts) + INTERVAL 1 HOUR AS TIMESTAMP) AS tick, count(DISTINCT vin) AS units, count(*) AS readings FROM r GROUP BY 1")
def hourly_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """One tick for each event hour that has readings, at its end."""
    tick = (F.date_trunc("hour", "ts") + F.expr("INTERVAL 1 HOUR")).cast("timestamp_ntz").alias("tick")
    return fleet.readings(spark, sf).groupBy(tick).agg(F.countDistinct("vin").alias("units"), count().alias("readings"))


@query(QUEUE_SQL + "SELECT coalesce(w.depot_id, l.depot_id) AS depot_id, CASE WHEN l.n IS NULL THEN 'CREATED' WHEN w.n IS NULL THEN 'WITHDRAWN' ELSE 'UPDATED' END AS change, w.n AS new_n FROM (SELECT depot_id, count(*) AS n FROM f WHERE slot = 'WAITING' AND eligible GROUP BY depot_id) w FULL JOIN (SELECT depot_id, count(*) AS n FROM f WHERE slot = 'WAITING' AND vin % 3 <> 0 GROUP BY depot_id) l ON l.depot_id = w.depot_id WHERE w.n IS DISTINCT FROM l.n")
def booking_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """Bookings to suggest for who waits and may have a bay, against the suggestions that are live."""
    waiting = filled(spark, sf).filter("slot = 'WAITING'")
    each = lambda d: d.groupBy("depot_id").agg(count().alias("n"))
    return P.suggestions(each(waiting.filter("eligible")), each(waiting.filter("vin % 3 <> 0")), ["depot_id"], ["n"]).select("depot_id", "change", "new_n")


# ---- evaluation


@query(", a AS (SELECT vin, min(ts) AS t FROM r WHERE metric = 'level' AND k >= 80 GROUP BY vin), b AS (SELECT vin, min(ts) AS t FROM r WHERE evt = 'error' AND k >= 80 GROUP BY vin) SELECT vin, round((epoch_us(b.t) - epoch_us(a.t)) / 3.6e9, 6) AS lead_h FROM a JOIN b USING (vin) WHERE a.t < b.t")
def lead_times(spark: SparkSession, sf: str) -> DataFrame:
    r = fleet.readings(spark, sf)
    return rounded(P.lead_times(r.filter("metric = 'level' and k >= 80"), r.filter("evt = 'error' and k >= 80")))


@query("SELECT model_id, round((epoch_us(min(ts) FILTER (k >= 98)) - epoch_us(min(ts) FILTER (k >= 60))) / 3.6e9, 6) AS warning_h, round((epoch_us(min(ts) FILTER (k >= 98)) - epoch_us(min(ts) FILTER (y > 150))) / 3.6e9, 6) AS plain_h FROM r JOIN veh USING (vin) WHERE evt = 'error' GROUP BY model_id")
def early_warning(spark: SparkSession, sf: str) -> DataFrame:
    """Hours from the first opened campaign of a model to its first limit, and from the plain rule's first hit."""
    rows = errors(spark, sf).join(fleet.registry(spark, sf), "vin")
    first = lambda c: F.unix_micros(F.min(F.when(c, F.col("ts"))).cast("timestamp"))
    k, limit = F.col("k"), first(F.col("k") >= 98)
    return rounded(rows.groupBy("model_id").agg(((limit - first(k >= 60)) / 3.6e9).alias("warning_h"), ((limit - first(F.col("y") > 150)) / 3.6e9).alias("plain_h")))


@query(", t AS (SELECT vin, vin % 5 = 0 AS planted FROM veh), i AS (SELECT vin, count(*) AS n, min(ts) AS first_ts FROM r WHERE evt = 'error' AND k >= 90 GROUP BY vin) SELECT planted, count(*) AS units, count(n) AS found, CAST(coalesce(sum(n), 0) AS BIGINT) AS incidents, round(1000.0 * count(n) / count(*), 6) AS per_1000 FROM t LEFT JOIN i USING (vin) GROUP BY planted")
def truth_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    truth = fleet.registry(spark, sf).select("vin", (F.col("vin") % 5 == 0).alias("planted"))
    found = errors(spark, sf).filter("k >= 90").groupBy("vin").agg(count().alias("n"))
    rows = truth.join(found, "vin", "left")
    return rounded(rows.groupBy("planted").agg(count().alias("units"), F.count("n").alias("found"), F.coalesce(F.sum("n"), F.lit(0)).alias("incidents"), (F.lit(1000.0) * F.count("n") / count()).alias("per_1000")))


@query(QUEUE_SQL + ", ld AS (SELECT vin, depot_id, count(*) FILTER (evt = 'error') AS loud FROM r JOIN veh USING (vin) GROUP BY ALL) SELECT 'ours' AS ranking, depot_id, round(avg(if(vin % 5 = 0, 1.0, 0)), 6) AS precision FROM f WHERE rank <= 3 GROUP BY depot_id UNION ALL SELECT 'loudest', depot_id, round(avg(if(vin % 5 = 0, 1.0, 0)), 6) FROM (SELECT *, row_number() OVER (PARTITION BY depot_id ORDER BY loud DESC, vin) AS k FROM ld) WHERE k <= 3 GROUP BY depot_id")
def precision_against_loudest(spark: SparkSession, sf: str) -> DataFrame:
    label = (F.col("vin") % 5 == 0).cast("int").alias("label")
    ours = filled(spark, sf).select(F.lit("ours").alias("ranking"), "depot_id", F.col("vin").alias("id"), (-F.col("rank")).alias("score"), label)
    loud = fleet.readings(spark, sf).groupBy("vin").agg(F.count_if(F.col("evt") == "error").alias("score")).join(fleet.registry(spark, sf), "vin")
    both = ours.unionByName(loud.select(F.lit("loudest").alias("ranking"), "depot_id", F.col("vin").alias("id"), "score", label))
    return rounded(E.precision_at_k(both, ["ranking", "depot_id"], 3).drop("n"))


@query("SELECT CAST(vin % 3 AS BIGINT) AS role, count(*) FILTER (mean > 60) AS hours_flagged, count(DISTINCT CASE WHEN mean > 60 THEN vin END) AS vans FROM hr GROUP BY 1")
def flags_by_role(spark: SparkSession, sf: str) -> DataFrame:
    high = F.col("mean") > 60
    return hourly_means(spark, sf).groupBy((F.col("vin") % 3).alias("role")).agg(F.count_if(high).alias("hours_flagged"), F.countDistinct(F.when(high, F.col("vin"))).alias("vans"))


@query("SELECT count(*) FILTER (evt = 'error' AND k >= 97) AS severe, count(DISTINCT vin) FILTER (evt = 'error' AND k >= 97) AS units, max(ts) AS newest, count(*) FILTER (evt = 'error' AND k >= 97) > 0 AS ready FROM r")
def story_ready(spark: SparkSession, sf: str) -> DataFrame:
    hit = (F.col("evt") == "error") & (F.col("k") >= 97)
    return fleet.readings(spark, sf).agg(F.count_if(hit).alias("severe"), F.countDistinct(F.when(hit, F.col("vin"))).alias("units"), F.max("ts").alias("newest"), (F.count_if(hit) > 0).alias("ready"))


@query("SELECT vin, hour, coalesce(e.n, 0) > 0 AS global_before FROM hr LEFT JOIN LATERAL (SELECT count(*) AS n FROM r WHERE r.vin = hr.vin AND y > 97 AND r.ts < hr.hour + INTERVAL 1 HOUR) e ON true")
def rule_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The plain rule as a column of the feature table: any value over the fixed threshold before the hour's end."""
    first = fleet.readings(spark, sf).filter("y > 97").groupBy("vin").agg(F.min("ts").alias("first"))
    rows = hourly_means(spark, sf).join(first, "vin", "left")
    return rows.select("vin", "hour", F.coalesce(F.col("first") < F.col("hour") + F.expr("INTERVAL 1 HOUR"), F.lit(False)).alias("global_before"))


NUMERIC, BOOLEAN, CATEGORY = ["mean", "avg_3", "max_24", "delta_6"], ["high"], ["model_id", "duty_type_id"]


def learning_rows(spark: SparkSession, sf: str) -> DataFrame:
    f = E.trailing_features(hourly_means(spark, sf), "vin", "hour", "mean")
    severe = errors(spark, sf).filter("k >= 90")
    return E.label_within(f, severe, "vin", "hour", "ts").join(fleet.registry(spark, sf), "vin").withColumn("high", F.col("max_24") > 90)


@query()
def at_risk_model(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted trees trained on two thirds of the units; on the others average precision and precision among the 50 highest, beside a rule's."""
    rows = learning_rows(spark, sf)
    model = L.train(rows.filter("vin % 3 <> 0"), NUMERIC, BOOLEAN, CATEGORY, iterations=5)
    test = rows.filter("vin % 3 = 0").withColumn("id", F.concat_ws("|", "vin", "hour"))
    scored = L.predicted(model, test, NUMERIC, BOOLEAN, CATEGORY).select(F.lit("trees").alias("by"), "id", "score", "label")
    both = scored.unionByName(test.select(F.lit("rule").alias("by"), "id", F.col("avg_3").alias("score"), "label"))
    return E.average_precision(both, ["by"], spread=True).join(E.precision_at_k(both, ["by"], 50), "by")


@query("SELECT CAST(floor(epoch(ts) / 300) AS BIGINT) AS slot, count(*) AS n, CAST(max(seq) - min(seq) AS BIGINT) AS increase FROM r GROUP BY 1")
def counter_increase(spark: SparkSession, sf: str) -> DataFrame:
    """How far a counter (the sequence number) rose in each five minutes."""
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3e8).alias("slot")
    return fleet.readings(spark, sf).groupBy(slot).agg(count().alias("n"), (F.max("seq") - F.min("seq")).alias("increase"))


@query("SELECT b, vin, round(avg(y), 6) AS mean, count(*) AS n FROM (SELECT CAST(floor(epoch(ts) / 21600) AS BIGINT) AS b, vin, y FROM r WHERE metric = 'level') GROUP BY ALL")
def six_hour_by_vehicle(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.exprs import bucket

    return rounded(fleet.readings(spark, sf).filter("metric = 'level'").groupBy(bucket(F.col("ts"), 6).alias("b"), "vin").agg(F.avg("y").alias("mean"), count().alias("n")))
