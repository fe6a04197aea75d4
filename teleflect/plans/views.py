"""More fleet queries: phrases, records, decisions, erasure, pivots, anomaly rates, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import views as V
from ..sources import feed, runs
from ..sources.keyed import KeyedTable
from . import fleet
from .queries import GOOD_VIN, PROBLEM_SQL, messages, normal, query, rounded


@query("""SELECT vin, seq, array_to_string(list_filter([CASE WHEN abs(dev) >= 37.5 THEN CAST(CAST(trunc(abs(dev) * 10 + 0.5 + 1e-7) / 10 AS DECIMAL(12, 1)) AS VARCHAR) || ' u ' || if(dev > 0, 'above', 'below') || ' its own normal' END,
CASE WHEN k >= 90 THEN 'limit in ' || CAST(ceil((100 - k) / 2.0) AS BIGINT) || ' h' END], lambda x: x IS NOT NULL), '; ') AS clues FROM (SELECT r.vin, r.seq, r.k, y - o.median AS dev FROM r JOIN own_norm o ON o.vin = r.vin AND o.metric = r.metric)""")
def clue_phrases(spark: SparkSession, sf: str) -> DataFrame:
    rows = fleet.readings(spark, sf).join(normal(spark, sf).select("vin", "metric", "median"), ["vin", "metric"]).withColumn("dev", F.col("y") - F.col("median"))
    left = F.when(F.col("k") >= 90, (100 - F.col("k")) / 2.0)
    clues = V.level_clues(F.col("y"), F.col("median"), F.col("dev") / 25, F.lit(0.0), left, "u")
    return rows.select("vin", "seq", F.array_join(clues, "; ").alias("clues"))


@query("SELECT vin, seq, round((CASE WHEN k > 80 THEN least(1, (k % 4) * 24 / greatest(1.0, 100.5 - k)) ELSE 1 - pow(0.95, k % 4) END) * 51000, 0) AS cost FROM r WHERE evt = 'error'")
def cost_of_waiting(spark: SparkSession, sf: str) -> DataFrame:
    r = fleet.readings(spark, sf).filter("evt = 'error'")
    cost = V.waiting_cost(F.when(F.col("k") > 80, 100.5 - F.col("k")), F.lit(0.05), F.col("k") % 4, 51_000)
    return r.select("vin", "seq", cost.alias("cost"))


@query("SELECT vin, max_by(evt, seq) AS status, CAST(max(1 + k // 40) AS BIGINT) AS severity, bool_or(k >= 97) AS runaway, min(ts) FILTER (k >= 97) AS critical_ts, round(max_by(y, seq), 4) AS value, count(*) AS actions FROM r GROUP BY vin")
def incident_upsert(spark: SparkSession, sf: str) -> DataFrame:
    acts = fleet.readings(spark, sf).select("vin", "seq", "ts", F.col("evt").alias("action"), F.floor(1 + F.col("k") / 40).alias("severity"), (F.col("k") >= 97).alias("runaway"), F.col("y").alias("value"))
    return rounded(V.merge_actions(acts, "vin"), 4)


@query(f"""SELECT seq % 4 AS "partition", if(p IS NULL, 'canonical', 'dead') AS topic, if(p IS NULL, '{GOOD_VIN}', 'k' || seq % 100) AS "key", p AS error_code, CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS sources FROM (SELECT seq, {PROBLEM_SQL} AS p FROM r) GROUP BY ALL""")
def feed_normalised(spark: SparkSession, sf: str) -> DataFrame:
    """Raw messages written to a feed of four partitions, read by a stream, judged, and written to canonical and dead-letter topics by one writer."""
    feed.register(spark)
    base, number = fleet.scratch(spark, "feed"), F.col("offset") % 4
    raw = messages(spark, sf).select("topic", number.cast("int").alias("partition"), F.concat(F.lit("k"), (F.col("offset") % 100).cast("string")).alias("key"), F.create_map(F.lit("n"), F.col("offset").cast("string")).alias("headers"), F.col("value").cast("binary").alias("value"), F.lit(None).cast("timestamp").alias("ts"))
    raw.write.format("feed").mode("append").option("path", f"{base}/in").save()
    stream = feed.normalised(spark.readStream.format("feed").option("path", f"{base}/in").load())
    stream.writeStream.format("feed").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.format("feed").option("path", f"{base}/out").load()
    code = F.get_json_object(F.col("value").cast("string"), "$.error_code")
    return out.groupBy(F.col("partition").cast("long").alias("partition"), "topic", "key", F.when(F.col("topic") == "dead", code).alias("error_code")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.element_at("headers", "source")).alias("sources"))


@query("SELECT run_id, rows_read, units, tables, skipped FROM (SELECT 'first' AS run_id, count(*) FILTER (seq % 2 = 0) AS rows_read, count(DISTINCT vin) FILTER (seq % 2 = 0) AS units, count(*) FILTER (seq % 2 = 0 AND evt = 'error') AS tables, true AS skipped FROM r UNION ALL SELECT 'second', count(*), count(DISTINCT vin), count(*) FILTER (evt = 'error'), false FROM r)")
def committed_runs(spark: SparkSession, sf: str) -> DataFrame:
    """A run over half the readings, the same input again (skipped by its hash), then a run over all: the run table, and the rows that each run's table has."""
    base, r = fleet.scratch(spark, "runs"), fleet.readings(spark, sf)

    def run(name: str, rows: DataFrame) -> bool:
        return runs.commit_run({"errors": rows.filter("evt = 'error'")}, base, name, runs.row_hash(rows, ["vin", "seq", "y"], "v1"), rows)

    half = r.filter("seq % 2 = 0")
    run("first", half)
    skipped = not run("again", half)
    run("second", r)
    table = runs.run_table(spark, base).select("run_id", "rows_read", "units")
    sizes = None
    for name in ("first", "second"):
        one = runs.read_run(spark, base, "errors", name).agg(F.count(F.lit(1)).alias("tables")).select(F.lit(name).alias("run_id"), "tables")
        sizes = one if sizes is None else sizes.unionByName(one)
    return table.join(sizes, "run_id").withColumn("skipped", F.lit(skipped) & (F.col("run_id") == "first"))


@query("SELECT vin, max_by(evt, seq) AS status, CAST(max(1 + k // 40) AS BIGINT) AS severity, bool_or(k >= 97) AS runaway, round(max_by(y, seq), 4) AS value, count(*) AS actions, count(DISTINCT seq % 4) AS version FROM r GROUP BY vin")
def stream_incident_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The same records kept up to date by a stream of four batches (events by the rest of their number), each merged into the buckets it touches."""
    acts = fleet.readings(spark, sf).select("vin", "seq", "ts", F.col("evt").alias("action"), F.floor(1 + F.col("k") / 40).alias("severity"), (F.col("k") >= 97).alias("runaway"), F.col("y").alias("value"))
    base = fleet.scratch(spark, "records")
    for i in range(4):
        V.as_records(acts.filter(F.col("seq") % 4 == i), "vin").coalesce(1).write.mode("append").parquet(f"{base}/in")
    schema = f"vin long, {V.RECORD}"
    kept = KeyedTable(f"{base}/table", ["vin"], schema, lambda d: V.merge_records(d, "vin"), 4)
    kept.follow(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"), f"{base}/checkpoint")
    return rounded(kept.read(spark).select("vin", "status", "severity", "runaway", "value", "actions", "version"), 4)


@query("SELECT l_orderkey * 10 + l_linenumber AS decision_id, l_orderkey AS o_orderkey, 'DONE' AS new_status, CASE WHEN o_orderkey IS NULL THEN 'UNKNOWN' WHEN l_linenumber = o_custkey % 7 AND o_orderstatus = 'O' AND rn = 1 THEN 'APPLIED' ELSE 'CONFLICT' END AS result FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_orderkey * 10 + l_linenumber) AS rn FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) LEFT JOIN orders ON o_orderkey = l_orderkey", roles=False)
def decisions_applied(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines stand for decisions on a version of their order."""
    state = fleet.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 7).alias("version"), F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("CLOSED").alias("status"))
    d = fleet.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    d = d.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("decision_id"), F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("long").alias("version"), F.lit("DONE").alias("status"))
    return V.decide(state, d, "o_orderkey")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'erased-' || c_custkey ELSE c_name END AS c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND c_acctbal >= 0) AS orders FROM customer", roles=False)
def erasure(spark: SparkSession, sf: str) -> DataFrame:
    c = fleet.table(spark, sf, "customer")
    people, orders = V.erase(c.select("c_custkey", "c_name"), fleet.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), c.filter("c_acctbal < 0").select("c_custkey"), "c_custkey", "c_name")
    return people.join(orders.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("orders")), "c_custkey", "left").fillna(0, ["orders"])


@query("SELECT CAST(floor(epoch(ts) / 21600) AS BIGINT) AS b, round(avg(y) FILTER (evt = 'click'), 6) AS click, round(avg(y) FILTER (evt = 'error'), 6) AS error, round(avg(y) FILTER (evt = 'view'), 6) AS view FROM r WHERE evt IN ('click', 'error', 'view') GROUP BY ALL")
def six_hour_pivot(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.exprs import bucket

    r = fleet.readings(spark, sf).filter(F.col("evt").isin("click", "error", "view"))
    return rounded(r.groupBy(bucket(F.col("ts"), 6).alias("b")).pivot("evt", ["click", "error", "view"]).agg(F.avg("y")), 6)


@query("SELECT date_trunc('day', ts) AS day, round(quantile_cont(y, 0.5), 6) AS p50, round(quantile_cont(y, 0.95), 6) AS p95, round(quantile_cont(y, 0.99), 6) AS p99, count(*) AS n FROM r GROUP BY ALL")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact percentiles a day (equal values are counted together in partial sums)."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    return rounded(fleet.readings(spark, sf).groupBy(day).agg(*[F.percentile("y", q).alias(f"p{round(q * 100)}") for q in (0.5, 0.95, 0.99)], F.count(F.lit(1)).alias("n")), 6)


@query("SELECT round(min(y), 4) AS threshold FROM (SELECT y FROM r ORDER BY y DESC LIMIT 100)")
def equal_volume_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.threshold_at(fleet.readings(spark, sf).select(F.col("y").alias("score")), 100), 4)


@query()
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    return V.hash_sample(fleet.readings(spark, sf).select("vin", "seq", "y"), ["vin", "seq"], 1000, 7)


@query("SELECT vin, seq, source FROM (SELECT vin, seq, source, row_number() OVER (PARTITION BY vin ORDER BY source) AS k FROM (SELECT vin, max(seq) AS seq, 0 AS source FROM r WHERE evt = 'error' AND k >= 98 GROUP BY vin UNION ALL SELECT vin, max(seq), 1 FROM r GROUP BY vin)) WHERE k = 1".replace("source FROM (SELECT", "CAST(source AS BIGINT) AS source FROM (SELECT", 1))
def prioritised_source(spark: SparkSession, sf: str) -> DataFrame:
    r = fleet.readings(spark, sf)
    newest = lambda d: d.groupBy("vin").agg(F.max("seq").alias("seq"))
    return rounded(V.prioritised([newest(r.filter("evt = 'error' and k >= 98")), newest(r)], ["vin"]))


@query("SELECT model_id, count(*) AS vehicles, count(DISTINCT depot_id) AS depots FROM veh GROUP BY model_id")
def fleet_by_model(spark: SparkSession, sf: str) -> DataFrame:
    return fleet.registry(spark, sf).groupBy("model_id").agg(F.count(F.lit(1)).alias("vehicles"), F.countDistinct("depot_id").alias("depots"))


@query("SELECT depot_id, n_name, count(*) AS vehicles FROM veh JOIN nation ON n_nationkey = depot_id GROUP BY ALL ORDER BY vehicles DESC, depot_id LIMIT 10")
def largest_depots(spark: SparkSession, sf: str) -> DataFrame:
    names = fleet.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("depot_id"), "n_name")
    sizes = fleet.registry(spark, sf).groupBy("depot_id").agg(F.count(F.lit(1)).alias("vehicles"))
    return sizes.join(F.broadcast(names), "depot_id").select("depot_id", "n_name", "vehicles").orderBy(F.desc("vehicles"), "depot_id").limit(10)


@query("SELECT 'unique' AS claim, count(*) AS ours, count(DISTINCT seq) AS baseline, count(*) = count(DISTINCT seq) AS holds FROM r UNION ALL SELECT 'known depots', count(*), (SELECT count(DISTINCT vin) FROM r), count(*) = (SELECT count(DISTINCT vin) FROM r) FROM veh UNION ALL SELECT 'values in range', count(*) FILTER (y BETWEEN 0 AND 1000), count(*), count(*) FILTER (y BETWEEN 0 AND 1000) = count(*) FROM r")
def claims_table(spark: SparkSession, sf: str) -> DataFrame:
    r, vehicles = fleet.readings(spark, sf), fleet.registry(spark, sf)
    n = F.count(F.lit(1))
    a = r.agg(n.alias("ours"), F.countDistinct("seq").alias("baseline")).withColumn("claim", F.lit("unique"))
    b = vehicles.agg(n.alias("ours")).crossJoin(r.agg(F.countDistinct("vin").alias("baseline"))).withColumn("claim", F.lit("known depots"))  # one row each
    c = r.agg(F.count_if(F.col("y").between(0, 1000)).alias("ours"), n.alias("baseline")).withColumn("claim", F.lit("values in range"))
    return a.unionByName(b).unionByName(c).withColumn("holds", F.col("ours") == F.col("baseline")).select("claim", "ours", "baseline", "holds")
