"""Phrases and pages over what the other queries find: every input is the result of an operator, and so is its SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import baselines as B
from ..operators import campaigns as C
from ..operators import pages as P
from ..operators import phrases as S
from ..params import Campaign
from . import fleet, more, queries
from .queries import ORACLE_SQL, codes, incidents, normal, query, rounded


def sub(name: str) -> str:
    """Another query's SQL as a table."""
    return f"({ORACLE_SQL[name]})"


def tenth(x: str) -> str:
    return f"CAST(CAST(floor(({x}) * 10 + 0.5 + 1e-7) / 10 AS DECIMAL(12, 1)) AS VARCHAR)"


def hundredth(x: str) -> str:
    return f"CAST(CAST(floor(({x}) * 100 + 0.5 + 1e-7) / 100 AS DECIMAL(12, 2)) AS VARCHAR)"


def side(x: str) -> str:
    return f"if({x} >= 0, 'above', 'below')"


def said(template: str, **facts: str) -> str:
    """A template of phrases.TEXTS in SQL."""
    quoted = [facts[p[1:-1]] if p.startswith("{") else "'" + p.replace("'", "''") + "'" for p in re.split(r"(\{\w+\})", S.TEXTS[template]) if p]
    return "(" + " || ".join(f"CAST({q} AS VARCHAR)" for q in quoted) + ")"


def texts(rows) -> F.Column:
    """type and text of phrases, in order, as one string."""
    return F.array_join(F.transform(rows, lambda x: F.concat(x["type"], F.lit(" "), x["text"])), "; ")


def listed(*phrases: tuple[str, str, str]) -> str:
    """(condition, type, text) in SQL, those that hold, as one string."""
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {when} THEN '{kind} ' || {text} END" for when, kind, text in phrases) + "], lambda x: x IS NOT NULL), '; ')"


# ---- what a unit shows now


NOW_SQL = f"""nw AS (SELECT t.vin, t.mean, t.slope, o.median, o.slope_median, o.slope_mad, o.mad FROM (SELECT * FROM {sub('trend_ew_batch')} QUALIFY row_number() OVER (PARTITION BY vin ORDER BY seq DESC) = 1) t JOIN (SELECT * FROM {sub('baseline_own_normal')} WHERE metric = 'level') o USING (vin)),
n AS (SELECT vin, round(mean - median, 6) AS deviation, median AS normal, slope, round(greatest(abs(slope_median), 1.4826 * slope_mad, 0.05), 6) AS slope_usual, round((slope - slope_median) / (1.4826 * greatest(slope_mad, 0.05)), 6) AS z_slope FROM nw),
pr AS (SELECT vin, region_id, duty_type_id, round(median(deviation) OVER (PARTITION BY region_id, duty_type_id), 6) AS peer_level, count(*) OVER (PARTITION BY region_id, duty_type_id) AS peers FROM n JOIN (SELECT DISTINCT user_id AS vin, user_id % 5 AS duty_type_id, n_regionkey + 1 AS region_id FROM events JOIN nation ON n_nationkey = user_id % 25) USING (vin)),
cr AS (SELECT * FROM {sub('code_rate_active')} QUALIFY row_number() OVER (PARTITION BY vin ORDER BY hour DESC, family) = 1)"""


def newest(rows: DataFrame, key: str, *order) -> DataFrame:
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__k = 1").drop("__k")


def now(spark: SparkSession, sf: str) -> DataFrame:
    """vin, deviation, normal, slope, slope_usual, z_slope at each unit's newest level."""
    own = rounded(normal(spark, sf)).filter("metric = 'level'").select("vin", "median", "slope_median", "slope_mad")
    rows = newest(queries.trend_ew_batch(spark, sf), "vin", F.desc("seq")).join(own, "vin")
    spread = 1.4826 * F.greatest(F.col("slope_mad"), F.lit(0.05))
    usual = F.greatest(F.abs("slope_median"), 1.4826 * F.col("slope_mad"), F.lit(0.05))
    return rounded(rows.select("vin", (F.col("mean") - F.col("median")).alias("deviation"), F.col("median").alias("normal"), "slope", usual.alias("slope_usual"), ((F.col("slope") - F.col("slope_median")) / spread).alias("z_slope")))


@query("WITH " + NOW_SQL + ", x AS (SELECT n.*, peer_level, peers, cr.family, cr.n24, round(cr.threshold, 6) AS threshold, cr.active, cr.hour % 7 = 0 AS runaway, CASE WHEN z_slope >= 2 THEN round(abs(normal) / z_slope, 6) END AS hl FROM n JOIN pr USING (vin) JOIN cr USING (vin)) SELECT vin, " + listed(
    ("NOT active", "LEVEL", said("LEVEL", amount=tenth("abs(deviation)"), unit="'u'", side=side("deviation"), normal=tenth("abs(normal)"))),
    ("NOT active AND z_slope >= 1.5", "SLOPE", said("SLOPE", way="if(slope >= 0, 'up', 'down')", amount=hundredth("abs(slope)"), unit="'u'", times=tenth("abs(slope) / slope_usual"))),
    ("NOT active AND peers > 0", "PEERS", "if(abs(peer_level) < 3, " + said("PEERS_CALM", peers="peers", where="'in the region'") + ", " + said("PEERS_SHIFTED", peers="peers", where="'in the region'", amount=tenth("abs(peer_level)"), unit="'u'", side=side("peer_level")) + ")"),
    ("hl IS NOT NULL", "TIME_TO_LIMIT", said("TIME_TO_LIMIT", hours=tenth("hl"), limit=tenth("300.0"), unit="'u'")),
    ("runaway", "RUNAWAY", said("RUNAWAY")),
    ("active OR n24 > 0", "DTC_RATE", said("DTC_RATE", count="n24", family="family", code="'P0'", usual=tenth("threshold / 4"))),
) + " AS clues FROM x", roles=False)
def incident_clues(spark: SparkSession, sf: str) -> DataFrame:
    """The six clues of an incident, from trends, normals, peers and code rates."""
    n = now(spark, sf)
    places = fleet.registry(spark, sf).select("vin", "region_id", "duty_type_id")
    scope = ["region_id", "duty_type_id"]
    placed = n.join(places, "vin")
    peers = placed.groupBy(*scope).agg(F.round(F.median("deviation"), 6).alias("peer_level"), F.count(F.lit(1)).alias("peers"))
    coded = newest(queries.code_rate_active(spark, sf), "vin", F.desc("hour"), "family")
    rows = placed.join(peers, scope).join(coded, "vin").withColumns({
        "unit": F.lit("u"), "where": F.lit("in the region"), "calm": F.lit(3.0), "hard_limit": F.lit(300.0), "hours_left": F.when(F.col("z_slope") >= 2, F.round(F.abs("normal") / F.col("z_slope"), 6)),
        "runaway": F.col("hour") % 7 == 0, "code": F.lit("P0"), "codes24": F.col("n24"), "codes_usual": F.col("threshold") / 4, "by_codes": F.col("active"),
    })
    return rows.select("vin", texts(S.incident_clues()).alias("clues"))


# ---- reasons


OPEN_SQL = f"""op AS (SELECT family_key, grp, p.members FROM {sub('campaign_open_poisson')} p WHERE opens QUALIFY row_number() OVER (PARTITION BY family_key ORDER BY grp DESC) = 1),
mb AS (SELECT DISTINCT m.family_key, m.vin, op.members FROM {sub('member_table')} m JOIN op USING (family_key, grp))"""


def open_campaigns(spark: SparkSession, sf: str) -> DataFrame:
    """family_key, grp, members: the newest group of each key that opens."""
    return newest(queries.campaign_open_poisson(spark, sf).filter("opens"), "family_key", F.desc("grp")).select("family_key", "grp", "members")


@query("WITH " + NOW_SQL + ", " + OPEN_SQL + f""", ar AS (SELECT vin, reason FROM {sub('at_risk_last4')} WHERE at_risk), fv AS (SELECT vin, CAST(CAST(repaired AS DATE) AS VARCHAR) AS day FROM {sub('fix_verdict')} WHERE verdict = 'NOT_FIXED'), t24 AS (SELECT vin, codes FROM {sub('trailing_24h_filter')}), bh AS (SELECT vin, ratio FROM {sub('behaviour_ratio')}),
kn AS (SELECT * FROM {sub('kofn_confirm')} QUALIFY row_number() OVER (PARTITION BY vin ORDER BY seq DESC) = 1), q AS (SELECT * FROM {sub('queue_score_rank')}), bf AS (SELECT vin, slot FROM {sub('bay_fill')}),
inc AS (SELECT vin, string_agg(t, '; ' ORDER BY o, t) AS t FROM (
  SELECT q.vin, 0 AS o, CASE WHEN q.pinned THEN 'RUNAWAY ' || {said('Q_CRITICAL', family="'COOLING'")} ELSE 'INCIDENT ' || {said('Q_LEVEL', family="'COOLING'", amount=tenth('abs(deviation)'), unit="'u'", side=side('deviation'))} || if(slope > 0 AND z_slope >= 1.5, {said('Q_RISING', amount=hundredth('slope'), unit="'u'")}, '') END AS t FROM q JOIN kn USING (vin) JOIN n USING (vin) WHERE confirmed
  UNION ALL SELECT vin, 1, 'INCIDENT ' || {said('Q_CODES', family='family')} FROM cr WHERE active) GROUP BY vin),
cmp AS (SELECT vin, string_agg(t, '; ' ORDER BY o, k) AS t FROM (
  SELECT vin, 0 AS o, family_key AS k, 'CAMPAIGN ' || {said('Q_MEMBER', members='members', family="'COOLING'", place='family_key')} AS t FROM mb
  UNION ALL SELECT v.vin, 1, op.family_key, 'AT_RISK ' || {said('Q_SISTER', members='op.members', family="'COOLING'", place='op.family_key')} || coalesce({said('Q_SISTER_LEVEL', amount=tenth('abs(deviation)'), unit="'u'", side=side('deviation'))}, '') FROM op JOIN (SELECT DISTINCT user_id AS vin, user_id % 8 AS model_id, user_id % 5 AS duty_type_id FROM events) v ON op.family_key[3:] = v.model_id || '|' || v.duty_type_id JOIN ar ON ar.vin = v.vin LEFT JOIN n ON n.vin = v.vin WHERE NOT EXISTS (SELECT 1 FROM mb WHERE mb.vin = v.vin AND mb.family_key = op.family_key)) GROUP BY vin)
SELECT q.depot_id, q.rank, q.vin, concat_ws('; ', inc.t, cmp.t, 'AT_RISK ' || {said('Q_RISK', reason='lower(ar.reason)')}, 'NOT_FIXED ' || {said('Q_NOT_FIXED', day='fv.day')}, CASE WHEN t24.codes > 0 THEN 'CODES ' || {said('Q_CODES24', count='t24.codes')} END,
  CASE WHEN bh.ratio >= 1.5 THEN 'BEHAVIOUR ' || {said('Q_BEHAVIOUR', amount=tenth('bh.ratio'))} END, CASE WHEN q.vin % 2 = 0 THEN 'IN_SERVICE ' || {said('Q_IN_SERVICE')} END, CASE WHEN bf.slot <> 'WAITING' THEN 'BOOKED ' || {said('Q_BOOKED', day='lower(bf.slot)')} END) AS reasons
FROM q LEFT JOIN inc USING (vin) LEFT JOIN cmp USING (vin) LEFT JOIN ar ON ar.vin = q.vin LEFT JOIN fv ON fv.vin = q.vin LEFT JOIN t24 ON t24.vin = q.vin LEFT JOIN bh ON bh.vin = q.vin LEFT JOIN bf ON bf.vin = q.vin""", roles=False)
def queue_with_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Every unit of the queue with its reasons of all nine types: incidents by signal and by codes, campaigns as member or sister, risk, repairs that did not hold, codes, driving, service, bays."""
    with fleet.shared():
        return _with_reasons(spark, sf)


def _with_reasons(spark: SparkSession, sf: str) -> DataFrame:
    ranked = fleet.stored(queries.filled(spark, sf), "queue").select("depot_id", "rank", "vin", "pinned", "slot", "in_service")
    levels, vehicles = fleet.stored(now(spark, sf), "levels"), fleet.registry(spark, sf)
    confirmed = newest(queries.confirmed(spark, sf), "vin", F.desc("seq")).filter("confirmed").select("vin")
    null = lambda kind: F.lit(None).cast(kind)
    signal = ranked.join(confirmed, "vin").join(levels, "vin").select("vin", F.lit(0).alias("o"), F.struct(
        F.lit("COOLING").alias("family"), F.when(F.col("pinned"), "CRITICAL").otherwise("WARN").alias("severity"), F.col("pinned").alias("runaway"), F.lit("SIGNAL").alias("trigger"), F.lit("u").alias("unit"), null("double").alias("hard_limit"), null("double").alias("hours_left"), "deviation", "slope", "z_slope").alias("i"))
    by_codes = newest(queries.code_rate_active(spark, sf), "vin", F.desc("hour"), "family").filter("active").select("vin", F.lit(1).alias("o"), F.struct(
        "family", F.lit("WARN").alias("severity"), F.lit(False).alias("runaway"), F.lit("CODE_RATE").alias("trigger"), null("string").alias("unit"), *[null("double").alias(c) for c in ("hard_limit", "hours_left", "deviation", "slope", "z_slope")]).alias("i"))
    listed_ = lambda d, x, name: d.groupBy("vin").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", *x))), lambda y: y["i"]).alias(name))
    inc = listed_(signal.unionByName(by_codes), ["i"], "incidents")

    opened = fleet.stored(open_campaigns(spark, sf), "open-campaigns")
    members = fleet.stored(more.member_table(spark, sf).join(opened, ["family_key", "grp"]).select("vin", "family_key", "members").distinct(), "open-members")
    risk = fleet.stored(queries.at_risk_last4(spark, sf).filter("at_risk").select("vin", F.lower("reason").alias("reason")), "at-risk")
    key = F.concat_ws("|", F.col("model_id").cast("string"), F.col("duty_type_id").cast("string"))
    sisters = opened.withColumn("cohort", F.substring("family_key", 3, 100)).join(vehicles.select("vin", key.alias("cohort")).join(risk, "vin"), "cohort").join(members.select("vin", "family_key"), ["vin", "family_key"], "left_anti").join(levels.select("vin", "deviation"), "vin", "left")
    group = lambda d, role, o: d.select("vin", F.lit(o).alias("o"), F.col("family_key").alias("k"), F.struct(F.lit(role).alias("role"), F.lit("COOLING").alias("family"), F.col("family_key").alias("place"), F.col("members").cast("long").alias("members"), (F.col("deviation") if "deviation" in d.columns else null("double")).alias("deviation"), F.lit("u").alias("unit")).alias("i"))
    both = listed_(group(members, "MEMBER", 0).unionByName(group(sisters, "SISTER", 1)), ["k", "i"], "campaigns")

    failed = queries.fix_verdict(spark, sf).filter("verdict = 'NOT_FIXED'").select("vin", F.to_date("repaired").cast("string").alias("not_fixed_day"))
    day = queries.trailing_24h_filter(spark, sf).select("vin", F.col("codes").alias("codes24"))
    driven = queries.behaviour_ratio(spark, sf).select("vin", F.col("ratio").alias("behaviour"))
    rows = ranked.withColumn("booked", F.when(F.col("slot") != "WAITING", F.col("slot")))
    for part in (inc, both, risk.groupBy("vin").agg(F.collect_list("reason").alias("at_risk")), failed, day, driven):
        rows = rows.join(part, "vin", "left")
    return rows.select("depot_id", "rank", "vin", texts(S.queue_reasons()).alias("reasons"))


# ---- campaigns


CAMPAIGN_SQL = f"""ps AS (SELECT * FROM {sub('campaign_open_poisson')}), gs AS (SELECT * FROM {sub('group_touching_buckets')}), mt AS (SELECT DISTINCT family_key, grp, vin FROM {sub('member_table')}),
md AS (SELECT family_key, grp, median(deviation) AS dev, median(slope) AS slope FROM mt JOIN n USING (vin) GROUP BY ALL),
lc AS (SELECT user_id AS vin, 'P' || (100 + max_by(k, event_id) % 40) AS code FROM (SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'error') GROUP BY user_id),
tc AS (SELECT family_key, grp, string_agg(code || ' (' || n || ')', ', ' ORDER BY n DESC, code) AS codes FROM (SELECT family_key, grp, code, count(*) AS n FROM mt JOIN lc USING (vin) GROUP BY family_key, grp, code QUALIFY row_number() OVER (PARTITION BY family_key, grp ORDER BY count(*) DESC, code) <= 3) GROUP BY ALL),
vs AS (SELECT family_key, grp, vin, 'v' || (vin % 3) AS version FROM mt), sz AS (SELECT vin % 8 || '|' || vin % 5 AS cohort, vin FROM (SELECT DISTINCT user_id AS vin FROM events)),
fw AS (SELECT family_key, grp, version, count(*) AS w FROM vs WHERE vin % 4 <> 0 GROUP BY family_key, grp, version QUALIFY row_number() OVER (PARTITION BY family_key, grp ORDER BY count(*) DESC, version) = 1),
fs AS (SELECT fw.family_key, fw.grp, fw.version, fw.w, (SELECT count(*) FROM sz WHERE sz.cohort = fw.family_key[3:] AND NOT EXISTS (SELECT 1 FROM mt WHERE mt.vin = sz.vin AND mt.family_key = fw.family_key AND mt.grp = fw.grp)) AS sisters,
  (SELECT count(*) FROM sz WHERE sz.cohort = fw.family_key[3:] AND sz.vin % 4 <> 0 AND 'v' || (sz.vin % 3) = fw.version AND NOT EXISTS (SELECT 1 FROM mt WHERE mt.vin = sz.vin AND mt.family_key = fw.family_key AND mt.grp = fw.grp)) AS sw FROM fw),
cl AS (SELECT gs.family_key, gs.grp, gs.members, gs.last_bucket - gs.first_bucket + 1 AS days, ps."lambda" AS lam, md.dev, md.slope, tc.codes, fs.version, fs.w, fs.sisters, fs.sw, round(gs.members * 10.0 / (gs.last_bucket - gs.first_bucket + 1), 6) AS ours, round(ps."lambda", 6) AS theirs, cc.cost_text,
  fs.sisters > 0 AND fs.w / gs.members >= 0.6 AND (fs.w / gs.members - fs.sw / fs.sisters) * 100 >= 20 AS shown FROM gs JOIN ps USING (family_key, grp) LEFT JOIN md USING (family_key, grp) LEFT JOIN tc USING (family_key, grp) LEFT JOIN fs USING (family_key, grp) JOIN {sub('campaign_cost')} cc USING (family_key, grp))"""


def campaign_rows(spark: SparkSession, sf: str) -> DataFrame:
    """family_key, grp and all that phrases.campaign_clues reads."""
    key = ["family_key", "grp"]
    members = fleet.stored(more.member_table(spark, sf).select(*key, "vin").distinct(), "members")
    levels, vehicles = now(spark, sf), fleet.registry(spark, sf)
    mids = members.join(levels, "vin").groupBy(*key).agg(F.median("deviation").alias("dev"), F.median("slope").alias("slope"))
    last = more.errors(spark, sf).groupBy("vin").agg(F.concat(F.lit("P"), (F.max_by("k", "seq") % 40 + 100).cast("string")).alias("code"))
    top = C.top_codes(members.join(last, "vin"), key).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "code", "vins"))), lambda x: F.struct(x["code"].alias("code"), x["vins"].alias("vins"))).alias("codes"))
    version = F.when(F.col("vin") % 4 != 0, F.concat(F.lit("v"), (F.col("vin") % 3).cast("string")))
    cohort = vehicles.select("vin", F.concat_ws("|", F.col("model_id").cast("string"), F.col("duty_type_id").cast("string")).alias("cohort"))
    keys = members.select(*key).distinct().withColumn("cohort", F.substring("family_key", 3, 100))
    sisters = keys.join(cohort, "cohort").join(members, [*key, "vin"], "left_anti").select(*key, "vin")
    group = F.concat_ws("#", "family_key", F.col("grp").cast("string")).alias("group")
    share = C.modal_share(members.select(group, "vin", version.alias("version")), sisters.select(group, "vin", version.alias("version")), "group").drop("members")
    out = queries.group_touching_buckets(spark, sf).withColumn("group", group).join(queries.campaign_open_poisson(spark, sf).select(*key, "lambda"), key).join(mids, key, "left").join(top, key, "left").join(share, "group", "left").join(more.campaign_cost(spark, sf).select(*key, "cost", "cost_text"), key)
    days = F.col("last_bucket") - F.col("first_bucket") + 1
    part = lambda i: F.split_part("family_key", F.lit("|"), F.lit(i))
    return out.withColumns({"days": days, "model": part(2), "duty": part(3), "place": F.lit("all depots"), "family": F.lit("COOLING"), "unit": F.lit("u"), "key_per_1000": F.round(F.col("members") * 10.0 / days, 6), "regional_per_1000": F.col("lambda")})


@query("WITH " + NOW_SQL + ", " + CAMPAIGN_SQL + " SELECT family_key, grp, " + listed(
    ("true", "PLACE", said("PLACE", members="members", model="split_part(family_key, '|', 2)", duty="split_part(family_key, '|', 3)", place="'all depots'", family="'COOLING'")),
    ("dev IS NOT NULL", "TREND", "(" + said("TREND", amount=tenth("abs(dev)"), unit="'u'", side=side("dev")) + " || if(slope > 0, " + said("TREND_RISING", amount=hundredth("slope"), unit="'u'") + ", ''))"),
    ("codes IS NOT NULL", "CODES", said("CODES", codes="codes")),
    ("shown", "FIRMWARE", said("FIRMWARE", with_="w", members="members", version="version", sisters_with="sw", sisters="sisters")),
    ("true", "SURPRISE", said("SURPRISE", members="members", days="days", expected=tenth("lam"))),
    ("true", "REGION", "if(theirs * 3 < ours, " + said("REGION_CALM", theirs=tenth("theirs"), ours=tenth("ours")) + ", " + said("REGION_TOO", theirs=tenth("theirs"), ours=tenth("ours")) + ")"),
    ("true", "MONEY", said("MONEY", cost="cost_text")),
) + " AS clues FROM cl", roles=False)
def campaign_clues(spark: SparkSession, sf: str) -> DataFrame:
    """The seven clues of every group: place, median trend of its members, codes, firmware against sisters, chance, the rest, money."""
    return campaign_rows(spark, sf).select("family_key", "grp", texts(S.campaign_clues()).alias("clues"))


@query(", s AS (SELECT model_id, duty_type_id, depot_id, count(*) AS vans FROM veh GROUP BY ALL), i AS (SELECT vin, ts, model_id, duty_type_id, depot_id FROM r JOIN veh USING (vin) WHERE evt = 'error' AND k >= 60), a AS (SELECT model_id, duty_type_id, depot_id, max(ts) AS until FROM i GROUP BY ALL) SELECT a.*, coalesce(o.vans, 0) AS other_vans, coalesce(x.n, 0) AS vins, round(CASE WHEN o.vans > 0 THEN 1000.0 * coalesce(x.n, 0) / (o.vans * 3) ELSE 0 END, 6) AS per_1000 FROM a LEFT JOIN LATERAL (SELECT CAST(sum(vans) AS BIGINT) AS vans FROM s WHERE s.model_id = a.model_id AND s.duty_type_id = a.duty_type_id AND s.depot_id <> a.depot_id) o ON true LEFT JOIN LATERAL (SELECT count(DISTINCT vin) AS n FROM i WHERE i.model_id = a.model_id AND i.duty_type_id = a.duty_type_id AND i.depot_id <> a.depot_id AND i.ts > a.until - INTERVAL 3 DAY AND i.ts <= a.until) x ON true")
def cohort_rate_trailing(spark: SparkSession, sf: str) -> DataFrame:
    """The rate of a cohort elsewhere in the three days before each place's newest incident."""
    vehicles, cohort = fleet.registry(spark, sf), ["model_id", "duty_type_id"]
    sizes = vehicles.groupBy(*cohort, "depot_id").agg(F.count(F.lit(1)).alias("vans"))
    rows = fleet.readings(spark, sf).filter("evt = 'error' and k >= 60").join(vehicles, "vin")
    asked = rows.groupBy(*cohort, "depot_id").agg(F.max("ts").alias("until"))
    return rounded(C.rate_in_window(rows, cohort, "depot_id", sizes, asked, 3))


@query(", f AS (SELECT vin, min(ts) AS first_ts FROM r WHERE evt = 'error' AND k >= 60 GROUP BY vin) SELECT vin, first_ts, (SELECT max_by('v' || (k % 5), {'a': ts, 'b': 'v' || (k % 5)}) FROM r WHERE r.vin = f.vin AND evt = 'signup' AND r.ts > first_ts - INTERVAL 3 DAY AND r.ts <= first_ts) AS version FROM f")
def firmware_before_incident(spark: SparkSession, sf: str) -> DataFrame:
    """Sign-ups stand for installs: the version that a unit took in the three days before its first incident."""
    r = fleet.readings(spark, sf)
    first = r.filter("evt = 'error' and k >= 60").groupBy("vin").agg(F.min("ts").alias("first_ts")).withColumn("group", F.lit(1))
    installs = r.filter("evt = 'signup'").select("vin", "ts", F.concat(F.lit("v"), (F.col("k") % 5).cast("string")).alias("version"))
    return C.installed_before(installs, first, "group").select("vin", "first_ts", "version")


# ---- places and pages


@query("""SELECT cell, b, count(*) AS n FROM (SELECT b, array_to_string([substr('0123456789bcdefghjkmnpqrstuvwxyz', 1 + CAST(list_sum([bits[5 * c + j + 1] * CAST(pow(2, 4 - j) AS BIGINT) for j in range(0, 5)]) AS BIGINT), 1) for c in range(0, 5)], '') AS cell
FROM (SELECT b, [CASE WHEN i % 2 = 0 THEN (x >> (12 - i // 2)) & 1 ELSE (y >> (11 - i // 2)) & 1 END for i in range(0, 25)] AS bits FROM (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS b, CAST(floor(((vin * 37 + k) % 36000 / 100.0) / 360 * 8192) AS BIGINT) AS x, CAST(floor(((vin * 53 + k) % 18000 / 100.0) / 180 * 4096) AS BIGINT) AS y FROM r))) GROUP BY ALL""")
def cell_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Readings of each grid cell in each day; units move a little around a place of their own."""
    vin, k = F.col("vin"), F.col("k")
    lat, lon = (vin * 53 + k) % 18000 / 100.0 - 90, (vin * 37 + k) % 36000 / 100.0 - 180
    rows = fleet.readings(spark, sf).select(X.geohash5(lat, lon).alias("cell"), X.bucket(F.col("ts"), 24).alias("b"))
    return rows.groupBy("cell", "b").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + NOW_SQL + ", " + CAMPAIGN_SQL + f""", ar AS (SELECT vin FROM {sub('at_risk_last4')} WHERE at_risk)
SELECT family_key, grp, members, opens, (SELECT string_agg(CAST(vin AS VARCHAR), ',' ORDER BY vin) FROM mt WHERE mt.family_key = gs.family_key AND mt.grp = gs.grp) AS vins,
  coalesce((SELECT string_agg(CAST(vin AS VARCHAR), ',' ORDER BY vin) FROM sz WHERE cohort = gs.family_key[3:] AND vin IN (SELECT vin FROM ar) AND NOT EXISTS (SELECT 1 FROM mt WHERE mt.family_key = gs.family_key AND mt.grp = gs.grp AND mt.vin = sz.vin)), '') AS at_risk,
  coalesce((SELECT string_agg(CAST(o.grp AS VARCHAR), ',' ORDER BY o.grp) FROM gs o WHERE o.family_key = gs.family_key AND o.grp < gs.grp), '') AS history FROM gs JOIN (SELECT family_key, grp, opens FROM ps) USING (family_key, grp)""", roles=False)
def campaign_detail(spark: SparkSession, sf: str) -> DataFrame:
    """A campaign's page: members, sisters at risk, whether it opens, and the key's earlier groups."""
    key = ["family_key", "grp"]
    groups = fleet.stored(queries.group_touching_buckets(spark, sf).select(*key, "members"), "groups")
    members = fleet.stored(more.member_table(spark, sf).select(*key, "vin").distinct(), "members")
    risk = queries.at_risk_last4(spark, sf).filter("at_risk").select("vin").join(fleet.registry(spark, sf), "vin")
    cohort = risk.select("vin", F.concat_ws("|", F.col("model_id").cast("string"), F.col("duty_type_id").cast("string")).alias("cohort"))
    sisters = groups.withColumn("cohort", F.substring("family_key", 3, 100)).join(cohort, "cohort").join(members, [*key, "vin"], "left_anti")
    texts_ = lambda d, c, n: P.ordered_children(d.select(*key, c), key, c, [], "items").select(*key, F.array_join(F.transform("items", lambda x: x[c].cast("string")), ",").alias(n))
    earlier = F.collect_list("grp").over(Window.partitionBy("family_key").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1))
    out = groups.withColumn("history", F.array_join(F.transform(earlier, lambda x: x.cast("string")), ","))
    out = out.join(queries.campaign_open_poisson(spark, sf).select(*key, "opens"), key).join(texts_(members, "vin", "vins"), key).join(texts_(sisters, "vin", "at_risk"), key, "left")
    return out.withColumn("at_risk", F.coalesce("at_risk", F.lit("")))


@query(f"""WITH b AS (SELECT * FROM {sub('bay_fill')}), c AS (SELECT CAST(vin % 25 AS BIGINT) AS depot_id, family_key, grp, count(*) AS own FROM (SELECT DISTINCT family_key, grp, vin FROM {sub('member_table')} WHERE active) GROUP BY ALL), p AS (SELECT family_key, grp, opens FROM {sub('campaign_open_poisson')})
SELECT depot_id, (SELECT count(*) FROM b x WHERE x.depot_id = d.depot_id AND slot = 'TODAY') AS today, (SELECT count(*) FROM b x WHERE x.depot_id = d.depot_id AND slot = 'TOMORROW') AS tomorrow, (SELECT count(*) FROM b x WHERE x.depot_id = d.depot_id AND slot = 'WAITING') AS waiting, 1 + depot_id % 3 AS bays,
  (SELECT count(*) FROM c JOIN p USING (family_key, grp) WHERE c.depot_id = d.depot_id AND opens) AS open_campaigns,
  coalesce((SELECT string_agg(family_key || '#' || grp || ':' || own, ',' ORDER BY own DESC, family_key, grp) FROM c JOIN p USING (family_key, grp) WHERE c.depot_id = d.depot_id AND NOT opens AND own >= 2), '') AS watching FROM (SELECT DISTINCT depot_id FROM b) d""", roles=False)
def depot_page(spark: SparkSession, sf: str) -> DataFrame:
    """A depot's page: bays, who stands where, open campaigns with members there, and groups to watch (two members or more)."""
    key = ["family_key", "grp"]
    board = queries.bay_fill(spark, sf).groupBy("depot_id").agg(*[F.count_if(F.col("slot") == s.upper()).alias(s) for s in ("today", "tomorrow", "waiting")])
    own = more.member_table(spark, sf).filter("active").select(*key, "vin").distinct().groupBy((F.col("vin") % 25).alias("depot_id"), *key).agg(F.count(F.lit(1)).alias("own"))
    own = fleet.stored(own.join(queries.campaign_open_poisson(spark, sf).select(*key, "opens"), key), "depot-groups")
    opened = own.filter("opens").groupBy("depot_id").agg(F.count(F.lit(1)).alias("open_campaigns"))
    text = F.concat("family_key", F.lit("#"), F.col("grp").cast("string"), F.lit(":"), F.col("own").cast("string"))
    watched = own.filter("not opens and own >= 2").groupBy("depot_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("own")).alias("n"), *key, text.alias("t")))), lambda x: x["t"]), ",").alias("watching"))
    page = board.join(opened, "depot_id", "left").join(watched, "depot_id", "left").withColumn("bays", 1 + F.col("depot_id") % 3)
    return page.withColumns({"open_campaigns": F.coalesce("open_campaigns", F.lit(0).cast("long")), "watching": F.coalesce("watching", F.lit(""))})


@query(f"""WITH h AS (SELECT vin, hour FROM {sub('hourly_rollup')}), k AS (SELECT vin, min(ts) AS t FROM (SELECT vin, ts FROM {sub('kofn_confirm')} c JOIN (SELECT event_id AS seq, ts FROM events) USING (seq) WHERE confirmed) GROUP BY vin),
g AS (SELECT vin, min(first_hit) AS t FROM {sub('global_rule_hits')} GROUP BY vin), c AS (SELECT m.vin, min(first_bucket) AS b FROM {sub('member_table')} m JOIN {sub('group_touching_buckets')} t USING (family_key, grp) JOIN {sub('campaign_open_poisson')} p USING (family_key, grp) WHERE opens GROUP BY m.vin)
SELECT h.vin, hour, coalesce(k.t < hour + INTERVAL 1 HOUR, false) AS confirmed_before, coalesce(g.t < hour + INTERVAL 1 HOUR, false) AS global_before, coalesce(c.b * 86400 < epoch(hour) + 3600, false) AS campaign_before FROM h LEFT JOIN k USING (vin) LEFT JOIN g USING (vin) LEFT JOIN c USING (vin)""", roles=False)
def rule_columns_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Three rules as columns of the feature table, as they stood at each hour's end: confirmed by the unit's own readings, by the plain threshold, member of a campaign that opens."""
    hours = queries.hourly_rollup(spark, sf).select("vin", "hour")
    times = fleet.readings(spark, sf).select("seq", "ts")
    own = queries.confirmed(spark, sf).filter("confirmed").select("vin", "seq").join(times, "seq").groupBy("vin").agg(F.min("ts").alias("own"))
    plain = queries.global_rule_hits(spark, sf).groupBy("vin").agg(F.min("first_hit").alias("plain"))
    key = ["family_key", "grp"]
    joined = more.member_table(spark, sf).join(queries.group_touching_buckets(spark, sf).select(*key, "first_bucket"), key).join(queries.campaign_open_poisson(spark, sf).filter("opens").select(*key), key).groupBy("vin").agg(F.min("first_bucket").alias("day"))
    rows = hours.join(own, "vin", "left").join(plain, "vin", "left").join(joined, "vin", "left")
    end = F.col("hour") + F.expr("INTERVAL 1 HOUR")
    before = lambda c: F.coalesce(c < end, F.lit(False))
    day = F.coalesce(F.col("day") * 86_400 < F.unix_micros(F.col("hour").cast("timestamp")) / 1_000_000 + 3600, F.lit(False))
    return rows.select("vin", "hour", before(F.col("own")).alias("confirmed_before"), before(F.col("plain")).alias("global_before"), day.alias("campaign_before"))
