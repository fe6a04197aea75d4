"""Trends, scores and confirmations as window expressions, and the per-unit detection fold for feedback that windows cannot express."""

from __future__ import annotations

from math import exp, isnan

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import bucket, hours
from ..params import Detect, Metric
from ..sources.scratch import stored
from .folds import ordered_fold


def weighted_trend(rows: DataFrame, keys: list[str], tau_h: float = 12.0, order: str = "seq") -> DataFrame:
    """rows(keys, ts, y, order), in event order per key -> weight, mean, slope of an exponentially forgetting line at each row."""
    return weighted_trends(rows, keys, {"": tau_h}, order)


def weighted_trends(rows: DataFrame, keys: list[str], taus: dict[str, float], order: str = "seq") -> DataFrame:
    """The same for several lines at once (suffix of their columns -> tau), in one sort of the rows.

    Running sums of exp(t / tau) * {1, t, t^2, y, ty}, re-centred at each row. A key's time is cut into stretches of 400
    of the shortest tau that each begin anew, fed with 40 of the longest before them (what is older weighs under
    1e-17), so no span overflows.
    """
    short, long = min(taus.values()), max(taus.values())
    size, before = max(400.0 * short, 80.0 * long), 40.0 * long
    if size / short > 600:
        raise ValueError("the longest tau must not be over 7 times the shortest")
    t = hours(F.col("ts")) - F.min(hours(F.col("ts"))).over(Window.partitionBy(*keys))
    length = F.lit(size)
    d = rows.select("*", t.alias("__t")).withColumn("__p", F.floor(F.col("__t") / length).cast("long"))
    late = F.col("__t") - F.col("__p") * length >= size - before
    d = d.withColumn("__in", F.explode(F.when(late, F.array(F.col("__p"), F.col("__p") + 1)).otherwise(F.array("__p"))))
    d = d.withColumn("t", F.col("__t") - F.col("__in") * length)
    run = Window.partitionBy(*keys, "__in").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = {}
    for name, tau in taus.items():
        g = F.exp(F.col("t") / tau)
        sums |= {f"s0{name}": g, f"s1{name}": g * F.col("t"), f"s2{name}": g * F.col("t") * F.col("t"), f"sy{name}": g * F.col("y"), f"sty{name}": g * F.col("t") * F.col("y")}
    d = d.withColumns({k: F.sum(v).over(run) for k, v in sums.items()}).filter(F.col("__in") == F.col("__p"))
    out = []
    for name, tau in taus.items():
        s0, s1, s2, sy, sty = (F.col(f"{k}{name}") for k in ("s0", "s1", "s2", "sy", "sty"))
        mt, my = s1 / s0, sy / s0
        var, cov = s2 / s0 - mt * mt, sty / s0 - mt * my
        out += [(s0 * F.exp(-F.col("t") / tau)).alias(f"weight{name}"), my.alias(f"mean{name}"), F.when(var >= 0.01, cov / var).alias(f"slope{name}")]
    return d.select(*rows.columns, *out)


def k_of_n(rows: DataFrame, keys: list[str], order: str, abnormal: Column, k: int = 4, n: int = 6) -> DataFrame:
    """confirmed: at least k of the last n rows are abnormal; run: abnormal or normal rows in a row so far."""
    w = Window.partitionBy(*keys).orderBy(order)
    flags = rows.withColumn("abnormal", abnormal.cast("int"))
    recent = F.sum("abnormal").over(w.rowsBetween(-(n - 1), 0))
    changed = F.when(F.col("abnormal") == F.lag("abnormal").over(w), 0).otherwise(1)
    island = flags.withColumns({"recent": recent.cast("long"), "changed": changed}).withColumn("island", F.sum("changed").over(w))
    run = F.row_number().over(Window.partitionBy(*keys, "island").orderBy(order))
    return island.withColumns({"run": run.cast("long"), "confirmed": F.col("recent") >= k}).drop("changed", "island")


def codes_in_24h(codes: DataFrame, keys: list[str]) -> DataFrame:
    """codes(keys, ts) -> keys, hour, n, n24: codes of the hour and of it and the 23 before."""
    by_hour = codes.groupBy(*keys, bucket(F.col("ts"), 1).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return by_hour.withColumn("n24", F.sum("n").over(Window.partitionBy(*keys).orderBy("hour").rangeBetween(-23, 0)))


def peer_medians(devs: DataFrame, scope: list[str], min_peers: int = 10) -> DataFrame:
    """devs(vin, scope, hour, dev), the newest deviation of each unit in the hour -> scope, hour, peers, peer_dev (where enough peers)."""
    return devs.groupBy(*scope, "hour").agg(F.count(F.lit(1)).alias("peers"), F.median("dev").alias("peer_dev")).filter(F.col("peers") >= min_peers)


def hourly_deviation(scored: DataFrame, value: str = "dev", order: str = "seq") -> DataFrame:
    """Newest deviation of each unit and metric in each hour, with the unit's scopes."""
    keys = ["vin", "metric", "region_id", "duty_type_id", bucket(F.col("ts"), 1).alias("hour")]
    return scored.groupBy(*keys).agg(F.max_by(value, order).alias("dev"))


def minus_peers(devs: DataFrame, min_peers: int = 10) -> DataFrame:
    """Deviation minus the median of the peers in the same hour: region x duty, else region, else nothing."""
    fine = peer_medians(devs, ["region_id", "duty_type_id", "metric"], min_peers).withColumnRenamed("peer_dev", "fine").drop("peers")
    wide = peer_medians(devs, ["region_id", "metric"], min_peers).withColumnRenamed("peer_dev", "wide").drop("peers")
    out = devs.join(fine, ["region_id", "duty_type_id", "metric", "hour"], "left").join(wide, ["region_id", "metric", "hour"], "left")
    return out.withColumn("adj", F.col("dev") - F.coalesce("fine", "wide", F.lit(0.0))).drop("fine", "wide")


class Line:
    """Exponentially forgetting line through (t, y); a late point enters with the weight of its age."""

    __slots__ = ("at", "n", "t", "tau", "tt", "ty", "y")

    def __init__(self, tau: float):
        self.tau, self.n = tau, 0.0
        self.at = self.t = self.tt = self.y = self.ty = 0.0

    def add(self, at: float, y: float) -> None:
        if not self.n:
            self.at, self.n, self.y = at, 1.0, y
            return
        d = at - self.at
        w = exp(-abs(d) / self.tau)
        if d < 0:
            self.n, self.t, self.tt, self.y, self.ty = self.n + w, self.t + w * d, self.tt + w * d * d, self.y + w * y, self.ty + w * d * y
            return
        tt = w * (self.tt - 2 * d * self.t + d * d * self.n)
        ty = w * (self.ty - d * self.y)
        self.at, self.t, self.tt, self.ty = at, w * (self.t - d * self.n), tt, ty
        self.n, self.y = w * self.n + 1, w * self.y + y

    @property
    def mean(self) -> float:
        return self.y / self.n

    @property
    def slope(self) -> float | None:
        var = self.tt / self.n - (self.t / self.n) ** 2
        return (self.ty / self.n - self.t * self.y / self.n**2) / var if var >= 0.01 else None

    @property
    def now(self) -> float:
        b = self.slope
        return self.mean if b is None else (self.y - b * self.t) / self.n


class Unit:
    """State of one unit and metric: guard, trends, k-of-n ring, run counters. step() takes one qualifying reading."""

    def __init__(self, metric: Metric, p: Detect):
        self.m, self.p = metric, p
        self.slow, self.fast = Line(p.tau_h), Line(p.fast_tau_h)
        self.last: tuple[float, float] | None = None
        self.rejected: tuple[int, float, float] = (0, 0.0, 0.0)
        self.ring: list[bool] = []
        self.normal = self.toward = 0

    def _guard(self, t: float, y: float) -> bool:
        """Whether the reading is taken. A run of rejected readings that agree over long enough restarts the trend."""
        if self.last is None:
            return True
        minutes = max((t - self.last[0]) * 60, 1 / 60)
        if abs(y - self.last[1]) / minutes <= self.m.max_rate_per_min and abs(y - self.fast.mean) <= self.m.spike_max:
            self.rejected = (0, 0.0, 0.0)
            return True
        n, since, before = self.rejected
        self.rejected = (n + 1, since, y) if n and abs(y - before) <= self.m.spike_max else (1, t, y)
        if self.rejected[0] >= 2 and t - self.rejected[1] >= self.p.reject_reset_h:
            self.slow, self.fast, self.rejected = Line(self.p.tau_h), Line(self.p.fast_tau_h), (0, 0.0, 0.0)
            return True
        return False

    def take(self, t: float, y: float) -> bool:
        """Whether the guard takes the reading; its trends then hold it."""
        if not self._guard(t, y):
            return False
        self.slow.add(t, y)
        self.fast.add(t, y)
        self.last = (t, y)
        return True

    def step(self, t: float, y: float, normal: tuple[float, float, float, float], peers: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> dict | None:
        """t in hours; normal: median, MAD, slope median, slope MAD; peers: their deviation, slope deviation and fast slope now. Returns the score, if scored."""
        m, p = self.m, self.p
        if not self.take(t, y):
            return None
        median, mad, slope_median, slope_mad = normal
        if self.slow.n < p.min_weight or isnan(median):
            return None
        slope = self.slow.slope
        dev, slope_dev = self.slow.mean - median, 0.0 if slope is None else slope - slope_median
        z = m.direction * (dev - peers[0]) / (1.4826 * max(mad, m.min_mad))
        zs = 0.0 if slope is None else m.direction * (slope_dev - peers[1]) / (1.4826 * max(slope_mad, m.min_slope_mad))
        abnormal = z >= p.z_level or (zs >= p.z_slope and z >= p.z_level_with_slope)
        self.ring = [*self.ring[-(p.n - 1) :], abnormal]
        confirmed = sum(self.ring) >= p.k
        self.normal = 0 if abnormal else self.normal + 1
        left = None
        if m.hard_limit is not None:
            rate = None if self.fast.slope is None else m.direction * (self.fast.slope - peers[2])
            if rate is not None and rate >= m.min_rate:
                left = max(0.0, m.direction * (m.hard_limit - self.fast.now) / rate)
            self.toward = self.toward + 1 if abnormal and confirmed and left is not None and left < p.runaway_h else 0
        return {"dev": dev, "adj": dev - peers[0], "z": z, "zs": zs, "confirmed": confirmed, "hours_left": left, "runaway": self.toward >= p.runaway_run}


#: What a row without a score or an incident shows.
NONE = dict.fromkeys(("dev", "adj", "z", "zs", "confirmed", "hours_left", "trigger", "bucket", "severity"))


class Vehicle:
    """State of one unit: its metrics, codes by hour and family, open incidents, last repair. step() takes a reading, codes or a repair."""

    def __init__(self, metrics: dict[str, tuple[str, Metric]], p: Detect):
        self.metrics, self.p = metrics, p  # metric -> family, parameters
        self.units: dict[str, Unit] = {}
        self.codes: dict[str, dict[int, int]] = {}
        self.usual: dict[str, float] = {}
        self.open: dict[str, dict] = {}
        self.repaired, self.seen = float("-inf"), None

    def _rate(self, family: str, t: float) -> tuple[int, bool]:
        """Codes of the family in this hour and the 23 before, and whether they are well above what is usual a day."""
        ring, n = self.codes.get(family), 0
        if ring:
            hour = int(t // 1)
            for h in [h for h in ring if h < hour - 48]:
                del ring[h]
            n = sum(c for h, c in ring.items() if hour - 23 <= h <= hour)
        return n, n >= max(self.p.code_min, self.p.code_factor * self.usual.get(family, 0.0))

    def _row(self, codes24, family, metric=None, score=None, action=None, incident=None) -> dict:
        s, i = score or NONE, incident or NONE
        return {"metric": metric, "family": family, "dev": s["dev"], "adj": s["adj"], "z": s["z"], "zs": s["zs"], "confirmed": s["confirmed"], "hours_left": s["hours_left"], "codes24": codes24, "action": action, "trigger": i["trigger"], "bucket": i["bucket"], "severity": i["severity"]}

    def _code_rule(self, family: str, t: float) -> list[dict]:
        (n, active), now = self._rate(family, t), self.open.get(family)
        if now is None and active:
            self.open[family] = now = {"bucket": int(t // self.p.bucket_h), "trigger": "CODE_RATE", "severity": "WARN", "runaway": False}
            return [self._row(n, family, action="OPEN", incident=now)]
        if now is not None and now["trigger"] == "CODE_RATE" and not active:
            del self.open[family]
            return [self._row(n, family, action="CLOSE", incident=now)]
        return []

    def step(self, t: float, kind: str, name: str, y: float, usual: float | None, normal: tuple, peers: tuple) -> list[dict]:
        """kind READING: name is a metric, y its value; CODES: name is a family, y their number; REPAIR: trends, rings and codes start again, open incidents stay until readings close them."""
        if kind == "REPAIR":
            if t > self.repaired:
                self.repaired, self.units, self.codes = t, {}, {}
            return []
        if t < self.repaired:
            return []
        if kind == "CODES":
            ring = self.codes.setdefault(name, {})
            ring[int(t // 1)] = ring.get(int(t // 1), 0) + int(y)
            self.usual[name] = usual or 0.0
            return self._code_rule(name, t)
        family, m = self.metrics[name]
        if usual is not None:
            self.usual[family] = usual
        out = [row for f in list(self.open) if f != family and self.open[f]["trigger"] == "CODE_RATE" for row in self._code_rule(f, t)]
        unit = self.units.setdefault(name, Unit(m, self.p))
        score = unit.step(t, y, normal, peers)
        if score is None:
            return out
        now, (n, active) = self.open.get(family), self._rate(family, t)
        severity = "CRITICAL" if score["runaway"] else "HIGH" if score["z"] >= 2 * self.p.z_level or active else "WARN"
        action, shown = None, now
        if now is None and score["confirmed"]:
            shown = self.open[family] = {"bucket": int(t // self.p.bucket_h), "trigger": "SIGNAL", "severity": severity, "runaway": score["runaway"]}
            action = "OPEN"
        elif now is not None and now["trigger"] == "CODE_RATE" and score["confirmed"]:
            now |= {"trigger": "SIGNAL", "severity": "CRITICAL" if score["runaway"] else "HIGH", "runaway": score["runaway"]}
            action = "ESCALATE"
        elif now is not None and score["runaway"] and not now["runaway"]:
            now |= {"severity": "CRITICAL", "runaway": True}
            action = "ESCALATE"
        elif now is not None and unit.normal >= self.p.close_after and not active:
            del self.open[family]
            unit.toward, action = 0, "CLOSE"
        out.append(self._row(n, family, name, score, action, shown))
        return out if shown is None or shown["trigger"] == "SIGNAL" else out + self._code_rule(family, t)


FOLD = "vin long, seq long, ts timestamp, metric string, family string, dev double, adj double, z double, zs double, confirmed boolean, hours_left double, codes24 long, action string, trigger string, bucket long, severity string"
#: What the fold reads, in order.
INPUT = ("vin", "seq", "ts", "kind", "name", "y", "usual", "median", "mad", "slope_median", "slope_mad", "peer_dev", "peer_slope", "peer_fast")


def vehicle_step(v: Vehicle, row: tuple) -> list[tuple]:
    """A row of INPUT; a (seq, kind, name) met before is skipped."""
    vin, seq, ts, kind, name, y, usual, *rest = row
    if v.seen is not None and (seq, kind, name) <= v.seen:
        return []
    v.seen = (seq, kind, name)
    if kind != "REPAIR" and (y is None or isnan(y)):
        return []
    rest = [float("nan") if x is None else x for x in rest]
    peers = tuple(0.0 if isnan(x) else x for x in rest[4:])
    normal = (rest[0], *[0.0 if isnan(x) else x for x in rest[1:4]])
    out = v.step(ts / 3.6e9, kind, name, y, None if usual is None or isnan(usual) else usual, normal, peers)
    return [(vin, seq, ts, *r.values()) for r in out]


def detect_input(rows: DataFrame) -> DataFrame:
    return rows.select("vin", "seq", F.col("ts").cast("timestamp").alias("ts"), "kind", "name", *[F.col(c).cast("double").alias(c) for c in INPUT[5:]])


def detect_fold(rows: DataFrame, metrics: dict[str, tuple[str, Metric]], p: Detect = Detect()) -> DataFrame:
    """rows(INPUT), qualifying readings with their normal and their peers, codes and repairs -> FOLD, a row for each scored reading and each change by codes.

    Rows of a unit are taken in seq order; a repeated one is skipped. See with_peers for the peers' columns.
    """
    return ordered_fold(detect_input(rows), ["vin"], ["seq", "kind", "name"], lambda r: Vehicle(metrics, p), vehicle_step, FOLD)


def with_peers(readings: DataFrame, registry: DataFrame, p: Detect = Detect()) -> DataFrame:
    """readings(vin, metric, seq, ts, y, median, mad, slope_median, slope_mad) with peer_dev, peer_slope and peer_fast: medians of the peers' newest values of the hour.

    A first pass over all units takes trends as window sums (without the guard: medians do not mind its few readings),
    both in one sort; peers are region x duty where enough of them have a value in the hour, else the region, else
    nothing. See peers.py for the form whose peers are those of the last hours at each reading.
    """
    placed = readings.join(registry.select("vin", "region_id", "duty_type_id"), "vin").withColumn("hour", bucket(F.col("ts"), 1))
    scope = ["region_id", "duty_type_id", "metric", "hour"]
    both = weighted_trends(placed.select("vin", "seq", "ts", "y", "median", "slope_median", *scope), ["vin", "metric"], {"": p.tau_h, "_fast": p.fast_tau_h}).filter(F.col("weight") >= p.min_weight)
    value = F.struct((F.col("mean") - F.col("median")).alias("dev"), F.coalesce(F.col("slope") - F.col("slope_median"), F.lit(0.0)).alias("slope"), F.coalesce("slope_fast", F.lit(0.0)).alias("fast"))
    newest = both.groupBy("vin", *scope).agg(F.max_by(value, "seq").alias("x"))
    wider = ["region_id", "metric", "hour"]
    # both medians in one pass over the trends, dealt first, so that a task meets a place and hour whole; a row for each of
    # these, however many units, so they are stored
    whole = F.grouping("duty_type_id").alias("whole")
    mids = newest.repartition(*wider).groupingSets([[F.col(c) for c in scope], [F.col(c) for c in wider]], *[F.col(c) for c in scope]).agg(F.count(F.lit(1)).alias("k"), F.struct(*[F.median(f"x.{c}").alias(c) for c in ("dev", "slope", "fast")]).alias("mid"), whole)
    mids = stored(mids.filter(F.col("k") >= p.min_peers), "peers")
    near, wide = mids.filter("whole = 0").select(*scope, F.col("mid").alias("near")), mids.filter("whole = 1").select(*wider, F.col("mid").alias("wide"))
    out = placed.join(near, scope, "left").join(wide, wider, "left")
    return out.select(*readings.columns, *[F.coalesce(f"near.{c}", f"wide.{c}").alias(f"peer_{c}") for c in ("dev", "slope", "fast")])


def qualifying(readings: DataFrame, metrics: dict[str, tuple[float, float]], warmup_min: float = 25.0, parked: tuple[str, ...] = ("lv_batt_v",)) -> DataFrame:
    """Canonical readings -> vin, seq, ts, metric, y: those that a metric's normal and score may use.

    Periodic, ignition on, not flagged as skewed, late or out of range; and, but for metrics that also count when
    parked, driving, not charging, and long enough after the ignition came on (unknown: any time).
    """
    since = F.last(F.when(F.col("evt") == "IGNITION_ON", F.struct(F.col("ts").alias("on"))).when(F.col("evt") == "IGNITION_OFF", F.struct(F.lit(None).cast(readings.schema["ts"].dataType).alias("on"))), ignorenulls=True)
    on = since.over(Window.partitionBy("vin").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))["on"]
    flagged = lambda f: F.array_contains("quality_flags", f)
    rows = readings.withColumn("__on", on).filter((F.col("evt") == "PERIODIC") & F.col("ignition") & ~flagged("CLOCK_SKEW") & ~flagged("LATE"))
    warm = F.col("__on").isNull() | (hours(F.col("ts")) - hours(F.col("__on")) >= warmup_min / 60)
    moving = ~F.col("charging") & (F.coalesce("speed_kmh", F.lit(0.0)) > 0) & warm
    long = rows.withColumn("__moving", moving).unpivot(["vin", "seq", "ts", "quality_flags", "__moving"], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "y")
    allowed = F.lit(False)
    for m, (low, high) in metrics.items():
        allowed = allowed | ((F.col("metric") == m) & F.col("y").between(low, high))
    bad = F.array_contains("quality_flags", F.concat(F.lit("OUT_OF_RANGE:"), F.col("metric")))
    return long.filter(allowed & ~bad & (F.col("metric").isin(*parked) | F.col("__moving"))).select("vin", "seq", "ts", "metric", "y")


def code_rate(codes: DataFrame, usual: DataFrame, p: Detect = Detect()) -> DataFrame:
    """codes(vin, family, ts), usual(vin, family, codes_per_day) -> vin, family, hour, n24, threshold, active: hours with codes, and whether their 24 hours are well above usual."""
    ring = codes_in_24h(codes, ["vin", "family"]).join(usual, ["vin", "family"], "left")
    threshold = F.greatest(F.lit(float(p.code_min)), p.code_factor * F.coalesce("codes_per_day", F.lit(0.0)))
    return ring.select("vin", "family", "hour", "n24", threshold.alias("threshold"), (F.col("n24") >= threshold).alias("active"))


def global_hits(rows: DataFrame, keys: list[str], over: Column, p: Detect = Detect()) -> DataFrame:
    """keys, first_hit: when the plain rule (k of the last n over one fixed threshold, no own normal, no guard) held first."""
    return k_of_n(rows, keys, "seq", over, p.k, p.n).filter("confirmed").groupBy(*keys).agg(F.min("ts").alias("first_hit"))
