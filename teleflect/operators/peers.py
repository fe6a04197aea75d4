"""Peers as they stand at each reading: three ordered folds, by unit, by scope and by unit again, that a stream can run as well.

    units    each unit's trends; a reading goes on with how far it is from its own normal, once for each of its scopes
    scopes   the newest deviation of every unit of a scope; a reading goes on with the medians of those within +-2 h of it
    units    the two answers to a reading meet; the most specific scope with enough peers counts, and the reading is scored

A scope's readings go through one state, in order of time, so a scope is as wide as one task can go through; history is
better taken by detect.with_peers, whose peers are grouped by hour instead.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import isnan
from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import Detect, Metric
from .detect import FOLD, Unit, Vehicle, vehicle_step
from .folds import ordered_fold

HOUR = 3_600_000_000
#: What the first fold reads: readings with their normal and their unit's place, codes and repairs.
INPUT = ("vin", "seq", "ts", "kind", "name", "y", "usual", "median", "mad", "slope_median", "slope_mad", "region_id", "duty_type_id")
_CARRIED = "vin long, seq long, ts timestamp, kind string, name string, y double, usual double, median double, mad double, slope_median double, slope_mad double"
SCOPED = f"scope string, level int, {_CARRIED}, dev double, slope double, fast double"
ANSWERED = f"{_CARRIED}, level int, peers int, peer_dev double, peer_slope double, peer_fast double"


def peers_input(rows: DataFrame) -> DataFrame:
    """rows(INPUT) in its types."""
    doubles = INPUT[5:11]
    return rows.select("vin", "seq", F.col("ts").cast("timestamp").alias("ts"), "kind", "name", *[F.col(c).cast("double").alias(c) for c in doubles], F.col("region_id").cast("long").alias("region_id"), F.col("duty_type_id").cast("long").alias("duty_type_id"))


class Trends:
    """Trends of one unit, by metric; a repair begins them anew."""

    def __init__(self, metrics: dict[str, tuple[str, Metric]], p: Detect):
        self.metrics, self.p, self.units, self.repaired = metrics, p, {}, None

    def deviation(self, t: float, name: str, y: float, normal: float, slope_normal: float) -> tuple[float, float, float] | None:
        """How far level and slope are from the unit's own normal, and the fast slope; None while there is too little, or where the guard refuses."""
        unit = self.units.get(name)
        if unit is None:
            unit = self.units[name] = Unit(self.metrics[name][1], self.p)
        if not unit.take(t, y) or unit.slow.n < self.p.min_weight:
            return None
        slope, fast = unit.slow.slope, unit.fast.slope
        return unit.slow.mean - normal, 0.0 if slope is None else slope - slope_normal, 0.0 if fast is None else fast


def trend_step(state: Trends, row: tuple) -> list[tuple]:
    vin, _, us, kind, name, y, _, normal, _, slope_normal, _, region, duty = row
    own = row[:11]
    if kind != "READING":
        if kind == "REPAIR" and (state.repaired is None or us > state.repaired):
            state.repaired, state.units = us, {}
        return [(f"unit {vin}", 0, *own, None, None, None)]
    old = state.repaired is not None and us < state.repaired
    known = y is not None and not isnan(y) and normal is not None and not isnan(normal)
    found = state.deviation(us / 3.6e9, name, y, normal, slope_normal or 0.0) if known and not old else None
    return [(scope, level, *own, *(found or (None, None, None))) for level, scope in enumerate((f"{region}|{duty}|{name}", f"{region}|*|{name}"))]


@dataclass
class Scope:
    """Newest (time, deviations) of each unit, and the medians taken last."""

    newest: dict[int, tuple[int, tuple]] = field(default_factory=dict)
    taken: tuple | None = None
    hour: int = -1
    since: int = 0

    def centre(self, us: int, window: int, least: int, share: float) -> tuple:
        """Number and medians of the units seen within the window around a time (0 and nulls if too few). Taken anew in a new hour, and once a share of the units has news."""
        hour = us // HOUR
        if self.taken is None or hour != self.hour or self.since >= max(2.0, share * len(self.newest)):
            self.newest = {v: x for v, x in self.newest.items() if x[0] >= us - window - 24 * HOUR}  # long gone
            near = [x for at, x in self.newest.values() if abs(at - us) <= window]
            self.taken = (len(near), *(median(c) for c in zip(*near, strict=True))) if len(near) >= least else (0, None, None, None)
            self.hour, self.since = hour, 0
        return self.taken


def scope_step(p: Detect, share: float = 0.25):
    window = int(p.peer_window_h * HOUR)

    def step(state: Scope, row: tuple) -> list[tuple]:
        _, level, *own = row
        carried, found = tuple(own[:11]), tuple(own[11:])
        vin, us, kind = carried[0], carried[2], carried[3]
        if kind != "READING":
            return [(*carried, level, 0, None, None, None)]
        if found[0] is not None and (vin not in state.newest or state.newest[vin][0] <= us):
            state.newest[vin] = (us, found)
            state.since += 1
        return [(*carried, level, *state.centre(us, window, p.min_peers, share))]

    return step


class Meeting:
    """A unit's state, and the answer of the nearer scope until that of the wider one is there."""

    def __init__(self, metrics: dict[str, tuple[str, Metric]], p: Detect):
        self.unit, self.near = Vehicle(metrics, p), None


def meeting_step(state: Meeting, row: tuple) -> list[tuple]:
    *carried, level, peers, dev, slope, fast = row
    if carried[3] == "READING":
        if level == 0:
            state.near = (peers, dev, slope, fast)
            return []
        peers, dev, slope, fast = state.near if state.near and state.near[0] else (peers, dev, slope, fast)
        state.near = None
    return vehicle_step(state.unit, (*carried, dev, slope, fast))


#: (keys, order, schema) of the three folds.
STAGES = ((["vin"], ["seq", "kind", "name"], SCOPED), (["scope"], ["ts", "vin", "seq"], ANSWERED), (["vin"], ["seq", "kind", "name", "level"], FOLD))


def steps(metrics: dict[str, tuple[str, Metric]], p: Detect) -> list[tuple]:
    """(start, step) of the three folds."""
    return [(lambda r: Trends(metrics, p), trend_step), (lambda r: Scope(), scope_step(p)), (lambda r: Meeting(metrics, p), meeting_step)]


def detect_with_peers(rows: DataFrame, metrics: dict[str, tuple[str, Metric]], p: Detect = Detect()) -> DataFrame:
    """rows(INPUT) -> FOLD, every reading scored against its own normal less what its peers do at that time."""
    out = peers_input(rows)
    for (keys, order, schema), (start, step) in zip(STAGES, steps(metrics, p), strict=True):
        out = ordered_fold(out, keys, order, start, step, schema)
    return out
