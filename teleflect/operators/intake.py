"""Messages as they come in, in one state for each unit: which sequence numbers were seen, and the last values that were believed.

The two belong together: a counter that starts anew begins a new history, so values before it no longer judge those
after it; a repeated message is neither judged nor carried; a late one is judged against nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import ordered_fold

#: Bits of the replay window: how far back a sequence number is remembered.
WINDOW = 1024
# Kilometres and percentage points that rounding may take back or add; names of the flags.
ODO_BACK, SOC_UP = 0.01, 0.5
BY_OUTCOME = {"LATE_NEW": "OUT_OF_ORDER", "TOO_OLD": "LATE", "SEQ_RESET": "SEQ_RESET"}
#: flag -> (the value that goes if it holds, whether it holds for a reading after the last believed values).
RULES: dict[str, tuple[str, Callable[[dict, dict], bool]]] = {
    "ODOMETER_BACKWARDS": ("odo_km", lambda was, now: was["odo_km"] - now["odo_km"] > ODO_BACK),
    "SOC_RISING_WHILE_DRIVING": ("soc_pct", lambda was, now: was["driving"] and now["driving"] and not now["engine"] and now["soc_pct"] - was["soc_pct"] > SOC_UP),
}
READINGS = ("vin", "arrival", "seq", "ts", "odo_km", "soc_pct", "driving", "engine", "ahead")
ACCEPTED = "vin long, seq long, ts timestamp, outcome string, odo_km double, soc_pct double, flags string"


def judge(state: tuple[int, int, int] | None, seq: int, us: int) -> tuple[str, tuple[int, int, int]]:
    """Outcome of one message and the next state (largest seq, largest time, bits: bit d is seq largest - d)."""
    if state is None:
        return "NEW", (seq, us, 1)
    most, when, bits = state
    if seq > most:
        step = seq - most
        return "NEW", (seq, max(when, us), ((bits << step) | 1) & ((1 << WINDOW) - 1) if step < WINDOW else 1)
    back = most - seq
    if back < WINDOW:
        if bits >> back & 1:
            return "DUPLICATE", state
        return "LATE_NEW", (most, max(when, us), bits | 1 << back)
    return ("SEQ_RESET", (seq, us, 1)) if us > when else ("TOO_OLD", state)


class Intake:
    """What is known of one unit: the replay window, and the last believed value of each checked field with the seq they stand at."""

    __slots__ = ("seq", "values", "window")

    def __init__(self) -> None:
        self.window, self.seq, self.values = None, None, {}

    def take(self, seq: int, us: int, now: dict) -> tuple[str, dict, list[str]]:
        """Outcome, the values that stand, and the flags of one message."""
        outcome, self.window = judge(self.window, seq, us)
        flags = [BY_OUTCOME[outcome]] if outcome in BY_OUTCOME else []
        if outcome == "SEQ_RESET":
            self.seq, self.values = None, {}
        if outcome == "DUPLICATE" or (self.seq is not None and seq <= self.seq):
            return outcome, now, flags
        was = {"driving": False, **self.values}
        broken = [f for f, (field, holds) in RULES.items() if now[field] is not None and was.get(field) is not None and holds(was, now)]
        kept = now | {RULES[f][0]: None for f in broken}
        self.seq, self.values = seq, self.values | {k: v for k, v in kept.items() if v is not None}
        return outcome, kept, broken + flags


def intake_step(state: Intake, row: tuple) -> list[tuple]:
    """A row of READINGS; nothing for a repeated message."""
    vin, _, seq, us, odo, soc, driving, engine, ahead = row
    number = lambda x: None if x is None or x != x else x
    outcome, kept, flags = state.take(seq, us, {"odo_km": number(odo), "soc_pct": number(soc), "driving": bool(driving), "engine": bool(engine)})
    if outcome == "DUPLICATE":
        return []
    return [(vin, seq, us, outcome, kept["odo_km"], kept["soc_pct"], ",".join(flags + ["CLOCK_SKEW"] * bool(ahead)))]


def intake_input(messages: DataFrame) -> DataFrame:
    """messages(vin, arrival, seq, ts, odo_km, soc_pct, driving, engine) and `ahead` (whether its clock runs ahead; none where it is missing) as READINGS."""
    ahead = F.col("ahead") if "ahead" in messages.columns else F.lit(False)
    return messages.select("vin", "arrival", "seq", F.col("ts").cast("timestamp").alias("ts"), F.col("odo_km").cast("double").alias("odo_km"), F.col("soc_pct").cast("double").alias("soc_pct"), "driving", "engine", ahead.alias("ahead"))


def intake(messages: DataFrame) -> DataFrame:
    """ACCEPTED: every message but repeated ones, in order of arrival, with flags; a value that cannot be is null and not carried."""
    return ordered_fold(intake_input(messages), ["vin"], ["arrival"], lambda r: Intake(), intake_step, ACCEPTED)


class Clock:
    """Offset between event time and ingest time of one source: the middle one of the last `size`, taken anew after every `every` messages."""

    __slots__ = ("every", "middle", "n", "offsets", "size")

    def __init__(self, size: int = 512, every: int = 64):
        self.size, self.every, self.n, self.middle, self.offsets = size, every, 0, None, []

    def ahead(self, offset: float, most: float) -> bool | None:
        """Whether an offset is over `most` beyond the middle; None while there is none. Then the offset counts."""
        out = None if self.middle is None else offset - self.middle > most
        if len(self.offsets) < self.size:
            self.offsets.append(offset)
        else:
            self.offsets[self.n % self.size] = offset
        self.n += 1
        if self.n % self.every == 0:
            self.middle = sorted(self.offsets)[len(self.offsets) // 2]
        return out


def clock_step(most_ms: int = 120_000, speed: float = 1.0) -> Callable[[Clock, tuple], list[tuple]]:
    """A step for rows (source, arrival, event_ms, ingest_ms): (source, arrival, ahead)."""
    return lambda clock, row: [(row[0], row[1], clock.ahead(row[2] - speed * row[3], most_ms))]
