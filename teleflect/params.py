"""Parameters of the fleet analyses, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Baselines:
    window_h: int = 12
    min_readings: int = 4
    min_windows: int = 3
    min_peers: int = 10


@dataclass(frozen=True)
class Metric:
    """Fixed values per metric: direction of harm, floors of the spreads, guard limits, hard limit, global threshold."""

    direction: int = 1
    min_mad: float = 0.5
    min_slope_mad: float = 0.05
    max_rate_per_min: float = 5.0
    spike_max: float = 25.0
    hard_limit: float | None = 110.0
    min_rate: float = 0.5
    global_threshold: float | None = 97.0


# Fixed values.
METRICS = {
    "coolant_c": Metric(),
    "batt_temp_c": Metric(1, 1.0, 0.15, 2.0, 20.0, 60.0, 0.5, 47.0),
    "lv_batt_v": Metric(-1, 0.05, 0.005, 1.0, 3.0, None, 0.1, None),
}
# Inclusive physical ranges.
RANGES = {
    "lat": (-90, 90), "lon": (-180, 180), "speed_kmh": (0, 200), "odo_km": (0, 2_000_000), "ambient_c": (-50, 60), "coolant_c": (-40, 150),
    "rpm": (0, 8000), "batt_temp_c": (-40, 90), "soc_pct": (0, 100), "fuel_pct": (0, 100), "lv_batt_v": (6, 18), "idle_s": (0, 86_400),
}


@dataclass(frozen=True)
class Detect:
    tau_h: float = 12.0
    fast_tau_h: float = 3.0
    min_weight: float = 3.0
    z_level: float = 3.0
    z_slope: float = 3.0
    z_level_with_slope: float = 1.5
    k: int = 4
    n: int = 6
    close_after: int = 12
    warmup_min: float = 25.0
    peer_window_h: float = 2.0
    min_peers: int = 10
    runaway_h: float = 12.0
    runaway_run: int = 3
    reject_reset_h: float = 1.0
    code_factor: float = 4.0
    code_min: int = 3
    bucket_h: int = 24


@dataclass(frozen=True)
class Campaign:
    bucket_h: int = 24
    min_vans: int = 5
    alpha: float = 1e-4
    floor_per_1000: float = 2.0
    regional_h: int = 72
    risk_z: float = 1.5
    risk_k: int = 3
    risk_n: int = 4
    risk_slope: float = 2.0
    reraise_pct: float = 50.0
    reraise_abs: int = 3
    firmware_days: int = 3
    firmware_share: float = 0.6
    firmware_gap_pts: float = 20.0


@dataclass(frozen=True)
class Queue:
    weights: tuple[float, ...] = (0.35, 0.25, 0.2, 0.1, 0.1, 0.15)
    warn: float = 0.4
    high: float = 0.7
    critical: float = 1.0
    at_risk: float = 0.2
    full_z: float = 4.0
    horizon_h: float = 72.0
    full_at: int = 20
    at_risk_factor: float = 0.5
    behaviour_full: float = 3.0
    min_score: float = 0.4
    slots_per_bay: int = 1


@dataclass(frozen=True)
class Fix:
    band: float = 2.0
    inside_k: int = 6
    inside_n: int = 8
    min_driven_h: int = 12
    not_fixed_after_h: int = 24
    window_h: int = 48
