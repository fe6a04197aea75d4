"""Raw machine messages: three JSON shapes to one canonical reading, with typed errors, validation flags and a dead-letter table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import fahrenheit, let, uuid5, vin_problem
from ..params import RANGES

# The keys that tell a shape.
MARKERS = {
    "nested_f": ("vehicle", "t", "n", "evt", "pos", "spd", "odo"),
    "nested_c": ("vehicle", "time", "seqNo", "event", "position", "speedKmh", "odometerKm"),
    "flat": ("id", "ts", "sq", "e", "g", "s", "o"),
}
# Event codes of the flat shape.
FLAT_EVENTS = {"IG1": "IGNITION_ON", "IG0": "IGNITION_OFF", "TS": "TRIP_START", "TE": "TRIP_END", "P": "PERIODIC", "HB": "HEARTBEAT", "XB": "HARSH_BRAKE", "XA": "HARSH_ACCEL", "D": "DTC"}
# The code pattern, and families by code.
CODE = "^[PCBU][0-3][0-9A-F]{3}$"
EVENT_NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def _best_shape(keys: Column, least: float = 0.6) -> Column:
    shares = [F.struct((F.size(F.array_intersect(keys, F.array(*map(F.lit, m)))) / len(m)).alias("share"), F.lit(-i).alias("first"), F.lit(name).alias("name")) for i, (name, m) in enumerate(MARKERS.items())]
    return let(F.when(keys.isNotNull(), F.array_max(F.array(*shares))), lambda b: F.when(b["share"] >= least, b["name"]))


def shape_of(body: Column, least: float = 0.6) -> Column:
    """The shape whose marker keys are there in the largest share (ties: the first), null under `least` or if it is no object."""
    return let(F.json_object_keys(body), lambda keys: _best_shape(keys, least))


@dataclass(frozen=True)
class Kind:
    """A type of field: what it is called in errors, the Spark type it is read as, what a present value must satisfy (its variant type and itself), and what becomes of it."""

    called: str
    read: str
    holds: Callable[[Column, Column], Column]
    turned: Callable[[Column], Column] = lambda x: x


_NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"
_CODES = lambda x: F.filter(x, lambda c: c != "")
_flag = lambda t, x: t.rlike(_NUMBER) & x.isin(0.0, 1.0)
NUMBER = Kind("a number", "double", lambda t, x: t.rlike(_NUMBER))
FAHRENHEIT = replace(NUMBER, turned=fahrenheit)
SHARE = replace(NUMBER, turned=lambda x: F.round(x * 100, 2))
TALLY = Kind("a whole number", "double", lambda t, x: t.rlike(_NUMBER) & (x == F.floor(x)), lambda x: F.when(x >= 0, x.cast("long")))
SEQUENCE = Kind("a whole number of 0 or more", "double", lambda t, x: t.rlike(_NUMBER) & (x == F.floor(x)) & (x >= 0), lambda x: x.cast("long"))
TEXT = Kind("a text", "string", lambda t, x: t == "STRING")
TRUTH = Kind("true or false", "boolean", lambda t, x: t == "BOOLEAN")
BIT = Kind("0 or 1", "double", _flag, lambda x: x == 1)
INSTANT = Kind("an ISO 8601 time", "string", lambda t, x: (t == "STRING") & F.try_to_timestamp(x).isNotNull(), F.try_to_timestamp)
MILLIS = Kind("a time in milliseconds", "double", lambda t, x: t.rlike(_NUMBER), lambda x: F.timestamp_millis(x.cast("long")))
EVENT = Kind("a known event", "string", lambda t, x: (t == "STRING") & x.isin(*FLAT_EVENTS.values()))
SHORT_EVENT = Kind("a known event", "string", lambda t, x: (t == "STRING") & x.isin(*FLAT_EVENTS), lambda x: F.element_at(F.create_map(*[F.lit(v) for pair in FLAT_EVENTS.items() for v in pair]), x))
LIST = Kind("a list of texts", "array<string>", lambda t, x: t.isin("ARRAY<STRING>", "ARRAY<VOID>"), _CODES)
PIPED = Kind("a text", "string", lambda t, x: t == "STRING", lambda x: _CODES(F.split(x, r"\|")))

# Where each shape keeps a field (canonical name: path, kind), in the order in which errors are looked for.
FIELDS: dict[str, dict[str, tuple[str, Kind]]] = {
    "nested_f": {
        "vin": ("vehicle.vin", TEXT), "event_ts": ("t", INSTANT), "seq": ("n", SEQUENCE), "evt": ("evt", EVENT), "lat": ("pos.la", NUMBER), "lon": ("pos.lo", NUMBER), "speed_kmh": ("spd", NUMBER), "odo_km": ("odo", NUMBER),
        "coolant_c": ("eng.coolantTempF", FAHRENHEIT), "rpm": ("eng.rpm", NUMBER), "batt_temp_c": ("batt.tempF", FAHRENHEIT), "soc_pct": ("batt.soc", NUMBER), "fuel_pct": ("fuel.pct", NUMBER), "lv_batt_v": ("elec.v12", NUMBER), "ambient_c": ("amb", NUMBER),
        "dtc": ("codes", LIST), "idle_s": ("idle", NUMBER), "firmware": ("sw", TEXT), "ignition": ("ign", TRUTH), "charging": ("chg", TRUTH),
    },
    "nested_c": {
        "vin": ("vehicle.vin", TEXT), "event_ts": ("time", INSTANT), "seq": ("seqNo", SEQUENCE), "evt": ("event", EVENT), "lat": ("position.lat", NUMBER), "lon": ("position.lon", NUMBER), "speed_kmh": ("speedKmh", NUMBER), "odo_km": ("odometerKm", NUMBER),
        "coolant_c": ("engine.coolant.tempC", NUMBER), "rpm": ("engine.rpm", NUMBER), "batt_temp_c": ("battery.tempC", NUMBER), "soc_pct": ("battery.socPct", NUMBER), "fuel_pct": ("fuel.pct", NUMBER), "lv_batt_v": ("electrical.v12", NUMBER), "ambient_c": ("ambientC", NUMBER),
        "dtc": ("codes", LIST), "idle_s": ("idleS", NUMBER), "firmware": ("software", TEXT), "ignition": ("ignition", TRUTH), "charging": ("charging", TRUTH),
    },
    "flat": {
        "vin": ("id", TEXT), "event_ts": ("ts", MILLIS), "seq": ("sq", SEQUENCE), "evt": ("e", SHORT_EVENT), "lat": ("g[0]", NUMBER), "lon": ("g[1]", NUMBER), "speed_kmh": ("s", NUMBER), "odo_km": ("o", NUMBER),
        "coolant_c": ("ct", NUMBER), "batt_temp_c": ("bt", NUMBER), "soc_pct": ("soc", SHARE), "fuel_pct": ("fl", NUMBER), "lv_batt_v": ("v", NUMBER), "ambient_c": ("a", NUMBER),
        "dtc": ("dtc", PIPED), "firmware": ("fw", TEXT), "ignition": ("ig", BIT), "charging": ("ch", BIT), "harsh_brake": ("hb", TALLY), "harsh_accel": ("ha", TALLY), "idle_s": ("idl", NUMBER),
    },
}
NEEDED = ("vin", "event_ts", "seq", "evt", "ignition", "charging")
#: Fields of a canonical reading, in order; numbers but for these.
CANONICAL = ("vin", "seq", "event_ts", "evt", "lat", "lon", "speed_kmh", "odo_km", "ambient_c", "coolant_c", "rpm", "batt_temp_c", "soc_pct", "fuel_pct", "lv_batt_v", "ignition", "charging", "harsh_brake", "harsh_accel", "idle_s", "dtc", "firmware")
TYPES = {"vin": "string", "seq": "long", "event_ts": "timestamp", "evt": "string", "ignition": "boolean", "charging": "boolean", "harsh_brake": "long", "harsh_accel": "long", "dtc": "array<string>", "firmware": "string"}


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once a row: the optimizer merges no projection across a generator, so what uses them reads them."""
    names = list(columns)
    one = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.explode(one).alias("__held")).select(*df.columns, *[F.col("__held")[n].alias(n) for n in names])


def _wrong(v: Column, shape: str) -> Column:
    """The first field of a shape that is not what it should be, as its path and what it is not; null if there is none."""
    faults = []
    for name, (path, kind) in FIELDS[shape].items():
        at = F.try_variant_get(v, f"$.{path}", "variant")
        of, value = F.schema_of_variant(at), F.try_variant_get(v, f"$.{path}", kind.read)
        absent = at.isNull() | (of == "VOID")
        there = F.coalesce(kind.holds(of, value), F.lit(False))
        ok = (~absent & there) if name in NEEDED else (absent | there)
        faults.append(F.when(~ok, F.lit(f"{path} is not {kind.called}")))
    return F.coalesce(*faults)


def _reading(v: Column, shape: str) -> Column:
    """The canonical reading in a message of a shape; what the shape has no place for is null, missing codes are none."""

    def field(name: str) -> Column:
        path, kind = FIELDS[shape].get(name, (None, None))
        value = F.lit(None) if path is None else kind.turned(F.try_variant_get(v, f"$.{path}", kind.read))
        value = value.cast(TYPES.get(name, "double"))
        return F.coalesce(value, F.array().cast("array<string>")) if name == "dtc" else value

    return F.struct(*[field(n).alias(n) for n in CANONICAL])


def decode(raw: DataFrame, body: str = "value") -> DataFrame:
    """raw with `shape`, `error` (MALFORMED_JSON, UNKNOWN_SHAPE, SCHEMA_INVALID or null), `detail` (what is wrong where) and the canonical reading `r`.

    A message is parsed once, into a variant that a table of paths and kinds is walked over; reading a path costs no
    second parse. The walk is inside `let`, which keeps its many branches out of generated code: as one generated
    method they are too long for the JVM to compile.
    """
    text = F.col(body).cast("string")
    rows = _held(raw, __keys=F.json_object_keys(text), __v=F.try_parse_json(text))
    rows = _held(rows, shape=_best_shape(F.col("__keys")))
    v, shape = F.col("__v"), F.col("shape")
    whole = F.col("__keys").isNotNull() & v.isNotNull()
    by_shape = lambda use: F.coalesce(*[F.when(shape == s, use(s)) for s in FIELDS])
    rows = _held(rows, __wrong=F.when(whole, by_shape(lambda s: let(v, lambda w: _wrong(w, s)))))
    error = F.when(~whole, "MALFORMED_JSON").when(shape.isNull(), "UNKNOWN_SHAPE").when(F.col("__wrong").isNotNull(), "SCHEMA_INVALID")
    keys = F.concat(F.lit("keys "), F.array_join(F.slice("__keys", 1, 12), " "))
    detail = F.when(~whole, "no JSON object").when(shape.isNull(), keys).otherwise(F.col("__wrong"))
    reading = by_shape(lambda s: let(v, lambda w: _reading(w, s)))
    out = rows.withColumns({"error": error, "detail": detail}).withColumn("r", F.when(F.col("error").isNull(), reading))
    return out.drop("__keys", "__v", "__wrong")


def validate(readings: DataFrame, ranges: dict[str, tuple[float, float]] | None = None, families: dict[str, str] | None = None) -> DataFrame:
    """Readings outside a physical range become null with a flag; bad codes go with one flag each; families follow the codes."""
    ranges = {k: v for k, v in (ranges or RANGES).items() if k in readings.columns}
    flags = [F.when(~F.col(c).between(*v), F.lit(f"OUT_OF_RANGE:{c}")) for c, v in ranges.items()]
    values = {c: F.when(F.col(c).between(*v), F.col(c)) for c, v in ranges.items()}
    extra = {}
    if "dtc" in readings.columns:
        bad = F.size(F.filter("dtc", lambda x: ~x.rlike(CODE)))
        flags.append(None)
        good = F.filter("dtc", lambda x: x.rlike(CODE))
        known = F.create_map(*[F.lit(x) for pair in (families or {"": ""}).items() for x in pair])
        extra = {"dtc": good, "fault_families": F.transform(good, lambda x: F.coalesce(F.element_at(known, x), F.lit("OTHER")))}
    quality = F.array_compact(F.array(*[x for x in flags if x is not None]))
    if extra:
        quality = F.concat(quality, F.array_repeat(F.lit("INVALID_DTC"), bad))
    return readings.withColumn("quality_flags", quality).withColumns(values | extra)


def judged(raw: DataFrame) -> DataFrame:
    """decode(raw) with `problem`: its error, or INVALID_VIN where the identifier is bad."""
    d = _held(decode(raw), __vin=vin_problem(F.col("r.vin")))
    return d.withColumn("problem", F.coalesce("error", F.when(F.col("__vin").isNotNull(), "INVALID_VIN")))


def error_detail() -> Column:
    """Of a row of judged: what is wrong, in which shape, where."""
    return F.substring(F.concat_ws(" ", "problem", F.coalesce("shape", F.lit("no shape")), F.coalesce("detail", F.concat(F.lit("identifier "), "__vin"))), 1, 500)


def split(raw: DataFrame, offsets: tuple[str, ...] = ("topic", "partition", "offset"), families: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(canonical, dead): a message that does not decode or has a bad identifier goes to the dead letters with its payload."""
    return split_judged(judged(raw), offsets, families)


def split_judged(d: DataFrame, offsets: tuple[str, ...] = ("topic", "partition", "offset"), families: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """split of rows of judged; where both parts, or one twice, are read, store them first: a message is then decoded once."""
    dead = d.filter("problem is not null").select(*offsets, F.col("problem").alias("error_code"), error_detail().alias("error_detail"), F.base64(F.col("value").cast("binary")).alias("raw_payload_b64"))
    good = d.filter("problem is null").select(*offsets, "r.*").withColumn("event_id", uuid5(EVENT_NAMESPACE, F.concat_ws(":", "vin", F.col("seq").cast("string"))))
    return validate(good, families=families), dead
