"""Column expressions: robust statistics, identifiers, grid cells, tails. All run inside Catalyst."""

from __future__ import annotations

import math

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Makes a median absolute deviation comparable with a standard deviation.
MAD_SCALE = 1.4826


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often it is used and wherever the optimizer moves the result."""
    return F.get(F.transform(F.array(value), use), 0)


def hours(ts: Column) -> Column:
    """Event time in hours since the epoch; ts may be zoned or not (the session runs in UTC)."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(3.6e9)


def bucket(ts: Column, size_h: int) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(size_h * 3_600_000_000)).cast("long")


def robust_z(value: Column, centre: Column, mad: Column, floor: float) -> Column:
    return (value - centre) / (F.lit(MAD_SCALE) * F.greatest(mad, F.lit(floor)))


def band(median: Column, mad: Column, floor: float, width: float = 3.0) -> tuple[Column, Column]:
    half = F.lit(width * MAD_SCALE) * F.greatest(mad, F.lit(floor))
    return median - half, median + half


def hours_to_limit(level: Column, rate: Column, limit: float, min_rate: float, direction: int = 1) -> Column:
    """Hours until the level meets the limit; null unless the rate goes the harmful way fast enough."""
    toward = rate * direction
    return F.when(toward >= min_rate, F.greatest(F.lit(0.0), (F.lit(float(limit)) - level) * direction / toward))


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based id (version 5), as text."""
    h = F.sha1(F.concat(F.unhex(F.lit(uuid.UUID(namespace).hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


# Letters and their numbers, weights of the 17 places.
VIN_LETTERS, VIN_DIGITS = "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789"
VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)


def vin_check_digit(vin: Column) -> Column:
    numbers = F.split(F.translate(vin, VIN_LETTERS, VIN_DIGITS), "")
    parts = F.zip_with(numbers, F.array(*map(F.lit, VIN_WEIGHTS)), lambda d, w: F.coalesce(d.try_cast("int"), F.lit(0)) * w)
    return let(F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 11, lambda r: F.when(r == 10, "X").otherwise(r.cast("string")))


def vin_problem(vin: Column) -> Column:
    """Null for a valid identifier, else LENGTH, CHARACTERS or CHECK_DIGIT."""
    return let(
        vin,
        lambda v: F.when(v.isNull() | (F.length(v) != 17), "LENGTH")
        .when(~v.rlike("^[A-HJ-NPR-Z0-9]{17}$"), "CHARACTERS")
        .when(vin_check_digit(v) != F.substring(v, 9, 1), "CHECK_DIGIT"),
    )


# The digits of a geohash.
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash5(lat: Column, lon: Column) -> Column:
    """Cell of 5 characters: 13 bits of longitude and 12 of latitude, interleaved, longitude first."""
    x = F.least(F.greatest(F.floor((lon + 180) / 360 * (1 << 13)), F.lit(0)), F.lit((1 << 13) - 1)).cast("int")
    y = F.least(F.greatest(F.floor((lat + 90) / 180 * (1 << 12)), F.lit(0)), F.lit((1 << 12) - 1)).cast("int")
    bits = []
    for i in range(25):
        source, place = (x, 12 - i // 2) if i % 2 == 0 else (y, 11 - i // 2)
        bits.append(F.shiftright(source, place).bitwiseAND(1))
    chars = []
    for c in range(5):
        code = sum((bits[5 * c + j] * (16 >> j) for j in range(5)), F.lit(0))
        chars.append(F.substring(F.lit(GEOHASH), code + 1, F.lit(1)))
    return F.concat(*chars)


def poisson_tail(n: Column, rate: Column) -> Column:
    """P(X >= n), X Poisson with mean `rate`: terms upward from n where the mean is at most n, else 1 less the terms below n.

    Either sum falls from its first term on, at i terms by exp(-i*i/(2n + 2i)) at least, and goes on until terms vanish.
    """
    n, rate = n.cast("long"), rate.cast("double")
    above = rate > n
    k = F.when(above, n - 1).otherwise(n)  # the first term's
    x = F.greatest(k, F.lit(20)).cast("double")  # Stirling's series from 20 on, exact below
    log_factorial = F.when(k > 20, x * F.log(x) - x + F.log(x * (2 * math.pi)) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)).otherwise(F.log(F.factorial(F.greatest(F.least(k, F.lit(20)), F.lit(0)).cast("int")).cast("double")))
    first = F.exp(k * F.log(rate) - rate - log_factorial)
    terms = F.ceil(60 + F.sqrt(3600 + 120 * F.greatest(n, F.lit(1))))
    grown = F.aggregate(
        F.sequence(F.lit(1).cast("long"), terms),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, i: F.transform(F.array(a["t"] * F.when(above, F.greatest(k - i + 1, F.lit(0)) / rate).otherwise(rate / (n + i))), lambda t: F.struct(t.alias("t"), (a["s"] + t).alias("s")))[0],
    )["s"]
    tail = F.when(above, 1 - first * grown).otherwise(first * grown)
    return F.when(n <= 0, 1.0).when(rate <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def fahrenheit(f: Column) -> Column:
    return F.round((f - 32) * 5 / 9, 2)
