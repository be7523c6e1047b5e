"""Column functions: 32-bit hashing, load patterns, rounding, distance, route names; and settings from the environment."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results must agree with these.
HASH_FACTOR = 0x45D9F3B
UNSIGNED_MAX = 0xFFFFFFFF
SEED_STEP, SEED_SPACE = 137, 10_000
NOISE = 0.1
EARTH_KM = 6372.797560856
# Fixed values: (from hour, to hour, change of the load) through the day.
DAY = ((9, 17, 0.15), (18, 22, 0.05), (6, 8, -0.1))
NIGHT = -0.2


def int32(x: Column) -> Column:
    """A whole number's low 32 bits, signed."""
    low = x.cast("bigint").bitwiseAND(F.lit(UNSIGNED_MAX))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low)


def folded(x: Column) -> Column:
    """The 32-bit number xor its own high half (the sign is kept)."""
    low = int32(x)
    return F.shiftright(low, 16).bitwiseXOR(low)


def pseudo_random(seed: Column) -> Column:
    """Two multiplicative rounds in doubles, then a fold; the value lies in [0, 0.5)."""
    first = folded(seed).cast("double") * float(HASH_FACTOR)
    second = folded(first).cast("double") * float(HASH_FACTOR)
    last = folded(second)
    return F.when(last < 0, last + (1 << 32)).otherwise(last).cast("double") / float(UNSIGNED_MAX)


def zone_number(zone_id: Column) -> Column:
    return F.substring(zone_id, 3, 18).cast("bigint")


def noise_seed(number: Column, t: Column) -> Column:
    return (number * SEED_STEP + F.floor(t / 1000)) % SEED_SPACE


def hour_of(t: Column) -> Column:
    """Hour in the session's time zone."""
    return F.hour(F.timestamp_millis(t))


def daily_factor(hour: Column) -> Column:
    out = F.lit(NIGHT)
    for first, last, factor in DAY:
        out = F.when(hour.between(first, last), factor).otherwise(out)
    return out


def scenario_load(base: Column, scenario: str) -> Column:
    if scenario == "spike":
        return F.least(F.lit(1.0), base + 0.5)
    if scenario == "drop":
        return F.greatest(F.lit(0.0), base - 0.4)
    return base


def milli(x: Column) -> Column:
    """Thousandths as a whole number, half up."""
    return F.floor(x * 1000 + 0.5)


def second_of(t: Column) -> Column:
    return F.floor(t / F.lit(1000)) if isinstance(t, Column) else t // 1000


def distance_km(lat_a, lon_a, lat_b, lon_b) -> Column:
    """Great-circle distance (haversine)."""
    a, b = F.radians(lat_a), F.radians(lat_b)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon_b) - F.radians(lon_a)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def route_name(path: Column) -> Column:
    return (
        F.when(path.startswith("/zones/"), "/zones/:zoneId")
        .when(path.startswith("/alerts/"), "/alerts/:zoneId")
        .when(path.startswith("/analytics/zones/") & path.contains("/alerts"), "/analytics/zones/:zoneId/alerts")
        .otherwise(path)
    )


def setting(name: str, default: int) -> int:
    """A whole number from the environment; the default where it is unset or no number."""
    try:
        return int(os.environ.get(name, ""))
    except ValueError:
        return default
