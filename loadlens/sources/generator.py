"""Deterministic zones and load events."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadlens.functions.scalar import (
    NOISE, daily_factor, hour_of, noise_seed, pseudo_random, scenario_load, setting, zone_number,
)

GOLDEN_ANGLE = math.degrees(math.pi * (3 - math.sqrt(5)))
MAX_LATITUDE = 85.0
# Every so many zones the base load is that much higher or lower.
BASE_STEPS = ((7, 0.15), (11, -0.1), (13, 0.25))
#: Zones that a live stream has at most: they travel with its ticks.
MOST_LIVE_ZONES = 100_000
#: Ticks that one task generates for a zone.
TICK_BLOCK = 1000


@dataclass(frozen=True)
class Simulation:
    zones: int = 10
    events_per_second: int = 50
    scenario: str = "normal"
    log_every: int = 100

    @classmethod
    def from_environment(cls) -> Simulation:
        import os

        return cls(setting("NUM_ZONES", 10), setting("EVENTS_PER_SECOND", 50), os.environ.get("SCENARIO", "normal"), setting("LOG_EVERY_N", 100))


def generate_zones(spark: SparkSession, count: int) -> DataFrame:
    """(zone_id, latitude, longitude, base_load) of zones spread over a spiral; at least two are needed."""
    if count < 2:
        raise ValueError("at least 2 zones are needed")
    i = F.col("id")
    latitude = F.degrees(F.asin(1 - i / F.lit(count - 1).cast("double") * 2))
    longitude = (i * GOLDEN_ANGLE + 540) % 360 - 180
    base = 0.2 + (i * 137 % 1000 % 300) / F.lit(1000).cast("double")
    for step, more in BASE_STEPS:
        base = base + F.when(i % step == 0, more).otherwise(0.0)
    base = F.greatest(F.lit(0.05), F.least(F.lit(0.95), base))
    return spark.range(count).select(
        F.concat(F.lit("Z-"), (i + 1).cast("string")).alias("zone_id"),
        F.round(F.greatest(F.lit(-MAX_LATITUDE), F.least(F.lit(MAX_LATITUDE), latitude)), 6).alias("latitude"),
        F.round(longitude, 6).alias("longitude"), F.round(base, 3).alias("base_load"),
    )


def _load(base: Column, number: Column, t: Column, scenario: str) -> Column:
    noise = (pseudo_random(noise_seed(number, t)) - 0.5) * NOISE
    load = scenario_load(base, scenario) * (1 + daily_factor(hour_of(t)) + noise)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), load)), 3)


def ticked(zones: DataFrame, ticks: int) -> DataFrame:
    """zones with tick from 0 on, a row for each: blocks of ticks are dealt out, then unrolled, without a join."""
    blocks = F.explode(F.sequence(F.lit(0), F.lit(max(0, ticks - 1)).cast("long"), F.lit(TICK_BLOCK).cast("long")))
    rows = zones.withColumn("block", blocks).repartition("zone_id", "block")
    last = F.least(F.col("block") + TICK_BLOCK, F.lit(ticks).cast("long")) - 1
    rows = rows.filter(F.lit(ticks) > 0).withColumn("tick", F.explode(F.sequence(F.col("block"), F.greatest(last, F.col("block")))))
    return rows.drop("block")


def generate_events(zones: DataFrame, ticks: int, start: int, tick_ms: int, scenario: str = "normal", stride: int = 1_000_000) -> DataFrame:
    """One event for each zone and tick: (seq, zone_id, latitude, longitude, load, t, produced_at).

    A zone's clock moves by its own step but never past the tick; unrolled, it is n steps beyond the least lead of all
    ticks so far. seq is tick * stride + the zone's number, so that must stay below the stride.
    """
    number = zone_number(F.col("zone_id"))
    if zones.filter(number >= stride).limit(1).count():
        raise ValueError("stride must exceed the number of zones")
    rows = ticked(zones, ticks)
    rows = rows.withColumn("produced_at", F.lit(start) + F.col("tick") * tick_ms).withColumn("step", 1 + number % 20)
    lead = F.col("produced_at") - F.col("tick") * F.col("step")
    before = Window.partitionBy("zone_id").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("t", F.min(lead).over(before) + F.col("tick") * F.col("step"))
    load = _load(F.col("base_load"), number, F.col("t"), scenario)
    seq = F.col("tick") * stride + number
    return rows.select(seq.alias("seq"), "zone_id", "latitude", "longitude", load.alias("load"), "t", "produced_at")


def sensor_events(events: DataFrame) -> DataFrame:
    """Generated events in wire form, with random ids."""
    return events.select(
        F.expr("uuid()").alias("eventId"), F.col("zone_id").alias("zoneId"), "latitude", "longitude", "load",
        F.col("t").alias("eventTimestamp"), F.col("produced_at").alias("producedAt"),
    )


def live_events(spark: SparkSession, zones: DataFrame, ticks_per_second: int, scenario: str = "normal") -> DataFrame:
    """A live stream of sensor events in wire form, one for each zone and tick of the built-in rate source.

    Clocks are the ticks' own (a stream has no running minimum); zones must be few, they travel with the ticks."""
    if zones.limit(MOST_LIVE_ZONES + 1).count() > MOST_LIVE_ZONES:
        raise ValueError(f"at most {MOST_LIVE_ZONES} zones can be live at once")
    ticks = spark.readStream.format("rate").option("rowsPerSecond", ticks_per_second).load()
    rows = ticks.select(F.unix_millis("timestamp").alias("t"), F.col("value").alias("tick")).join(F.broadcast(zones))
    number = zone_number(F.col("zone_id"))
    rows = rows.withColumn("load", _load(F.col("base_load"), number, F.col("t"), scenario)).withColumn("produced_at", F.col("t"))
    return sensor_events(rows)


def first_zones(zones: DataFrame, n: int = 5) -> DataFrame:
    """The first zones by number, as a summary."""
    return zones.orderBy(zone_number(F.col("zone_id"))).limit(n)
