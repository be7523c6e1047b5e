"""Radius search on latitude and longitude columns: a bounding box that reaches the scan, then the great-circle distance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.functions.scalar import EARTH_KM, distance_km


def within(rows: DataFrame, latitude: float, longitude: float, radius_km: float) -> DataFrame:
    """rows at most radius_km away (inclusive), with distance_km."""
    for name, value in (("latitude", latitude), ("longitude", longitude), ("radius_km", radius_km)):
        if value is None or isinstance(value, str) or not math.isfinite(value):
            raise ValueError(f"{name} must be a number")
    high = math.degrees(radius_km / EARTH_KM)
    near = F.col("latitude").between(latitude - high - 1e-9, latitude + high + 1e-9)
    widest = min(90.0, abs(latitude) + high)
    if widest < 89.9 and high < 90:
        wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(high)) / math.cos(math.radians(latitude))))) + 1e-9
        if longitude - wide >= -180 and longitude + wide <= 180:
            near = near & F.col("longitude").between(longitude - wide, longitude + wide)
    away = distance_km(F.lit(float(latitude)), F.lit(float(longitude)), F.col("latitude"), F.col("longitude"))
    return rows.filter(near).withColumn("distance_km", away).filter(F.col("distance_km") <= radius_km)


def _cells(band: Column, cell: float) -> Column:
    """How many cells of longitude a band of latitude has: each is as wide as the radius, and more, wherever the other point
    may lie, one band off; one where the poles are too near."""
    edge = F.greatest(F.abs(band * cell - 90), F.abs((band + 1) * cell - 90)) + cell
    wide = F.when(edge < 89.0, F.floor(F.cos(F.radians(edge)) * (360 / (1.05 * cell)))).otherwise(1)
    return F.when(F.sin(F.radians(F.lit(cell))) > 0.5 * F.cos(F.radians(F.least(edge, F.lit(89.0)))), 1).otherwise(F.greatest(F.lit(1), wide)).cast("long")


def pairs_within(left: DataFrame, zones: DataFrame, radius_km: float) -> DataFrame:
    """left(latitude, longitude) with all zones in the radius: both sides meet on cells of latitude and longitude, a zone
    standing in its own cell and in those beside it."""
    cell = max(math.degrees(radius_km / EARTH_KM), 0.01)
    band = F.floor((F.col("latitude") + 90) / cell)
    place = lambda longitude, n: F.pmod(F.floor((longitude + 180) / 360 * n), n)
    rows = left.withColumn("__band", band)
    rows = rows.withColumn("__cell", place(F.col("longitude"), _cells(F.col("__band"), cell)))
    there = zones.select(F.col("zone_id").alias("near_zone"), F.col("latitude").alias("__lat"), F.col("longitude").alias("__lon"))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    there = there.withColumn("__band", F.explode(F.transform(near, lambda d: d + F.floor((F.col("__lat") + 90) / cell))))
    there = there.withColumn("__n", _cells(F.col("__band"), cell))
    beside = F.array_distinct(F.transform(near, lambda d: F.pmod(place(F.col("__lon"), F.col("__n")) + d, F.col("__n"))))
    there = there.withColumn("__cell", F.explode(beside)).drop("__n")
    away = distance_km(F.col("latitude"), F.col("longitude"), F.col("__lat"), F.col("__lon"))
    return rows.join(there, ["__band", "__cell"]).withColumn("distance_km", away).filter(F.col("distance_km") <= radius_km).drop("__band", "__cell", "__lat", "__lon")
