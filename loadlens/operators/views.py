"""Latest state, first coordinates, alert lists and history, all as views over transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadlens.functions.scalar import setting

ZONE_LIST, GLOBAL_LIST = setting("ALERT_HISTORY_LIMIT", 100), setting("ALERT_GLOBAL_LIMIT", 1000)


def first_seen(events: DataFrame) -> DataFrame:
    """(zone_id, latitude, longitude) of each zone's first event."""
    at = F.min_by(F.struct("latitude", "longitude"), F.col("seq")).alias("at")
    return events.groupBy("zone_id").agg(at).select("zone_id", "at.latitude", "at.longitude")


def latest_state(changes: DataFrame, coordinates: DataFrame | None = None) -> DataFrame:
    """One row per zone that ever changed, as of its last change; suppressed alerts count as changes. Coordinates come from
    the changes themselves or from a table of zones."""
    at = [c for c in ("latitude", "longitude") if c in changes.columns]
    last = F.max_by(F.struct(F.col("current_state").alias("state"), "avg1m", "avg5m", F.col("t").alias("last_updated"), "seq", *at), F.col("seq"))
    rows = changes.groupBy("zone_id").agg(last.alias("s")).select("zone_id", "s.*")
    return rows if coordinates is None else rows.join(coordinates, "zone_id", "left")


def newest_per_zone(alerts: DataFrame, n: int = ZONE_LIST) -> DataFrame:
    """Each zone's newest n alerts by arrival, with their rank."""
    newest = Window.partitionBy("zone_id").orderBy(F.col("seq").desc())
    return alerts.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= n)


def newest(alerts: DataFrame, n: int = GLOBAL_LIST) -> DataFrame:
    return alerts.orderBy(F.col("seq").desc()).limit(n)


def history(alerts: DataFrame) -> DataFrame:
    """Rows of the history table; the arrival number is the id."""
    return alerts.select(F.col("seq").alias("id"), "zone_id", "previous_state", "current_state", "avg1m", "avg5m", F.col("t").alias("timestamp"))
