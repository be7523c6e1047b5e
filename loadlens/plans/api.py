"""The queries a service would answer, as functions of tables; limits below 1 and missing numbers are errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.operators.geo import within
from loadlens.operators.views import GLOBAL_LIST, newest, newest_per_zone

DAY = 86_400_000


def _limit(limit: int) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
        raise ValueError("limit must be a whole number of at least 1")
    return limit


def zones(latest: DataFrame, state: str | None = None) -> DataFrame:
    """Latest states by zone id; an empty state means all."""
    rows = latest.filter(F.col("zone_id").startswith("Z-"))
    return (rows.filter(F.col("state") == state) if state else rows).orderBy("zone_id")


def zone(latest: DataFrame, zone_id: str) -> DataFrame:
    return latest.filter(F.col("zone_id") == zone_id)


def zones_near(latest: DataFrame, latitude: float, longitude: float, radius_km: float) -> DataFrame:
    return within(latest, latitude, longitude, radius_km)


def zone_alerts(alerts: DataFrame, zone_id: str, limit: int = 100) -> DataFrame:
    rows = newest_per_zone(alerts.filter(F.col("zone_id") == zone_id))
    return rows.filter(F.col("rank") <= _limit(limit)).drop("zone_id")


def recent_alerts(alerts: DataFrame, limit: int = 20) -> DataFrame:
    return newest(alerts, min(GLOBAL_LIST, _limit(limit)))


def alerts_by_state(alerts: DataFrame, state: str | None = None, limit: int = 100) -> DataFrame:
    """The newest alerts into a state among the global list: the list's cap comes before the filter."""
    rows = newest(alerts)
    rows = rows.filter(F.col("current_state") == state) if state else rows
    return rows.orderBy(F.col("seq").desc()).limit(_limit(limit))


def history(table: DataFrame, zone_id: str, start: int = 0, end: int | None = None) -> DataFrame:
    """A zone's history from start to end, both inclusive, oldest first."""
    rows = table.filter((F.col("zone_id") == zone_id) & (F.col("timestamp") >= start))
    rows = rows if end is None else rows.filter(F.col("timestamp") <= end)
    return rows.orderBy("timestamp", "id").drop("zone_id")


def history_recent(table: DataFrame, limit: int = 50) -> DataFrame:
    return table.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(_limit(limit))


def top_critical(table: DataFrame, as_of: int, days: int = 7) -> DataFrame:
    """How often each zone became critical in the days before as_of, most often first."""
    rows = table.filter((F.col("current_state") == "CRITICAL") & (F.col("timestamp") >= as_of - days * DAY))
    return rows.groupBy("zone_id").agg(F.count("*").alias("critical_count")).orderBy(F.col("critical_count").desc(), "zone_id")
