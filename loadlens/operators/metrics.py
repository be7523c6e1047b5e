"""Counters, fixed-bucket histograms, throughput and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Upper bounds of the latency histograms in milliseconds.
BOUNDS = (1, 5, 10, 25, 50, 100, 250, 500, 1000)


def counter(rows: DataFrame, *labels: str) -> DataFrame:
    return rows.groupBy(*labels).agg(F.count("*").alias("value"))


def histogram(rows: DataFrame, value: Column, *labels: str) -> DataFrame:
    """Cumulative counts le_<bound>, total and count of a value, per labels."""
    within = [F.sum(F.when(value <= b, 1).otherwise(0)).cast("bigint").alias(f"le_{b}") for b in BOUNDS]
    return rows.groupBy(*labels).agg(*within, F.sum(value).cast("bigint").alias("total"), F.count(value).alias("count"))


def gaps(events: DataFrame, block: int = 4096) -> DataFrame:
    """(zone_id, seq, gap) between an event and the zone's one before; rows meet in blocks of seq, blocks by their ends."""
    rows = events.select("zone_id", "seq", "t").withColumn("block", F.floor(F.col("seq") / block))
    inside = Window.partitionBy("zone_id", "block").orderBy("seq")
    last = rows.groupBy("zone_id", "block").agg(F.max_by("t", "seq").alias("end"))
    last = last.select("zone_id", "block", F.lag("end").over(Window.partitionBy("zone_id").orderBy("block")).alias("end"))
    rows = rows.withColumn("before", F.lag("t").over(inside)).join(last, ["zone_id", "block"])
    gap = F.col("t") - F.coalesce("before", "end")
    return rows.select("zone_id", "seq", gap.alias("gap")).filter("gap is not null")


def throughput(events: DataFrame, *labels: str) -> DataFrame:
    """Events per second of event time."""
    rows = events.groupBy(*labels).agg(F.count("*").alias("events"), (F.max("t") - F.min("t")).alias("elapsed_ms"))
    rate = F.when(F.col("elapsed_ms") > 0, F.col("events").cast("double") * 1000 / F.col("elapsed_ms")).otherwise(0.0)
    return rows.withColumn("events_per_second", rate)


def zone_summary(scored: DataFrame, changes: DataFrame) -> DataFrame:
    """Each zone's state, last averages (three places) and how many events it had."""
    last = F.max_by(F.struct("avg1m", "avg5m", "t"), F.col("seq")).alias("s")
    rows = scored.groupBy("zone_id").agg(last, F.count("*").alias("events"))
    state = changes.groupBy("zone_id").agg(F.max_by("current_state", "seq").alias("state"))
    return rows.join(state, "zone_id", "left").select(
        "zone_id", F.coalesce("state", F.lit("NORMAL")).alias("state"), F.round("s.avg1m", 3).alias("avg1m"), F.round("s.avg5m", 3).alias("avg5m"),
        F.col("s.t").alias("t"), "events",
    )


def exposition(counters: DataFrame) -> DataFrame:
    """(line): counters (name, labels, value) as text, one sample a line."""
    labels = F.when(F.col("labels") != "", F.concat(F.lit("{"), F.col("labels"), F.lit("}"))).otherwise("")
    return counters.select(F.concat("name", labels, F.lit(" "), F.col("value").cast("string")).alias("line"))
