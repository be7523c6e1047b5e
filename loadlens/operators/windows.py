"""Sliding averages per zone and event, over 60 and 300 whole seconds.

A window holds the events of the last W seconds that have arrived: whole earlier seconds, and of the event's own second
those up to it. Events are first summed by (zone, second); the earlier seconds come from a range frame over these sums,
cut into chunks of time with a lookback, the own second from a running sum. So the work is dealt by (zone, chunk) and by
(zone, second): a zone with a third of all events is spread over its seconds.

This holds where seconds never decrease within a zone in order of arrival (``in_order``); with late events, which push
old seconds out by their own time, ``transitions.scored_in_arrival_order``. ``transitions.scored`` picks the one that holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZES = (60, 300)
CHUNK = 3600


def seconds(events: DataFrame) -> DataFrame:
    return events.withColumn("sec", F.floor(F.col("t") / 1000))


def second_buckets(events: DataFrame) -> DataFrame:
    """(zone_id, sec, sum_milli, n) of events (zone_id, t, load_milli)."""
    return seconds(events).groupBy("zone_id", "sec").agg(F.sum("load_milli").alias("sum_milli"), F.count("*").alias("n"))


def _chunked(buckets: DataFrame) -> DataFrame:
    """Buckets by chunk of time, those near a chunk's end also as lookback of the next; home tells which row counts."""
    chunk = F.floor(F.col("sec") / CHUNK)
    near = F.col("sec") % CHUNK >= CHUNK - max(SIZES)
    both = F.when(near, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    return buckets.withColumn("chunk", F.explode(both)).withColumn("home", F.col("chunk") == chunk)


def earlier_sums(buckets: DataFrame) -> DataFrame:
    """(zone_id, sec, before60, cnt60, before300, cnt300, first300): sums of the earlier seconds in each window."""
    rows = _chunked(buckets)
    out = ["zone_id", "sec"]
    for size in SIZES:
        w = Window.partitionBy("zone_id", "chunk").orderBy("sec").rangeBetween(-(size - 1), -1)
        rows = rows.withColumn(f"before{size}", F.coalesce(F.sum("sum_milli").over(w), F.lit(0)))
        rows = rows.withColumn(f"cnt{size}", F.coalesce(F.sum("n").over(w), F.lit(0)))
        rows = rows.withColumn(f"first{size}", F.coalesce(F.min("sec").over(w), F.col("sec")))
        out += [f"before{size}", f"cnt{size}", f"first{size}"]
    return rows.filter("home").select(*out)


def average(total: Column, count: Column) -> Column:
    """Mean load of milli-load sums; an empty window has 0."""
    return F.coalesce(total.cast("double") / F.nullif(count * 1000, F.lit(0)), F.lit(0.0))


def scored(events: DataFrame) -> DataFrame:
    """events with sec, sum60, count60, sum300, count300, avg1m, avg5m and the two window durations in seconds."""
    own = Window.partitionBy("zone_id", "sec").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = seconds(events).withColumn("own", F.sum("load_milli").over(own)).withColumn("n", F.count("*").over(own))
    rows = rows.join(earlier_sums(second_buckets(events)), ["zone_id", "sec"])
    for size in SIZES:
        rows = rows.withColumn(f"sum{size}", F.col(f"before{size}") + F.col("own"))
        rows = rows.withColumn(f"count{size}", F.col(f"cnt{size}") + F.col("n"))
    keep = [*events.columns, "sec", "sum60", "count60", "sum300", "count300"]
    return rows.select(
        *keep, average(F.col("sum60"), F.col("count60")).alias("avg1m"), average(F.col("sum300"), F.col("count300")).alias("avg5m"),
        (F.col("sec") - F.col("first60")).alias("duration60"), (F.col("sec") - F.col("first300")).alias("duration300"),
    )


def in_order(events: DataFrame) -> bool:
    """Whether seconds never decrease within a zone by seq: no event of a second arrived after one of a later second.

    Seconds are summed up on the map side; they are compared within chunks of time, then chunk by chunk."""
    rows = seconds(events).groupBy("zone_id", "sec").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    rows = rows.withColumn("chunk", F.floor(F.col("sec") / CHUNK))
    inside = Window.partitionBy("zone_id", "chunk").orderBy("sec").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("bad", F.col("first") < F.max("last").over(inside))
    chunks = rows.groupBy("zone_id", "chunk").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("bad").alias("bad"))
    earlier = Window.partitionBy("zone_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("before", F.max("last").over(earlier)).filter("bad or first < before").limit(1).count() == 0
