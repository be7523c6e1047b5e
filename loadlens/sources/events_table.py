"""The table ``events`` as zone load events: thirty days become one hour, and loads follow regimes that cross all thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = 1_704_067_200_000
SQUEEZE = 720
ZONES = 5


def zone_events(spark: SparkSession, sf_dir: str, late: bool = False) -> DataFrame:
    return as_zone_events(spark.read.parquet(f"{sf_dir}/events.parquet"), late)


def zone_event_stream(spark: SparkSession, sf_dir: str, late: bool = False) -> DataFrame:
    """The same as a stream; files are taken one by one in the order they came."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", 1)
    return as_zone_events(stream.parquet(sf_dir), late)


def as_zone_events(events: DataFrame, late: bool = False) -> DataFrame:
    """(seq, zone_id, t, load_milli): seq is the order of arrival; late puts every 97th event 90 s back."""
    events = events.select("event_id", "ts", "user_id")
    past = F.unix_millis(F.col("ts").cast("timestamp")) - START
    rows = events.select("event_id", "user_id", F.floor(past / SQUEEZE).alias("u"))
    regime = (F.col("user_id") % ZONES + F.floor(F.col("u") / 900_000)) % 3
    wave = F.when(F.floor(F.col("u") / 100_000) % 2 == 0, 950).otherwise(500)
    load = F.when(regime == 0, 450).when(regime == 1, wave).otherwise(900) + (F.col("event_id") * 37) % 50
    t = F.col("u") + START
    if late:
        t = t - F.when(F.col("event_id") % 97 == 0, 90_000).otherwise(0)
    zone = F.concat(F.lit("Z-"), (F.col("user_id") % ZONES + 1).cast("string"))
    return rows.select(F.col("event_id").alias("seq"), zone.alias("zone_id"), t.alias("t"), load.cast("bigint").alias("load_milli"))
