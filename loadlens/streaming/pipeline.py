"""Structured Streaming: events in, transitions out, with each zone's windows and machine as keyed state.

No watermark: zones' clocks drift apart, and late events count. A zone's seconds lie in map states of their own, read at a
batch's start and written back where they changed; state is bounded by eviction, at most 300 seconds of buckets besides
those of late events. The source must deliver in order of seq; within a batch rows are sorted by it, so a batch should be
bounded (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from loadlens.operators.machine import SlidingWindow, ZoneState, flags, step
from loadlens.operators.metrics import counter
from loadlens.operators.transitions import CHANGES
from loadlens.sources.decode import decoded_alerts, encoded_alerts, message_stream, decoded_events, wire_alerts, zone_events
from loadlens.sources.sinks import append_history, read_history, upsert_latest, write_batch

MACHINE = "state string, stressed_since long, critical_since long, last_alert long, latitude double, longitude double"
LOCATED = CHANGES + ", latitude double, longitude double"
_NAMES = [c.split()[0] for c in LOCATED.split(", ")]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Zone(StatefulProcessor):
    """A zone's machine, first coordinates and second buckets; emits its changes of state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.machine = handle.getValueState("machine", MACHINE)
        self.seconds = {n: handle.getMapState(f"seconds{n}", "sec long", "total long, n long") for n in (60, 300)}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        kept = self.machine.get() if self.machine.exists() else None
        z = ZoneState(*kept[:4]) if kept else ZoneState()
        at = tuple(kept[4:]) if kept else None
        before = {n: {int(k[0]): [v[0], v[1]] for k, v in self.seconds[n].iterator()} if kept else {} for n in self.seconds}
        short, long = (SlidingWindow(n, {k: list(v) for k, v in before[n].items()}) for n in (60, 300))
        for r in sorted(rows, key=lambda r: r.seq):
            at = at or (r.latitude, r.longitude)
            short.add(r.t, r.load_milli)
            long.add(r.t, r.load_milli)
            if change := step(z, r.t, *flags(short.total, short.count, long.total, long.count)):
                averages = short.total / (short.count * 1000), long.total / (long.count * 1000)
                yield Row(*_NAMES)(key[0], r.seq, r.t, change[0], change[1], *averages, change[2], *at)
        self.machine.update((z.state, z.stressed_since, z.critical_since, z.last_alert, *(at or (None, None))))
        for n, window in ((60, short), (300, long)):
            for sec in before[n].keys() - window.buckets.keys():
                self.seconds[n].removeKey((sec,))
            for sec, bucket in window.buckets.items():
                if before[n].get(sec) != bucket:
                    self.seconds[n].updateValue((sec,), tuple(bucket))

    def close(self) -> None:
        pass


def transition_stream(events: DataFrame) -> DataFrame:
    """Changes of state, with the zone's first coordinates, of a stream of (seq, zone_id, t, load_milli[, latitude, longitude])."""
    for name in ("latitude", "longitude"):
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast("double"))
    events = events.select("zone_id", "seq", "t", "load_milli", "latitude", "longitude")
    if events.sparkSession.conf.get(_PROVIDER, "") != _ROCKS:
        events.sparkSession.conf.set(_PROVIDER, _ROCKS)
    return events.groupBy("zone_id").transformWithState(Zone(), LOCATED, "Append", "None")


def start(events: DataFrame, folder: str, name: str = "transitions", available_now: bool = True, unique: str | None = None) -> StreamingQuery:
    """Runs the stream into folder: transitions, alert messages, alert history and latest state, each batch written whole or again.

    unique: a column by which events that repeat are left out; every value ever seen is then kept as state."""
    running = [q for q in events.sparkSession.streams.active if q.name == name]
    if running:
        return running[0]
    events = events.dropDuplicates([unique]) if unique else events
    events = events.observe("events", F.count(F.lit(1)).alias("processed"))

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        write_batch(batch, f"{folder}/transitions", number)
        alerted = batch.filter("alerted")
        encoded_alerts(wire_alerts(batch)).write.mode("overwrite").parquet(f"{folder}/alerts/batch={number}")
        append_history(alerted, f"{folder}/history", number)
        upsert_latest(batch, f"{folder}/latest", number)
        batch.unpersist()

    writer = transition_stream(events).writeStream.queryName(name).foreachBatch(write).outputMode("append")
    writer = writer.option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def start_from_messages(spark: SparkSession, source: str | dict, folder: str, name: str = "transitions", **options) -> StreamingQuery:
    """The whole way: JSON messages from a folder or from Kafka, decoded, run through ``start``."""
    rows, _ = decoded_events(message_stream(spark, source))
    return start(zone_events(rows), folder, name, **options)


def published_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """The alert messages that ``start`` published, decoded."""
    return decoded_alerts(spark.read.parquet(f"{folder}/alerts").drop("batch"))[0]


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """(name, labels, value): changes by states, alerts published, consumed, and persisted by storage."""
    changes = spark.read.parquet(f"{folder}/transitions")
    published = spark.read.parquet(f"{folder}/alerts")
    consumed = published_alerts(spark, folder)

    def total(rows: DataFrame, name: str, labels=None) -> DataFrame:
        return counter(rows.select(F.lit(name).alias("name"), (labels if labels is not None else F.lit("")).alias("labels")), "name", "labels")

    states = F.concat(F.lit('from="'), F.col("previous_state"), F.lit('",to="'), F.col("current_state"), F.lit('"'))
    return (
        total(changes, "state_transitions_total", states).unionByName(total(published, "alerts_published_total")).unionByName(total(consumed, "alerts_consumed_total"))
        .unionByName(total(consumed, "alerts_persisted_total", F.lit('storage="lists"'))).unionByName(total(read_history(spark, folder + "/history"), "alerts_persisted_total", F.lit('storage="history"')))
    )


class Progress(StreamingQueryListener):
    """Running totals of a session's streams: rows in, batches, and what ``observe`` counted."""

    def __init__(self) -> None:
        self.rows, self.batches, self.observed = 0, 0, {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.rows += event.progress.numInputRows
        self.batches += 1
        for name, row in event.progress.observedMetrics.items():
            for key, value in row.asDict().items():
                self.observed[f"{name}_{key}"] = self.observed.get(f"{name}_{key}", 0) + (value or 0)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def progress(query: StreamingQuery) -> dict:
    """What the source and the state have done so far."""
    last = query.lastProgress or {}
    return {"status": query.status, "batch": last.get("batchId"), "rows_per_second": last.get("processedRowsPerSecond")}


def stopped(query: StreamingQuery) -> dict:
    """Ends the stream after the batch at hand; its last progress."""
    query.stop()
    return progress(query)
