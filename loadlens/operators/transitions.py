"""The state machine over a table: each zone's events in order of arrival.

What a zone does next depends on all it did before, so a zone is one sequence; rows are dealt by zone, sorted on disk
if need be, and streamed through the machine batch by batch: a task holds one zone's state, never its events. The machine
looks at the events where a comparison changes or a dwell time ends, found in whole arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.operators import windows
from loadlens.operators.machine import SlidingWindow, ZoneState, run
from loadlens.operators.windows import in_order

CHANGES = "zone_id string, seq long, t long, previous_state string, current_state string, avg1m double, avg5m double, alerted boolean"


def _ordered(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("zone_id", "seq", *columns).repartition("zone_id").sortWithinPartitions("zone_id", "seq")


def transitions(scored: DataFrame, in_order: bool = False) -> DataFrame:
    """Changes of state with averages at the event and whether an alert went out, of scored events.

    in_order: the averages hold only if no event came late (``windows.scored``); one that did fails the job."""
    rows = _ordered(scored, "t", "sum60", "count60", "sum300", "count300")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zone, z, last = None, ZoneState(), None
        for batch in batches:
            ids = batch.column(0).dictionary_encode()
            code = ids.indices.to_numpy()
            seq, *columns = (batch.column(k).to_numpy() for k in range(1, 7))
            cuts = [*np.flatnonzero(np.r_[True, code[1:] != code[:-1]]).tolist(), len(code)] if len(code) else []
            out = []
            for a, b in zip(cuts, cuts[1:]):
                if (own := batch.column(0)[a].as_py()) != zone:
                    zone, z, last = own, ZoneState(), None
                t, s1, n1, s5, n5 = (c[a:b] for c in columns)
                if in_order:
                    sec = t // 1000
                    if (sec[1:] < sec[:-1]).any() or (last is not None and sec[0] < last):
                        raise ValueError(f"an event of {own} came late: use scored() or scored_in_arrival_order()")
                    last = sec[-1]
                for k, before, after, alerted in run(z, t, s1, n1, s5, n5):
                    out.append((own, int(seq[a + k]), int(t[k]), before, after, s1[k] / (n1[k] * 1000), s5[k] / (n5[k] * 1000), alerted))
            if out:
                yield _batch(out, _CHANGE)

    return rows.mapInArrow(fold, CHANGES)


_CHANGE = pa.schema([
    ("zone_id", pa.string()), ("seq", pa.int64()), ("t", pa.int64()), ("previous_state", pa.string()), ("current_state", pa.string()),
    ("avg1m", pa.float64()), ("avg5m", pa.float64()), ("alerted", pa.bool_()),
])
_SCORED = pa.schema([("zone_id", pa.string()), *((c, pa.int64()) for c in ("seq", "t", "load_milli", "sum60", "count60", "sum300", "count300"))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def scored_in_arrival_order(events: DataFrame) -> DataFrame:
    """Window sums where events may come late: (zone_id, seq, t, load_milli, sum60, count60, sum300, count300)."""
    rows = _ordered(events, "t", "load_milli")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zone, short, long = None, None, None
        for batch in batches:
            out = []
            for own, seq, t, load in zip(*(c.to_pylist() for c in batch.columns)):
                if own != zone or short is None:
                    zone, short, long = own, SlidingWindow(60), SlidingWindow(300)
                short.add(t, load)
                long.add(t, load)
                out.append((own, seq, t, load, short.total, short.count, long.total, long.count))
            if out:
                yield _batch(out, _SCORED)

    return rows.mapInArrow(run, "zone_id string, " + ", ".join(f"{f.name} long" for f in list(_SCORED)[1:]))


def scored(events: DataFrame) -> DataFrame:
    """Window sums in either case: by windows where no event came late, else in order of arrival."""
    if in_order(events):
        return windows.scored(events).select("zone_id", "seq", "t", "load_milli", "sum60", "count60", "sum300", "count300")
    return scored_in_arrival_order(events)


def alerts(changes: DataFrame) -> DataFrame:
    return changes.filter("alerted").drop("alerted")


def transition_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("previous_state", "current_state").agg(
        F.count("*").alias("transitions"), F.count_if("alerted").alias("alerts"), F.count_if(~F.col("alerted")).alias("suppressed")
    )
