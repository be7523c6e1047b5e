import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loadlens.operators import geo, metrics, transitions, windows
from loadlens.plans import api
from loadlens.sources import decode
from loadlens.sources.events_table import zone_events
from loadlens.sources.generator import Simulation, generate_events, generate_zones, sensor_events
from loadlens.streaming import pipeline

# Expected figures of the test tables: N->S, S->C, C->S, S->N, alerts, suppressed.
EXPECTED = {("sf0.001", False): (12, 15, 14, 10, 51, 0), ("sf0.01", False): (9, 44, 43, 6, 95, 7), ("sf0.001", True): (12, 15, 14, 10, 51, 0), ("sf0.01", True): (9, 45, 44, 6, 97, 7)}


@pytest.mark.parametrize(("sf", "late"), EXPECTED)
def test_transition_figures(spark, sf, late):
    events = zone_events(spark, f"/root/testdata/{sf}", late)
    assert windows.in_order(events) is not late
    scored = transitions.scored_in_arrival_order(events) if late else windows.scored(events)
    rows = transitions.transitions(scored).collect()
    pairs = [("NORMAL", "STRESSED"), ("STRESSED", "CRITICAL"), ("CRITICAL", "STRESSED"), ("STRESSED", "NORMAL")]
    counts = [sum((r.previous_state, r.current_state) == p for r in rows) for p in pairs]
    assert (*counts, sum(r.alerted for r in rows), sum(not r.alerted for r in rows)) == EXPECTED[sf, late]


def test_window_checksums_and_both_forms_agree(spark):
    events = zone_events(spark, "/root/testdata/sf0.01")
    columns = ["sum60", "count60", "sum300", "count300"]
    wide, fold = windows.scored(events), transitions.scored_in_arrival_order(events)
    sums = wide.agg(*[F.sum(c) for c in columns]).first()
    assert tuple(sums) == (236551651, 337006, 1125743265, 1598684)
    key = ["zone_id", "seq", *columns]
    assert wide.select(key).exceptAll(fold.select(key)).count() == 0


def test_every_query_matches_its_sql(spark, sf_small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{sf_small}/events.parquet')")
    from loadlens.plans.queries import ORACLE, QUERIES

    for name, sql in ORACLE.items():
        got = QUERIES[name](spark, sf_small)
        columns = sorted(got.columns)
        here = sorted(map(repr, got.select(columns).toPandas().itertuples(index=False, name=None)))
        there = con.execute(sql).df()
        assert sorted(there.columns) == columns, name
        assert here == sorted(map(repr, there[columns].itertuples(index=False, name=None))), name
    assert entry.entry(spark).count() > 0


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    events = zone_events(spark, "/root/testdata/sf0.001", late=True)
    expected = sorted(map(tuple, transitions.transitions(transitions.scored_in_arrival_order(events)).collect()))
    source = tmp_path / "in"
    for part in range(2):
        for piece in range(3):
            k = part * 3 + piece
            rows = events.filter((F.col("seq") >= k * 170) & (F.col("seq") < ((k + 1) * 170 if k < 5 else 10**9)))
            rows.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        pipeline.start(stream, str(tmp_path / "out")).awaitTermination(240)
    got = spark.read.parquet(str(tmp_path / "out/transitions")).drop("batch", "latitude", "longitude")
    assert sorted(map(tuple, got.collect())) == expected
    from loadlens.operators.views import latest_state
    from loadlens.sources.sinks import read_history, read_latest

    alerted = [r for r in expected if r[7]]
    assert sorted(r.id for r in read_history(spark, str(tmp_path / "out/history")).collect()) == sorted(r[1] for r in alerted)
    latest = latest_state(got)
    columns = sorted(latest.columns)
    assert read_latest(spark, str(tmp_path / "out/latest")).columns[-2:] == ["latitude", "longitude"]
    assert sorted(map(tuple, read_latest(spark, str(tmp_path / "out/latest")).select(columns).collect())) == sorted(map(tuple, latest.select(columns).collect()))


def test_decoding(spark):
    good = {"eventId": "e", "zoneId": "Z-1", "latitude": 1.0, "longitude": 2.0, "load": 0.5, "eventTimestamp": 5, "producedAt": 6}
    texts = [json.dumps(good), None, "{", json.dumps({**good, "load": None}), "[]", json.dumps({**good, "more": 1})]
    messages = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "value string, offset long")
    rows, rejects = decode.decoded_events(messages)
    assert sorted(r.offset for r in rows.collect()) == [0, 5] and sorted(r.offset for r in rejects.collect()) == [2, 3, 4]
    back, _ = decode.decoded_events(decode.encoded_events(rows))
    assert back.select("zoneId", "load").distinct().collect() == [("Z-1", 0.5)]
    assert decode.kafka_source("h:1", decode.EVENT_TOPIC)["startingOffsets"] == "earliest"


def test_generator(spark):
    zones = {r.zone_id: r for r in generate_zones(spark, 10).collect()}
    assert (zones["Z-2"].latitude, zones["Z-2"].longitude, zones["Z-2"].base_load) == (51.057559, 137.507764, 0.337)
    assert (zones["Z-10"].latitude, zones["Z-10"].base_load) == (-85.0, 0.433)
    with pytest.raises(ValueError, match="2 zones"):
        generate_zones(spark, 1)
    rows = generate_events(generate_zones(spark, 10), 50, 1_704_067_200_000, 3)
    clock = {}
    for r in rows.orderBy("seq").collect():
        step = 1 + int(r.zone_id[2:]) % 20
        clock[r.zone_id] = min(clock.get(r.zone_id, r.produced_at) + step, r.produced_at)
        assert r.t == clock[r.zone_id] and 0 <= r.load <= 1
    assert sensor_events(rows).count() == 500 and Simulation.from_environment().zones == 10


def test_radius_and_arguments(spark):
    zones = generate_zones(spark, 200)
    near = geo.within(zones, 10.0, 179.0, 1500.0).collect()
    plain = zones.withColumn("d", geo.distance_km(F.lit(10.0), F.lit(179.0), F.col("latitude"), F.col("longitude"))).filter("d <= 1500").collect()
    assert {r.zone_id for r in near} == {r.zone_id for r in plain} and near
    cross = zones.crossJoin(zones.select(F.col("zone_id").alias("z"), F.col("latitude").alias("a"), F.col("longitude").alias("b")))
    for radius in (300.0, 2000.0, 9000.0):
        pairs = geo.pairs_within(zones, zones, radius)
        want = cross.filter(geo.distance_km(F.col("latitude"), F.col("longitude"), F.col("a"), F.col("b")) <= radius)
        assert sorted((r.zone_id, r.near_zone) for r in pairs.collect()) == sorted((r.zone_id, r.z) for r in want.collect())
    for bad in (None, float("nan"), "3"):
        with pytest.raises(ValueError, match="number"):
            geo.within(zones, bad, 0.0, 1.0)
    for bad in (0, -1, "5", True):
        with pytest.raises(ValueError, match="limit"):
            api.recent_alerts(zones, bad)


def test_histogram_and_gaps_across_blocks(spark):
    events = spark.createDataFrame([(i, "Z-1", i * i) for i in range(40)], "seq long, zone_id string, t long")
    got = metrics.gaps(events, block=7)
    assert sorted(r.gap for r in got.collect()) == [2 * i + 1 for i in range(39)]
    row = metrics.histogram(got, F.col("gap"), "zone_id").first()
    assert (row.le_1, row.le_5, row.le_100, row["count"], row.total) == (1, 3, 39, 39, 39 * 39)


def test_runs_equal_single_steps():
    import random

    import numpy as np

    from loadlens.operators.machine import ZoneState, flags, run, step

    rng = random.Random(11)
    for trial in range(200):
        n, t, rows = rng.randint(0, 400), 0, []
        level = [700, 700]
        for _ in range(n):
            t += rng.choice([0, 10, 900, 5000, 15_000]) - (trial % 3 == 0) * rng.choice([0, 0, 2000])
            if rng.random() < 0.1:
                level = [rng.choice([500, 640, 760, 850, 950]), rng.choice([500, 650, 760, 800, 900])]
            rows.append((t, level[0], 1, level[1], 1))
        one, z = [], ZoneState()
        for k, (t_, *s) in enumerate(rows):
            if change := step(z, t_, *flags(*s)):
                one.append((k, *change))
        columns = [np.array([r[j] for r in rows], np.int64) for j in range(5)]
        whole, other = [], ZoneState()
        for a in range(0, max(n, 1), 150):  # in batches
            whole += [(a + k, *c) for k, *c in run(other, *(c[a : a + 150] for c in columns))]
        assert [tuple(x) for x in whole] == one and z == other


def test_point_queries_filter_below_the_fold(spark, sf_small):
    from loadlens.plans import queries

    for name in ("zone_by_id", "zone_alert_list", "zone_history"):
        plan = queries.QUERIES[name](spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.rindex("MapInArrow") :]
        assert "Filter" in below and "Z-" in below, name


def test_history_is_pruned_by_day(spark, sf_small):
    from loadlens.plans import queries

    folder = queries._streamed(spark, sf_small)
    plan = queries.stream_history(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters" in plan and "zone_id" in plan[plan.index("PushedFilters") :]
    assert spark.read.parquet(f"{folder}/transitions").select("batch").distinct().count() > 1


def test_generator_without_joins(spark):
    rows = generate_events(generate_zones(spark, 10), 2500, 1_704_067_200_000, 3)
    assert rows.count() == 25_000 and "Join" not in rows._jdf.queryExecution().executedPlan().toString()
    assert generate_events(generate_zones(spark, 10), 0, 0, 3).count() == 0
    with pytest.raises(ValueError, match="stride"):
        generate_events(generate_zones(spark, 20), 5, 0, 3, stride=20)


def test_live_events_are_a_stream(spark):
    from loadlens.sources import generator

    live = generator.live_events(spark, generate_zones(spark, 3), 10)
    assert live.isStreaming and live.columns == ["eventId", "zoneId", "latitude", "longitude", "load", "eventTimestamp", "producedAt"]


def test_scenarios_and_samples(spark):
    from loadlens.functions import scalar
    from loadlens.sources import decode as d

    rows = spark.createDataFrame([(0.2,), (0.7,)], "x double")
    for name, want in (("normal", [0.2, 0.7]), ("spike", [0.7, 1.0]), ("drop", [0.0, 0.3]), ("odd", [0.2, 0.7])):
        got = [r[0] for r in rows.select(scalar.scenario_load(F.col("x"), name)).collect()]
        assert got == pytest.approx(want)
    assert d.decoded_alerts(d.encoded_alerts(d.sample_alert(spark, 5)))[0].first().timestamp == 5


def test_progress_is_observed_and_duplicates_can_go(spark, tmp_path):
    events = zone_events(spark, "/root/testdata/sf0.001")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    events.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    listener = pipeline.Progress()
    spark.streams.addListener(listener)
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = pipeline.start(stream, str(tmp_path / "out"), "unique", unique="seq")
    query.awaitTermination(240)
    rows = spark.read.parquet(str(tmp_path / "out/transitions"))
    assert rows.count() == transitions.transitions(windows.scored(events)).count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    spark.streams.removeListener(listener)
    assert listener.rows == 2000 and listener.observed["events_processed"] == 1000


def test_late_events_fail_where_order_is_taken_for_granted(spark, sf_small):
    late = zone_events(spark, sf_small, late=True)
    with pytest.raises(Exception, match="came late"):
        transitions.transitions(windows.scored(late), in_order=True).collect()
    assert transitions.transitions(transitions.scored(late)).count() == sum(EXPECTED["sf0.001", True][:4])
