"""Every query by name over the test tables, and the same in SQL as an independent check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.functions import scalar
from loadlens.operators import metrics, transitions, views, windows
from loadlens.plans import api
from loadlens.sources import decode, generator, sinks
from loadlens.sources.events_table import START, ZONES, zone_event_stream, zone_events
from loadlens.sources.generator import generate_events, generate_zones
from loadlens.sources.scratch import fresh_folder
from loadlens.streaming import pipeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


# SQL building blocks: events, window sums, transitions.
_EVENTS = f"""
ev0 AS (
  SELECT event_id AS seq, user_id % 5 AS z, (epoch_us(ts) // 1000 - {START}) // 720 AS u FROM events
), ev1 AS (
  SELECT seq, concat('Z-', z + 1) AS zone_id, u + {START} AS t,
         (CASE (z + u // 900000) % 3 WHEN 0 THEN 450 WHEN 1 THEN CASE WHEN (u // 100000) % 2 = 0 THEN 950 ELSE 500 END ELSE 900 END
          + (seq * 37) % 50)::BIGINT AS load_milli
  FROM ev0
)"""
_IN_ORDER = _EVENTS + ", ev AS (SELECT *, t // 1000 AS sec FROM ev1)"
_LATE = _EVENTS + """, ev AS (
  SELECT seq, zone_id, t2 AS t, load_milli, t2 // 1000 AS sec
  FROM (SELECT *, t - CASE WHEN seq % 97 = 0 THEN 90000 ELSE 0 END AS t2 FROM ev1)
)"""
_SCORED = _IN_ORDER + """, sc AS (
  SELECT seq, zone_id, t, load_milli, sec,
    (coalesce(sum(load_milli) OVER w60, 0) + sum(load_milli) OVER own)::BIGINT AS sum60,
    (count(load_milli) OVER w60 + count(*) OVER own)::BIGINT AS count60,
    (coalesce(sum(load_milli) OVER w300, 0) + sum(load_milli) OVER own)::BIGINT AS sum300,
    (count(load_milli) OVER w300 + count(*) OVER own)::BIGINT AS count300,
    (sec - coalesce(min(sec) OVER w60, sec))::BIGINT AS duration60,
    (sec - coalesce(min(sec) OVER w300, sec))::BIGINT AS duration300
  FROM ev
  WINDOW w60 AS (PARTITION BY zone_id ORDER BY sec RANGE BETWEEN 59 PRECEDING AND 1 PRECEDING),
         w300 AS (PARTITION BY zone_id ORDER BY sec RANGE BETWEEN 299 PRECEDING AND 1 PRECEDING),
         own AS (PARTITION BY zone_id, sec ORDER BY seq ROWS UNBOUNDED PRECEDING)
)"""
# A late event's window: an event leaves at the first later one whose second is W or more past its own.
_LATE_SCORED = _LATE + """, nr AS (
  SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY seq) AS rn FROM ev
), gone AS (
  SELECT a.zone_id, a.rn, any_value(a.load_milli) AS load_milli,
         min(CASE WHEN b.sec >= a.sec + 60 THEN b.rn END) AS k60, min(CASE WHEN b.sec >= a.sec + 300 THEN b.rn END) AS k300
  FROM nr a JOIN nr b ON a.zone_id = b.zone_id AND b.rn > a.rn GROUP BY a.zone_id, a.rn
), g60 AS (SELECT zone_id, k60 AS rn, sum(load_milli) AS s, count(*) AS n FROM gone WHERE k60 IS NOT NULL GROUP BY ALL),
g300 AS (SELECT zone_id, k300 AS rn, sum(load_milli) AS s, count(*) AS n FROM gone WHERE k300 IS NOT NULL GROUP BY ALL),
sc AS (
  SELECT seq, nr.zone_id, t, load_milli,
    (sum(load_milli) OVER w - coalesce(sum(g60.s) OVER w, 0))::BIGINT AS sum60, (count(*) OVER w - coalesce(sum(g60.n) OVER w, 0))::BIGINT AS count60,
    (sum(load_milli) OVER w - coalesce(sum(g300.s) OVER w, 0))::BIGINT AS sum300, (count(*) OVER w - coalesce(sum(g300.n) OVER w, 0))::BIGINT AS count300
  FROM nr LEFT JOIN g60 ON nr.zone_id = g60.zone_id AND nr.rn = g60.rn LEFT JOIN g300 ON nr.zone_id = g300.zone_id AND nr.rn = g300.rn
  WINDOW w AS (PARTITION BY nr.zone_id ORDER BY nr.rn ROWS UNBOUNDED PRECEDING)
)"""
_MACHINE = """, fl AS (
  SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY seq) AS rnk, sum300 >= 750 * count300 AS hi5, sum60 >= 900 * count60 AS hi1,
         sum300 <= 650 * count300 AS lo5, sum300 <= 800 * count300 AS dn5
  FROM sc
), st AS (
  SELECT zone_id, 0::BIGINT AS rnk, 0::BIGINT AS seq, 0::BIGINT AS t, 0::BIGINT AS sum60, 1::BIGINT AS count60, 0::BIGINT AS sum300,
         1::BIGINT AS count300, 'NORMAL' AS prev, 'NORMAL' AS state, NULL::BIGINT AS ss, NULL::BIGINT AS cs, NULL::BIGINT AS la, false AS alerted
  FROM (SELECT DISTINCT zone_id FROM fl)
  UNION ALL
  SELECT zone_id, rnk, seq, t, sum60, count60, sum300, count300, state, nxt, nss, ncs,
         CASE WHEN nxt <> state AND (la IS NULL OR t - la > 1000) THEN t ELSE la END, nxt <> state AND (la IS NULL OR t - la > 1000)
  FROM (
    SELECT f.zone_id, f.rnk, f.seq, f.t, f.sum60, f.count60, f.sum300, f.count300, s.state, s.la,
      CASE s.state
        WHEN 'NORMAL' THEN CASE WHEN hi5 AND f.t - coalesce(s.ss, f.t) >= 60000 THEN 'STRESSED' ELSE 'NORMAL' END
        WHEN 'STRESSED' THEN CASE WHEN hi1 THEN CASE WHEN f.t - coalesce(s.cs, f.t) >= 20000 THEN 'CRITICAL' ELSE 'STRESSED' END
                                  WHEN lo5 THEN 'NORMAL' ELSE 'STRESSED' END
        ELSE CASE WHEN dn5 THEN 'STRESSED' ELSE 'CRITICAL' END END AS nxt,
      CASE s.state
        WHEN 'NORMAL' THEN CASE WHEN hi5 AND f.t - coalesce(s.ss, f.t) < 60000 THEN coalesce(s.ss, f.t) END
        WHEN 'STRESSED' THEN CASE WHEN NOT hi1 AND lo5 THEN NULL ELSE s.ss END
        ELSE CASE WHEN dn5 THEN f.t ELSE s.ss END END AS nss,
      CASE s.state
        WHEN 'STRESSED' THEN CASE WHEN hi1 AND f.t - coalesce(s.cs, f.t) < 20000 THEN coalesce(s.cs, f.t) END
        WHEN 'CRITICAL' THEN CASE WHEN dn5 THEN NULL ELSE s.cs END ELSE s.cs END AS ncs
    FROM st s JOIN fl f ON f.zone_id = s.zone_id AND f.rnk = s.rnk + 1
  )
), tr AS (
  SELECT zone_id, seq, t, prev AS previous_state, state AS current_state, sum60::DOUBLE / (count60 * 1000) AS avg1m,
         sum300::DOUBLE / (count300 * 1000) AS avg5m, alerted
  FROM st WHERE rnk > 0 AND prev <> state
), al AS (SELECT * EXCLUDE (alerted) FROM tr WHERE alerted)"""
_TR = "WITH RECURSIVE " + _SCORED + _MACHINE
_AVERAGES = "sum60::DOUBLE / (count60 * 1000) AS avg1m, sum300::DOUBLE / (count300 * 1000) AS avg5m"


def _events(spark: SparkSession, sf_dir: str, zone: str | None = None) -> DataFrame:
    """The events, of one zone only where a query asks for it: the filter then stands below all windows and the fold."""
    events = zone_events(spark, sf_dir)
    return events.filter(F.col("zone_id") == zone) if zone else events


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.scored(_events(spark, sf_dir))


def _changes(spark: SparkSession, sf_dir: str, zone: str | None = None) -> DataFrame:
    return transitions.transitions(windows.scored(_events(spark, sf_dir, zone)), in_order=True)


def _alerts(spark: SparkSession, sf_dir: str, zone: str | None = None) -> DataFrame:
    return transitions.alerts(_changes(spark, sf_dir, zone))


def _located(spark: SparkSession, sf_dir: str, zone: str | None = None) -> DataFrame:
    zones = generate_zones(spark, ZONES).select("zone_id", "latitude", "longitude")
    return views.latest_state(_changes(spark, sf_dir, zone), zones)


@query("WITH " + _IN_ORDER + " SELECT zone_id, sec, sum(load_milli)::BIGINT AS sum_milli, count(*) AS n FROM ev GROUP BY ALL")
def second_buckets(spark, sf_dir):
    return windows.second_buckets(zone_events(spark, sf_dir))


@query("WITH " + _SCORED + f" SELECT seq, zone_id, t, load_milli, sec, sum60, count60, sum300, count300, {_AVERAGES} FROM sc")
def scored_events(spark, sf_dir):
    return _scored(spark, sf_dir).drop("duration60", "duration300")


@query("WITH " + _SCORED + " SELECT zone_id, seq, duration60, duration300 FROM sc")
def window_duration(spark, sf_dir):
    return _scored(spark, sf_dir).select("zone_id", "seq", "duration60", "duration300")


@query(_TR + " SELECT * FROM tr", "transitions")
def zone_transitions(spark, sf_dir):
    return _changes(spark, sf_dir)


@query(_TR + " SELECT * FROM al")
def alerts(spark, sf_dir):
    return _alerts(spark, sf_dir)


@query(_TR + """ SELECT previous_state, current_state, count(*) AS transitions, count_if(alerted)::BIGINT AS alerts,
       count_if(NOT alerted)::BIGINT AS suppressed FROM tr GROUP BY ALL""")
def transition_counts(spark, sf_dir):
    return transitions.transition_counts(_changes(spark, sf_dir))


@query(_TR + """ SELECT zone_id, count(*) AS critical_count FROM al
WHERE current_state = 'CRITICAL' AND t >= (SELECT max(t) FROM ev) - 7 * 86400000 GROUP BY zone_id ORDER BY 2 DESC, 1""")
def top_critical(spark, sf_dir):
    as_of = zone_events(spark, sf_dir).agg(F.max("t")).first()[0] or 0
    return api.top_critical(views.history(_alerts(spark, sf_dir)), as_of)


_LATEST = """, lt AS (
  SELECT zone_id, current_state AS state, avg1m, avg5m, t AS last_updated, seq
  FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY seq DESC) AS r FROM tr) WHERE r = 1
)"""
_ZONES = """, zn0 AS (SELECT i, 1 - i / 4.0::DOUBLE * 2 AS y FROM (SELECT unnest(range(0, 5)) AS i)), zn AS (
  SELECT concat('Z-', i + 1) AS zone_id, round(greatest(-85.0, least(85.0, degrees(asin(y)))), 6)::DOUBLE AS latitude,
         round((i * degrees(pi() * (3 - sqrt(5))) + 540) % 360 - 180, 6)::DOUBLE AS longitude FROM zn0
), lo AS (SELECT lt.*, latitude, longitude FROM lt LEFT JOIN zn USING (zone_id))"""


@query(_TR + _LATEST + " SELECT * FROM lt")
def zone_state_latest(spark, sf_dir):
    return views.latest_state(_changes(spark, sf_dir))


@query(_TR + _LATEST + _ZONES + " SELECT * FROM lo WHERE state = 'STRESSED' ORDER BY zone_id")
def zones_by_state(spark, sf_dir):
    return api.zones(_located(spark, sf_dir), "STRESSED")


@query(_TR + _LATEST + _ZONES + " SELECT * FROM lo ORDER BY zone_id")
def zones_all(spark, sf_dir):
    return api.zones(_located(spark, sf_dir))


@query(_TR + _LATEST + _ZONES + " SELECT * FROM lo WHERE zone_id = 'Z-3'")
def zone_by_id(spark, sf_dir):
    return api.zone(_located(spark, sf_dir, "Z-3"), "Z-3")


_AWAY = f"""2 * {scalar.EARTH_KM} * asin(sqrt(least(1.0, pow(sin(radians(latitude - 10) / 2), 2)
  + cos(radians(10)) * cos(radians(latitude)) * pow(sin(radians(longitude - 30) / 2), 2))))"""


@query(_TR + _LATEST + _ZONES + f" SELECT zone_id, state, round({_AWAY}, 3) AS distance_km FROM lo WHERE {_AWAY} <= 12000")
def zones_near(spark, sf_dir):
    rows = api.zones_near(_located(spark, sf_dir), 10.0, 30.0, 12_000.0)
    return rows.select("zone_id", "state", F.round("distance_km", 3).alias("distance_km"))


@query(_TR + """ SELECT * EXCLUDE (zone_id) FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY seq DESC)::INT AS rank FROM al)
WHERE zone_id = 'Z-2' AND rank <= 10""")
def zone_alert_list(spark, sf_dir):
    return api.zone_alerts(_alerts(spark, sf_dir, "Z-2"), "Z-2", 10)


@query(_TR + " SELECT * FROM al ORDER BY seq DESC LIMIT 20")
def recent_alerts(spark, sf_dir):
    return api.recent_alerts(_alerts(spark, sf_dir))


@query(_TR + " SELECT * FROM (SELECT * FROM al ORDER BY seq DESC LIMIT 1000) WHERE current_state = 'CRITICAL' ORDER BY seq DESC LIMIT 15")
def alerts_by_state(spark, sf_dir):
    return api.alerts_by_state(_alerts(spark, sf_dir), "CRITICAL", 15)


_HISTORY = "SELECT seq AS id, zone_id, previous_state, current_state, avg1m, avg5m, t AS timestamp FROM al"


@query(_TR + f" SELECT * EXCLUDE (zone_id) FROM ({_HISTORY}) WHERE zone_id = 'Z-1' AND timestamp BETWEEN {START + 600_000} AND {START + 3_000_000} ORDER BY timestamp, id")
def zone_history(spark, sf_dir):
    return api.history(views.history(_alerts(spark, sf_dir, "Z-1")), "Z-1", START + 600_000, START + 3_000_000)


@query(_TR + f" SELECT * FROM ({_HISTORY}) ORDER BY timestamp DESC, id DESC LIMIT 50")
def history_recent(spark, sf_dir):
    return api.history_recent(views.history(_alerts(spark, sf_dir)))


@query("WITH " + _IN_ORDER + """ SELECT zone_id, arg_min(seq % 180 - 90.0::DOUBLE, seq) AS latitude, arg_min(seq % 360 - 180.0::DOUBLE, seq) AS longitude
FROM ev GROUP BY zone_id""")
def first_seen_coords(spark, sf_dir):
    at = [(F.col("seq") % n - F.lit(float(n // 2))).alias(c) for n, c in ((180, "latitude"), (360, "longitude"))]
    return views.first_seen(zone_events(spark, sf_dir).select("zone_id", "seq", *at))


_GENERATED = """
zn0 AS (SELECT i, 1 - i / 24.0::DOUBLE * 2 AS y FROM (SELECT unnest(range(0, 25)) AS i)), zn AS (
  SELECT concat('Z-', i + 1) AS zone_id, i + 1 AS num, round(greatest(-85.0, least(85.0, degrees(asin(y)))), 6)::DOUBLE AS latitude,
    round((i * degrees(pi() * (3 - sqrt(5))) + 540) % 360 - 180, 6)::DOUBLE AS longitude,
    round(greatest(0.05, least(0.95, 0.2::DOUBLE + (i * 137 % 1000 % 300) / 1000::DOUBLE + CASE WHEN i % 7 = 0 THEN 0.15 ELSE 0 END::DOUBLE
      + CASE WHEN i % 11 = 0 THEN -0.1 ELSE 0 END::DOUBLE + CASE WHEN i % 13 = 0 THEN 0.25 ELSE 0 END::DOUBLE)), 3)::DOUBLE AS base_load
  FROM zn0
)"""


@query("WITH " + _GENERATED + " SELECT zone_id, latitude, longitude, base_load FROM zn")
def generated_zones(spark, sf_dir):
    return generate_zones(spark, 25)


def _int32(x: str) -> str:
    low = f"((({x})::BIGINT % 4294967296 + 4294967296) % 4294967296)"
    return f"(CASE WHEN {low} >= 2147483648 THEN {low} - 4294967296 ELSE {low} END)"


def _random_sql(source: str, seed: str, keep: str) -> str:
    """CTEs h1..h4 from source: r is the pseudo-random value of seed."""
    times = " * 73244475::DOUBLE"
    half = "xor(floor(a / 65536.0)::BIGINT, a)"
    return f"""h1 AS (SELECT {keep}, ({seed})::BIGINT AS a FROM {source}),
h2 AS (SELECT {keep}, {_int32(f"{half}::DOUBLE{times}")} AS a FROM h1), h3 AS (SELECT {keep}, {_int32(f"{half}::DOUBLE{times}")} AS a FROM h2),
h4 AS (SELECT {keep}, {half} AS a FROM h3), hr AS (SELECT {keep}, (CASE WHEN a < 0 THEN a + 4294967296 ELSE a END)::DOUBLE / 4294967295::DOUBLE AS r FROM h4)"""


@query("WITH " + _random_sql("(SELECT unnest(range(0, 10000)) AS seed)", "seed", "seed") + " SELECT seed, r FROM hr")
def seeded_noise(spark, sf_dir):
    return spark.range(10_000).select(F.col("id").alias("seed"), scalar.pseudo_random(F.col("id")).alias("r"))


_DAILY = "CASE WHEN h BETWEEN 9 AND 17 THEN 0.15 WHEN h BETWEEN 18 AND 22 THEN 0.05 WHEN h >= 23 OR h <= 5 THEN -0.2 ELSE -0.1 END::DOUBLE"


@query(f"SELECT h::INT AS hour, {_DAILY} AS factor FROM (SELECT (i * 1800000 + {START}) // 3600000 % 24 AS h FROM (SELECT unnest(range(0, 48)) AS i))")
def daily_factor(spark, sf_dir):
    hour = scalar.hour_of(F.col("id") * 1_800_000 + START)
    return spark.range(48).select(hour.alias("hour"), scalar.daily_factor(hour).alias("factor"))


_TICKS = _GENERATED + f""", tk AS (
  SELECT i AS tick, zone_id, num, base_load, {START} + i * 7 AS produced_at, 1 + num % 20 AS step
  FROM zn, (SELECT unnest(range(0, 400)) AS i)
), ck AS (
  SELECT *, tick * 1000000 + num AS seq, min(produced_at - tick * step) OVER (PARTITION BY zone_id ORDER BY tick ROWS UNBOUNDED PRECEDING) + tick * step AS t FROM tk
), """


@query("WITH " + _TICKS + _random_sql("ck", "(num * 137 + t // 1000) % 10000", "seq, zone_id, t, produced_at, base_load") + f"""
SELECT seq, zone_id, t, produced_at, floor(greatest(0.0, least(1.0, least(1.0, base_load + 0.5::DOUBLE) * (1 + {_DAILY} + (r - 0.5::DOUBLE) * 0.1::DOUBLE))) * 1000 + 0.5::DOUBLE)::BIGINT AS load_milli
FROM (SELECT *, t // 3600000 % 24 AS h FROM hr)""")
def generated_events(spark, sf_dir):
    rows = generate_events(generate_zones(spark, 25), 400, START, 7, "spike")
    return rows.select("seq", "zone_id", "t", "produced_at", scalar.milli(F.col("load")).alias("load_milli"))


_LE = ", ".join(f"sum(CASE WHEN gap <= {b} THEN 1 ELSE 0 END)::BIGINT AS le_{b}" for b in metrics.BOUNDS)


@query("WITH " + _IN_ORDER + f""" SELECT zone_id, {_LE}, sum(gap)::BIGINT AS total, count(*) AS count
FROM (SELECT zone_id, t - lag(t) OVER (PARTITION BY zone_id ORDER BY seq) AS gap FROM ev) WHERE gap IS NOT NULL GROUP BY zone_id""")
def gap_histogram(spark, sf_dir):
    return metrics.histogram(metrics.gaps(zone_events(spark, sf_dir)), F.col("gap"), "zone_id")


@query("WITH " + _IN_ORDER + """ SELECT zone_id, count(*) AS events, (max(t) - min(t))::BIGINT AS elapsed_ms,
CASE WHEN max(t) > min(t) THEN count(*)::DOUBLE * 1000 / (max(t) - min(t)) ELSE 0 END AS events_per_second FROM ev GROUP BY zone_id""")
def throughput(spark, sf_dir):
    return metrics.throughput(zone_events(spark, sf_dir), "zone_id")


@query(_TR + _LATEST + f""", z AS (SELECT zone_id, t, {_AVERAGES}, count(*) OVER (PARTITION BY zone_id) AS events, row_number() OVER (PARTITION BY zone_id ORDER BY seq DESC) AS r FROM sc)
SELECT z.zone_id, coalesce(state, 'NORMAL') AS state, round(z.avg1m, 3) AS avg1m, round(z.avg5m, 3) AS avg5m, t, events FROM z LEFT JOIN lt ON z.zone_id = lt.zone_id WHERE r = 1""")
def zone_summary(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    return metrics.zone_summary(scored, transitions.transitions(scored))


@query("WITH " + _GENERATED + " SELECT zone_id, latitude, longitude, base_load FROM zn WHERE num <= 5")
def first_zones(spark, sf_dir):
    return generator.first_zones(generate_zones(spark, 25))


@query("WITH " + _IN_ORDER + " SELECT zone_id, count(*) AS value FROM ev GROUP BY zone_id")
def events_processed(spark, sf_dir):
    return metrics.counter(zone_events(spark, sf_dir), "zone_id")


@query("SELECT route, count(*) AS value FROM (SELECT CASE WHEN p LIKE '/zones/%' THEN '/zones/:zoneId' WHEN p LIKE '/alerts/%' THEN '/alerts/:zoneId' WHEN p LIKE '/analytics/zones/%' AND p LIKE '%/alerts%' THEN '/analytics/zones/:zoneId/alerts' ELSE p END AS route FROM (SELECT CASE user_id % 6 WHEN 0 THEN '/zones' WHEN 1 THEN concat('/zones/Z-', user_id) WHEN 2 THEN concat('/alerts/Z-', user_id) WHEN 3 THEN concat('/analytics/zones/Z-', user_id, '/alerts') WHEN 4 THEN '/analytics/zones/top-critical' ELSE '/health' END AS p FROM events)) GROUP BY route")
def requests_by_route(spark, sf_dir):
    n = F.col("user_id").cast("string")
    path = (
        F.when(F.col("user_id") % 6 == 0, "/zones").when(F.col("user_id") % 6 == 1, F.concat(F.lit("/zones/Z-"), n))
        .when(F.col("user_id") % 6 == 2, F.concat(F.lit("/alerts/Z-"), n)).when(F.col("user_id") % 6 == 3, F.concat(F.lit("/analytics/zones/Z-"), n, F.lit("/alerts")))
        .when(F.col("user_id") % 6 == 4, "/analytics/zones/top-critical").otherwise("/health")
    )
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(path.alias("path"))
    return metrics.counter(rows.select(scalar.route_name(F.col("path")).alias("route")), "route")


@query("""SELECT method, route, status, count(*) AS value FROM (SELECT CASE WHEN user_id % 5 = 0 THEN 'HEAD' ELSE 'GET' END AS method,
CASE user_id % 3 WHEN 0 THEN '/zones' WHEN 1 THEN '/zones/:zoneId' ELSE '/alerts/:zoneId' END AS route, CASE WHEN event_id % 50 = 0 THEN 404 ELSE 200 END::INT AS status FROM events) GROUP BY ALL""")
def requests_total(spark, sf_dir):
    n = F.col("user_id").cast("string")
    path = F.when(F.col("user_id") % 3 == 0, "/zones").when(F.col("user_id") % 3 == 1, F.concat(F.lit("/zones/Z-"), n)).otherwise(F.concat(F.lit("/alerts/Z-"), n))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.when(F.col("user_id") % 5 == 0, "HEAD").otherwise("GET").alias("method"), scalar.route_name(path).alias("route"),
        F.when(F.col("event_id") % 50 == 0, 404).otherwise(200).alias("status"),
    )
    return metrics.counter(rows, "method", "route", "status")


@query("WITH " + _LATE_SCORED + " SELECT zone_id, seq, t, load_milli, sum60, count60, sum300, count300 FROM sc")
def late_events_scored(spark, sf_dir):
    return transitions.scored_in_arrival_order(zone_events(spark, sf_dir, late=True))


@query("WITH RECURSIVE " + _LATE_SCORED + _MACHINE + " SELECT * FROM tr")
def late_transitions(spark, sf_dir):
    return transitions.transitions(transitions.scored_in_arrival_order(zone_events(spark, sf_dir, late=True)))


@query("WITH RECURSIVE " + _LATE_SCORED + _MACHINE + " SELECT * FROM tr")
def stream_transitions(spark, sf_dir):
    """The stream run to the end of its source; what it wrote."""
    folder = fresh_folder(spark, "stream")
    pipeline.start(zone_event_stream(spark, sf_dir, late=True), folder, folder.rsplit("/", 1)[1]).awaitTermination()
    return spark.read.parquet(f"{folder}/transitions").drop("batch", "latitude", "longitude")


@query("WITH RECURSIVE " + _LATE_SCORED + _MACHINE + " SELECT * FROM tr")
def transitions_in_any_order(spark, sf_dir):
    """Events that may come late, by whichever form of the windows holds for them."""
    return transitions.transitions(transitions.scored(zone_events(spark, sf_dir, late=True)))


_RAN: dict[tuple[str, str], str] = {}


def _streamed(spark: SparkSession, sf_dir: str, files: int = 4) -> str:
    """The folder that the stream wrote from the events as JSON messages, in several micro-batches; run once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RAN:
        folder = fresh_folder(spark, "live")
        zones = generate_zones(spark, ZONES).select("zone_id", "latitude", "longitude")
        rows = zone_events(spark, sf_dir).join(zones, "zone_id")
        rows = rows.select(
            F.col("seq").cast("string").alias("eventId"), F.col("zone_id").alias("zoneId"), "latitude", "longitude",
            (F.col("load_milli") / 1000).alias("load"), F.col("t").alias("eventTimestamp"), F.col("t").alias("producedAt"), F.col("seq").alias("offset"),
        )
        last = rows.agg(F.max("offset")).first()[0] or 0
        for k in range(files):
            part = rows.filter((F.col("offset") > last * k // files - (k == 0)) & (F.col("offset") <= last * (k + 1) // files))
            decode.sent(decode.encoded_events(part).coalesce(1), f"{folder}/in")
        query = pipeline.start_from_messages(spark, f"{folder}/in", folder, folder.rsplit("/", 1)[1])
        query.awaitTermination()
        _RAN[key] = folder
    return _RAN[key]


@query(_TR + " SELECT zone_id, previous_state, current_state, avg1m, avg5m, t FROM al")
def stream_alerts(spark, sf_dir):
    """The alert messages that the stream published, decoded again."""
    rows = pipeline.published_alerts(spark, _streamed(spark, sf_dir))
    return rows.select(
        F.col("zoneId").alias("zone_id"), F.col("previousState").alias("previous_state"), F.col("currentState").alias("current_state"),
        "avg1m", "avg5m", F.col("timestamp").alias("t"),
    )


@query(_TR + _LATEST + _ZONES + " SELECT * FROM lo")
def stream_latest(spark, sf_dir):
    return sinks.read_latest(spark, f"{_streamed(spark, sf_dir)}/latest")


@query(_TR + _LATEST + _ZONES + f" SELECT zone_id, state, round({_AWAY}, 3) AS distance_km FROM lo WHERE {_AWAY} <= 12000")
def stream_zones_near(spark, sf_dir):
    rows = api.zones_near(stream_latest(spark, sf_dir), 10.0, 30.0, 12_000.0)
    return rows.select("zone_id", "state", F.round("distance_km", 3).alias("distance_km"))


@query(_TR + _LATEST + _ZONES + " SELECT * FROM lo WHERE zone_id = 'Z-3'")
def stream_zone_by_id(spark, sf_dir):
    return api.zone(stream_latest(spark, sf_dir), "Z-3")


@query(_TR + f" SELECT * EXCLUDE (zone_id) FROM ({_HISTORY}) WHERE zone_id = 'Z-1' AND timestamp BETWEEN {START + 600_000} AND {START + 3_000_000} ORDER BY timestamp, id")
def stream_history(spark, sf_dir):
    first, last = START + 600_000, START + 3_000_000
    return api.history(sinks.read_history(spark, f"{_streamed(spark, sf_dir)}/history", first, last), "Z-1", first, last)


@query(_TR + """ SELECT 'state_transitions_total{from="' || previous_state || '",to="' || current_state || '"} ' || count(*) AS line FROM tr GROUP BY previous_state, current_state
UNION ALL SELECT name || ' ' || n AS line FROM (SELECT count(*) AS n FROM al), (SELECT unnest(['alerts_published_total', 'alerts_consumed_total',
  'alerts_persisted_total{storage="lists"}', 'alerts_persisted_total{storage="history"}']) AS name)""")
def metrics_exposition(spark, sf_dir):
    return metrics.exposition(pipeline.counters(spark, _streamed(spark, sf_dir)))
