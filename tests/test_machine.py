import random

import pytest

from loadlens.operators.machine import SlidingWindow, ZoneState, flags, next_by_average, should_alert, step

T = 1_000_000


def window(*events, size=60):
    w = SlidingWindow(size)
    for t, load in events:
        w.add(t, load)
    return w


@pytest.mark.parametrize(
    ("events", "size", "buckets", "total", "count", "duration"),
    [
        ([], 60, 0, 0, 0, 0),
        ([(T, 0.5)], 60, 1, 0.5, 1, 0),
        ([(T, 0.3), (T, 0.7)], 60, 1, 1.0, 2, 0),
        ([(T, 0.5), (999_500, 0.3)], 60, 2, 0.8, 2, 1),
        ([(930_000, 0.5), (T, 0.3)], 60, 1, 0.3, 1, 0),
        ([(T, 0.5), (1_001_000, 0.3), (1_002_000, 0.2)], 60, 3, 1.0, 3, 2),
        ([(T, 0.5), (1_005_000, 0.1)], 60, 2, 0.6, 2, 5),
        ([(1_005_000, 0.5), (T, 0.1)], 60, 2, 0.6, 2, 5),
        ([(600_000, 0.5), (T, 0.3)], 300, 1, 0.3, 1, 0),
        ([(T, 0.0)], 60, 1, 0, 1, 0),
        ([(T, -0.5)], 60, 1, -0.5, 1, 0),
        ([(940_000, 0.5), (T, 0.3)], 60, 1, 0.3, 1, 0),
        ([(940_999, 0.5), (1_000_999, 0.3)], 60, 1, 0.3, 1, 0),
        ([(941_000, 0.5), (T, 0.3)], 60, 2, 0.8, 2, 59),
    ],
)
def test_window(events, size, buckets, total, count, duration):
    w = window(*events, size=size)
    assert (len(w.buckets), w.count, w.duration) == (buckets, count, duration)
    assert w.total == pytest.approx(total) and w.average == pytest.approx(total / count if count else 0)


def test_bucket_key():
    assert list(window((1_000_999, 0.5)).buckets) == [1000]


@pytest.mark.parametrize(
    ("start", "calls", "state", "stressed", "critical"),
    [
        ("NORMAL", [(0.5, 0.8, 0)], "NORMAL", 0, None),
        ("NORMAL", [(0.5, 0.8, 0), (0.5, 0.8, 59_999)], "NORMAL", 0, None),
        ("NORMAL", [(0.5, 0.8, 0), (0.5, 0.8, 60_000)], "STRESSED", None, None),
        ("NORMAL", [(0.5, 0.75, 7)], "NORMAL", 7, None),
        ("NORMAL", [(0.5, 0.7, 0)], "NORMAL", None, None),
        ("NORMAL", [(0.5, 0.8, 0), (0.5, 0.7, 30_000)], "NORMAL", None, None),
        ("STRESSED", [(0.92, 0.8, 0)], "STRESSED", None, 0),
        ("STRESSED", [(0.90, 0.8, 0), (0.90, 0.8, 20_000)], "CRITICAL", None, None),
        ("STRESSED", [(0.92, 0.8, 0), (0.92, 0.8, 19_999)], "STRESSED", None, 0),
        ("STRESSED", [(0.92, 0.8, 0), (0.5, 0.7, 5)], "STRESSED", None, None),
        ("STRESSED", [(0.4, 0.65, 0)], "NORMAL", None, None),
        ("STRESSED", [(0.92, 0.6, 0)], "STRESSED", None, 0),
        ("CRITICAL", [(0.4, 0.80, 3)], "STRESSED", 3, None),
        ("CRITICAL", [(0.95, 0.81, 0)], "CRITICAL", None, None),
        ("ODD", [(0.5, 0.5, 0)], "NORMAL", None, None),
    ],
)
def test_states(start, calls, state, stressed, critical):
    z = ZoneState(start)
    for avg1m, avg5m, t in calls:
        z.state = next_by_average(z, avg1m, avg5m, t)
    assert (z.state, z.stressed_since, z.critical_since) == (state, stressed, critical)


@pytest.mark.parametrize(("before", "after", "last", "t", "alert"), [
    ("NORMAL", "STRESSED", None, 0, True), ("NORMAL", "NORMAL", None, 0, False), ("NORMAL", "STRESSED", 10_000, 10_500, False),
    ("NORMAL", "STRESSED", 10_000, 11_000, False), ("NORMAL", "STRESSED", 10_000, 11_001, True), ("NORMAL", "STRESSED", 10_000, 5_000, False),
])
def test_alert_gate(before, after, last, t, alert):
    assert should_alert(before, after, last, t) is alert


def test_flapping_suppresses_the_way_down():
    z = ZoneState("STRESSED", None, 0)
    up = step(z, 20_000, *flags(900, 1, 800, 1))
    down = step(z, 20_500, *flags(900, 1, 800, 1))
    assert up == ("STRESSED", "CRITICAL", True) and down == ("CRITICAL", "STRESSED", False) and z.last_alert == 20_000


def test_window_equals_its_set_definition():
    rng = random.Random(8)
    for size in (60, 300):
        w, secs, t = SlidingWindow(size), [], T
        for _ in range(1500):
            t += rng.randint(0, 9000)
            now = t - rng.choice([0, 0, 0, 90_000, 400_000])
            load = rng.randrange(1000)
            w.add(now, load)
            secs.append((now // 1000, load))
            most, inside = None, []
            for k in range(len(secs) - 1, -1, -1):
                if most is None or secs[k][0] > most - size:
                    inside.append(secs[k][1])
                most = secs[k][0] if most is None else max(most, secs[k][0])
            assert (w.total, w.count) == (sum(inside), len(inside))
