"""The state machine of a zone: NORMAL, STRESSED, CRITICAL, with dwell times, and the alert gate.

Plain Python and free of Spark: the batch fold and the stream share it. Limits include their own value.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

# Thresholds of the averages, dwell times and the cooldown in milliseconds.
STRESSED_FROM, STRESSED_TO = 0.75, 0.65
CRITICAL_FROM, CRITICAL_TO = 0.90, 0.80
STRESSED_DWELL, CRITICAL_DWELL = 60_000, 20_000
COOLDOWN = 1_000


@dataclass
class ZoneState:
    state: str = "NORMAL"
    stressed_since: int | None = None
    critical_since: int | None = None
    last_alert: int | None = None
    windows: dict = field(default_factory=dict)


def next_state(z: ZoneState, t: int, high5: bool, high1: bool, low5: bool, below5: bool) -> str:
    """The state after an event at t; sets z's timers, not its state.

    high5: 5-minute average at STRESSED_FROM or more; high1: 1-minute average at CRITICAL_FROM or more; low5: 5-minute
    average at STRESSED_TO or less; below5: at CRITICAL_TO or less.
    """
    if z.state == "NORMAL":
        if not high5:
            z.stressed_since = None
            return "NORMAL"
        if z.stressed_since is None:
            z.stressed_since = t
        if t - z.stressed_since < STRESSED_DWELL:
            return "NORMAL"
        z.stressed_since = None
        return "STRESSED"
    if z.state == "STRESSED":
        if high1:
            if z.critical_since is None:
                z.critical_since = t
            if t - z.critical_since < CRITICAL_DWELL:
                return "STRESSED"
            z.critical_since = None
            return "CRITICAL"
        z.critical_since = None
        if low5:
            z.stressed_since = None
            return "NORMAL"
        return "STRESSED"
    if z.state == "CRITICAL":
        if below5:
            z.critical_since, z.stressed_since = None, t
            return "STRESSED"
        return "CRITICAL"
    return "NORMAL"


def next_by_average(z: ZoneState, avg1m: float, avg5m: float, t: int) -> str:
    return next_state(z, t, avg5m >= STRESSED_FROM, avg1m >= CRITICAL_FROM, avg5m <= STRESSED_TO, avg5m <= CRITICAL_TO)


def should_alert(before: str, after: str, last: int | None, t: int) -> bool:
    return before != after and (last is None or t - last > COOLDOWN)


def step(z: ZoneState, t: int, high5: bool, high1: bool, low5: bool, below5: bool) -> tuple[str, str, bool] | None:
    """Moves z by one event; (previous state, state, alerted) on a change, else None. A suppressed alert changes state too."""
    before = z.state
    after = next_state(z, t, high5, high1, low5, below5)
    if after == before:
        return None
    alerted = should_alert(before, after, z.last_alert, t)
    if alerted:
        z.last_alert = t
    z.state = after
    return before, after, alerted


class SlidingWindow:
    """Second buckets of one window size in order of arrival: an event first evicts by its own second, then counts."""

    def __init__(self, size: int, buckets: dict[int, list] | None = None):
        self.size = size
        self.buckets = buckets if buckets is not None else {}
        self.total = sum(s for s, _ in self.buckets.values())
        self.count = sum(n for _, n in self.buckets.values())
        self.oldest = min(self.buckets, default=None)

    def add(self, t: int, load) -> None:
        sec = t // 1000
        limit = sec - self.size
        if self.oldest is not None and self.oldest <= limit:
            for old in [s for s in self.buckets if s <= limit]:
                gone, n = self.buckets.pop(old)
                self.total -= gone
                self.count -= n
            self.oldest = min(self.buckets, default=None)
        bucket = self.buckets.setdefault(sec, [0, 0])
        bucket[0] += load
        bucket[1] += 1
        self.total += load
        self.count += 1
        self.oldest = sec if self.oldest is None else min(self.oldest, sec)

    @property
    def average(self) -> float:
        return self.total / self.count if self.count else 0

    @property
    def duration(self) -> int:
        return max(self.buckets) - min(self.buckets) if self.buckets else 0


def flags(sum60, count60, sum300, count300) -> tuple:
    """The four comparisons on milli-load sums (numbers or arrays), exact in whole numbers."""
    return sum300 >= 750 * count300, sum60 >= 900 * count60, sum300 <= 650 * count300, sum300 <= 800 * count300


def run(z: ZoneState, t: np.ndarray, s60: np.ndarray, n60: np.ndarray, s300: np.ndarray, n300: np.ndarray) -> Iterator[tuple[int, str, str, bool]]:
    """``step`` over a zone's events in order: (place, previous state, state, alerted) of the changes.

    Events with equal comparisons make a run; within one the machine either stays as it is, or moves at the first event
    that is late enough, so the events between are never looked at one by one."""
    high5, high1, low5, below5 = flags(s60, n60, s300, n300)
    code = high5 * 8 + high1 * 4 + low5 * 2 + below5
    ends = np.r_[np.flatnonzero(code[1:] != code[:-1]) + 1, len(code)].tolist() if len(code) else []
    at = 0
    for end in ends:
        own = tuple(bool(x[at]) for x in (high5, high1, low5, below5))
        while at < end:
            if change := step(z, int(t[at]), *own):
                yield at, *change
                at += 1
                continue
            since, dwell = None, 0
            if z.state == "NORMAL" and own[0]:
                since, dwell = z.stressed_since, STRESSED_DWELL
            elif z.state == "STRESSED" and own[1]:
                since, dwell = z.critical_since, CRITICAL_DWELL
            if since is None:
                break
            due = np.flatnonzero(t[at + 1 : end] - since >= dwell)
            if not len(due):
                break
            at += 1 + int(due[0])
        at = end
