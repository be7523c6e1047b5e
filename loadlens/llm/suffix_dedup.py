"""Exact substring dedup: bytes inside a 50-byte string that also starts in an earlier document go.

The strings are compared through suffix arrays built in linear passes over Lyndon groups: suffixes are grouped by first
symbol, groups are taken in descending order, and each member extends the prefix of its previous smaller suffix, which
moves that one up within its group; when all groups are done, suffixes with equal Lyndon prefixes stand together, and
the array is emitted group by group, each suffix when the one behind its Lyndon prefix has been. Nothing is renamed or
sorted again. Many texts are taken through these passes side by side, each its own highest group at a time.

To spread the work, every 50-byte window is dealt to the smallest hash of its 16-byte strings (its anchor): equal
windows have equal anchors, and windows that follow one another with one anchor form a segment. Anchors that no other
document holds can't matter and are found by ``exchange``; of an anchor that very many chunks hold the windows are dealt
again, by the smallest hash of their 32-byte strings. A chunk sends each distinct segment once, with the first and the
last of its documents; what may recur among an anchor's segments (hashes of 32-byte strings tell what can't) makes one
text with one suffix array, and neighbours in it that agree for 50 bytes make a class, whose earliest document decides: a
window goes from every later one. Hashes only deal work out; equality is the suffix array's alone.

Defined cases: a null text counts as empty; texts shorter than a window lose nothing; a row with a null doc_id is
earlier or later than none and is kept whole; rows that repeat a doc_id are judged one by one, each by its own text,
against the texts of all rows with a smaller doc_id; long texts are hashed piece by piece; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import written
from .exchange import COMMON, Distinct, by_part, chunked, dealt, heads, marked, part_edges, parts_for, ranked, shared, slices, spread, texts_of, widths

WINDOW = 50
ANCHOR = 16
#: Of windows whose anchor is common.
WIDE_ANCHOR = 32
#: Symbols and texts that go through suffix arrays at once, about: that many of both, or MOST symbols.
BLOCK, TEXTS, MOST = 300_000, 2_000, 1_000_000
#: Symbols that one text alone is taken through in the time of a step of many texts side by side, and in that of a symbol there.
STEP, BESIDE = 10, 0.2
#: Symbols of one anchor's segments above which only what may recur among them is compared, judged by such strings; bytes
#: that are judged at once, about.
LONG, PROBE, JUDGED = 0, 32, 100_000
#: Windows that are hashed at once.
PIECE = 1 << 20
#: Strings of twice the length are hashed from two halves, each time with another odd factor.
FACTORS = ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9), (8, 0xD6E8FEB86659FD93), (16, 0xA0761D6478BD642F))


def compact(numbers: np.ndarray) -> array:
    return array("i", numbers.astype(np.int32).tobytes())


def lyndon_groups(text: np.ndarray) -> tuple[array, array]:
    """(group, length) per suffix: groups ascend as the Lyndon prefixes do; length is that of the Lyndon prefix."""
    n = len(text)
    at = np.argsort(np.asarray(text), kind="stable")
    members_of = compact(at)
    place = np.empty(n, np.int64)
    place[at] = np.arange(n)
    symbols = np.asarray(text)[at]
    first = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])[: n or 0]
    width = np.diff(np.r_[first, n])
    start = np.empty(n, np.int64)
    start[at] = np.repeat(first, width)
    sizes = np.zeros(n, np.int64)
    sizes[first] = width
    size, group, pos, length, smaller = map(compact, (sizes, start, place, np.ones(n), np.full(n, -1)))

    def lift(members: list[int], old: int) -> None:
        """Makes members of the old group a group of their own, right above what is left of it."""
        k = size[old]
        if len(members) == k:
            return
        new = end = old + k
        for i in members:
            new -= 1
            a, other = pos[i], members_of[new]
            members_of[a], members_of[new] = other, i
            pos[other], pos[i] = a, new
        size[old], size[new] = k - len(members), end - new
        for i in members:
            group[i] = new

    end = n
    while end:
        here = group[members_of[end - 1]]
        if end - here == 1:
            i = members_of[here]
            j = i - 1
            while j >= 0 and group[j] >= here:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                length[j] += length[i]
                old = group[j]
                k = size[old]
                if k > 1:
                    last = old + k - 1
                    a, other = pos[j], members_of[last]
                    members_of[a], members_of[last] = other, j
                    pos[other], pos[j] = a, last
                    size[old], size[last] = k - 1, 1
                    group[j] = last
        else:
            members = sorted(members_of[here:end])
            step = length[members[0]]
            times: dict[int, int] = {}
            for i in members:
                j = i - 1
                while j >= 0 and group[j] >= here:
                    j = smaller[j]
                smaller[i] = j
                if j >= 0:
                    times[j] = times.get(j, 0) + 1
            moved: dict[tuple[int, int], list[int]] = {}
            for j, k in times.items():
                length[j] += k * step
                moved.setdefault((-k, group[j]), []).append(j)
            for (_, old), some in sorted(moved.items()) if len(moved) > 1 else moved.items():
                lift(some, old)
        end = here
    return group, length


def suffix_array(text: np.ndarray) -> array:
    """All suffixes in order; a suffix that is a prefix of another comes first."""
    n = len(text)
    group, length = lyndon_groups(text)
    ends = np.arange(n) + np.frombuffer(length, np.int32)
    by_end = np.argsort(ends, kind="stable")
    from_end = compact(np.searchsorted(ends[by_end], np.arange(n + 2)))
    by_end = compact(by_end)
    out, free = compact(np.zeros(n)), compact(np.arange(n))
    for i in by_end[from_end[n] :]:
        g = group[i]
        out[free[g]] = i
        free[g] += 1
    for p in out:  # it grows ahead of the loop
        a, b = from_end[p], from_end[p + 1]
        while a < b:
            i = by_end[a]
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            a += 1
    return out


def lyndon_groups_of_many(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``lyndon_groups`` of many texts laid end to end: each step takes every text's highest group that is left.

    Symbols lie below 2^48; there may be 2^15 texts."""
    n = len(symbols)
    begin = np.cumsum(sizes) - sizes
    key = np.repeat(np.arange(len(sizes)) << 48, sizes) | symbols
    array = np.argsort(key)
    key = key[array]
    place = np.empty(n, np.int64)
    place[array] = np.arange(n)
    first = np.flatnonzero(heads(key))
    width = widths(first, n)
    size = np.zeros(n, np.int64)
    size[first] = width
    group = np.empty(n, np.int64)
    group[array] = np.repeat(first, width)
    length, smaller, slot = np.ones(n, np.int64), np.full(n, -1, np.int64), np.empty(n, np.int64)
    lifted, starts = np.zeros(n, bool), np.zeros(n, bool)
    starts[begin] = True
    low, end = begin, begin + sizes
    while len(end):
        top = array[end - 1]
        here = group[top]
        many, step = end - here, length[top]
        alone = many.max() == 1
        members, floor = top, here
        if not alone:
            members = array[spread(here, many)]
            floor, step = here.repeat(many), step.repeat(many)
        j = members - 1
        j[starts[members]] = -1
        go = (j >= 0).nonzero()[0]
        go = go[group[j[go]] > floor[go]]
        while len(go):
            j[go] = smaller[j[go]]
            go = go[j[go] >= 0]
            go = go[group[j[go]] > floor[go]]
        if not alone:
            near = (j >= 0).nonzero()[0]
            near = near[group[j[near]] == floor[near]]
            if len(near):  # another member stands before: what is smaller than that one, by doubling
                slot[members] = np.arange(len(members))
                jump = np.arange(len(members))
                jump[near] = slot[j[near]]
                while not np.array_equal(jump, further := jump[jump]):
                    jump = further
                j = j[jump]
        smaller[members] = j
        on = j >= 0
        up, step = j[on], step[on]
        if alone:
            times = np.ones(len(up), np.int64)
        else:
            order = up.argsort()
            up, step = up[order], step[order]
            each = heads(up).nonzero()[0]
            times = widths(each, len(up))
            up, step = up[each], step[each]
        length[up] += times * step
        old = group[up]
        parted = size[old] > 1
        up, old, times = up[parted], old[parted], times[parted]
        if alone and len(up):
            last = old + size[old] - 1
            other, at = array[last], place[up]
            array[at], array[last] = other, up
            place[other], place[up] = at, last
            size[old] -= 1
            size[last] = 1
            group[up] = last
        elif len(up):
            # what is extended more often stands higher among what is lifted from one group
            rank = old * (n + 1) + times
            order = rank.argsort()
            up, old, rank = up[order], old[order], rank[order]
            each = heads(old).nonzero()[0]
            taken = widths(each, len(up))
            left = size[old[each]] - taken
            tail = (old[each] + left).repeat(taken)
            to, at = tail + np.arange(len(up)) - each.repeat(taken), place[up]
            lifted[up] = True
            stay = array[to]
            stay = stay[~lifted[stay]]
            lifted[up] = False
            holes = at[at < tail]
            array[holes], place[stay] = stay, holes
            array[to], place[up] = up, to
            cut = heads(rank).nonzero()[0]
            width = widths(cut, len(up))
            size[old[each]] = left
            size[to[cut]] = width
            group[up] = to[cut].repeat(width)
        end = here
        more = end > low
        if not more.all():
            low, end = low[more], end[more]
    return group, length


def suffix_arrays(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffix arrays of texts laid end to end, as places in the whole; one suffix of each text is emitted a step."""
    n, number = len(symbols), np.arange(len(sizes))
    group, length = lyndon_groups_of_many(symbols, sizes)
    # texts are set one apart, so that the end of one isn't the start of the next
    ends = np.arange(n) + length + np.repeat(number, sizes)
    by_end = np.argsort(ends, kind="stable")
    count = np.bincount(ends, minlength=n + len(sizes) + 1)
    first = np.cumsum(count) - count
    out, free = np.empty(n, np.int64), np.arange(n)
    stop = np.cumsum(sizes)
    at, behind = stop - sizes, stop
    while len(at):
        behind = behind + number
        many = count[behind]
        if many.max() <= 1:
            here = by_end[first[behind[many == 1]]]
        else:
            here = by_end[spread(first[behind], many)]
        own = group[here]
        out[free[own]] = here
        free[own] += 1
        more = at < stop
        if not more.all():
            at, stop, number = at[more], stop[more], number[more]
        behind = out[at]
        at = at + 1
    return out


def anchors(text: bytes, window: int = WINDOW, width: int = ANCHOR) -> Iterator[np.ndarray]:
    """The anchor of every window, PIECE windows at a time."""
    for start in range(0, len(text) - window + 1, PIECE):
        h = np.frombuffer(text[start : start + PIECE + window - 1], np.uint8).astype(np.uint64) + np.uint64(1)
        for s, factor in FACTORS[: width.bit_length() - 1]:
            h = h[:-s] * np.uint64(factor) + h[s:]
            h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        left, s = window - width + 1, 1
        while 2 * s <= left:
            h = np.minimum(h[:-s], h[s:])
            s *= 2
        if left > s:
            h = np.minimum(h[: s - left], h[left - s :])
        yield h


def runs_of(pieces: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, first, count) of the runs of equal values in all pieces."""
    values, firsts, n = [], [], 0
    for h in pieces:
        cut = np.flatnonzero(np.r_[not values or values[-1][-1] != h[0], h[1:] != h[:-1]])
        if len(cut):
            values.append(h[cut])
            firsts.append(cut + n)
        n += len(h)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.concatenate(firsts)
    # smallest hashes are small; mixed again they spread over all parts
    value = np.concatenate(values) * np.uint64(0x94D049BB133111EB)
    return (value ^ (value >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15), first, np.diff(np.r_[first, n])


def segments(texts: list[bytes], width: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, first window, windows) of the runs of windows with one anchor, in all texts."""
    found = [runs_of(anchors(text, width=width)) for text in texts]
    of = np.repeat(np.arange(len(found)), [len(a) for a, _, _ in found])
    anchor, first, n = (np.concatenate([x[j] for x in found]) if found else np.empty(0, t) for j, t in enumerate((np.uint64, np.int64, np.int64)))
    return anchor, of, first, n


def _keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return segments(texts)[:2]


class Pieces:
    """The distinct segments of a chunk that other documents may hold, by rising anchor, and where they occur."""

    def __init__(self, texts: list[bytes], rank: np.ndarray, masks: list[dict], parts: int):
        anchor, row, first, n = segments(texts)
        own = Distinct(anchor, row)
        here, common = marked(own, masks, parts)
        here, common = here[own.of] & (rank[row] >= 0), common[own.of]
        if (here & common).any():
            anchor, row, first, n = self._dealt_again(texts, anchor, row, first, n, here, common)
        else:
            anchor, row, first, n = anchor[here], row[here], first[here], n[here]
        order = np.argsort(anchor, kind="stable")
        self.row, self.first = row[order], first[order]
        known: dict[tuple[int, bytes], int] = {}
        bodies = [texts[r][a : a + k + WINDOW - 1] for r, a, k in zip(self.row.tolist(), self.first.tolist(), n[order].tolist())]
        of = np.array([known.setdefault(x, len(known)) for x in zip(anchor[order].tolist(), bodies)], np.int64)
        self.key = np.fromiter((k for k, _ in known), np.uint64, len(known))
        self.body = [b for _, b in known]
        order = np.argsort(of, kind="stable")
        self.row, self.first = self.row[order], self.first[order]
        self.at = np.searchsorted(of[order], np.arange(len(known) + 1))
        mine = rank[self.row]
        self.least = np.minimum.reduceat(mine, self.at[:-1]) if len(known) else mine

    @staticmethod
    def _dealt_again(texts, anchor, row, first, n, here, common):
        """Windows with common anchors get the wider ones; a run ends where either kind does."""
        again, taken = [], here & common
        cuts = np.searchsorted(row, np.arange(len(texts) + 1))
        for r in np.unique(row[taken]).tolist():
            mine = slice(cuts[r], cuts[r + 1])
            hot = np.repeat(taken[mine], n[mine])
            wide, start, _ = runs_of(anchors(texts[r], width=WIDE_ANCHOR))
            edge = np.unique(np.r_[start, np.flatnonzero(hot[1:] != hot[:-1]) + 1])
            keep = hot[edge]
            again.append((wide[np.searchsorted(start, edge, "right") - 1][keep], np.full(int(keep.sum()), r), edge[keep], widths(edge, len(hot))[keep]))
        plain = here & ~common
        return tuple(np.concatenate([x[plain], *(y[j] for y in again)]) for j, x in enumerate((anchor, row, first, n)))


def recurring(texts: list[bytes], key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows) of the runs of windows all of whose PROBE-byte strings recur among texts with their key.

    Texts lie by key. A window that recurs passes, whatever the hashes; what a hash lets through by mistake, the suffix
    array parts."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    out, lo, done = [], 0, 0
    for hi in (*np.flatnonzero(heads(key))[1:].tolist(), len(texts)):
        if ends[hi - 1] - done >= JUDGED or hi == len(texts):
            of, first, n = _recurring(texts[lo:hi], key[lo:hi])
            out.append((of + lo, first, n))
            lo, done = hi, ends[hi - 1]
    of, first, n = (np.concatenate([x[j] for x in out]) for j in range(3))
    return of, first, n


def _recurring(texts: list[bytes], key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    h = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
    for s, factor in FACTORS:
        h = h[:-s] * np.uint64(factor) + h[s:]
        h ^= h >> np.uint64(31)
    h ^= key.repeat(sizes)[: len(h)]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(h)
    h = h[order]
    same = h[1:] == h[:-1]
    once = np.ones(len(h), bool)
    once[order[1:][same]] = False
    once[order[:-1][same]] = False
    missing = np.r_[0, np.cumsum(once)]
    probes = WINDOW - PROBE + 1
    good = missing[probes:] == missing[:-probes]
    good[spread(ends[:-1] - WINDOW + 1, np.full(len(ends) - 1, WINDOW - 1))] = False  # these reach into the next text
    edge = np.flatnonzero(np.diff(good.view(np.int8), prepend=0, append=0))
    first, n = edge[::2], edge[1::2] - edge[::2]
    of = np.searchsorted(ends, first, "right")
    return of, first - (ends - sizes)[of], n


def apart(sizes: np.ndarray) -> int:
    """How many of the longest of texts (sizes rising) go one by one, as side by side each step of the longest costs STEP."""
    longest = np.r_[sizes[::-1], 0]
    singly = np.r_[0, np.cumsum(sizes[::-1])]
    return int(np.argmin(singly + STEP * longest + BESIDE * (singly[-1] - singly)))


def earliest(
    key: np.ndarray, bodies: list[bytes], least: np.ndarray, times: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment, a, b, earliest document) of the runs of windows of segments (key, body, first document).

    Segments with one key are compared with each other, equal ones as one text, and of these only what may recur (times
    then says how many segments stand behind each)."""
    order = np.argsort(key, kind="stable")
    known: dict[tuple[int, bytes], int] = {}
    of = np.empty(len(key), np.int64)
    of[order] = [known.setdefault((k, bodies[i]), len(known)) for k, i in zip(key[order].tolist(), order.tolist())]
    first = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(first, of, least)
    texts = [b for _, b in known]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    keys = np.fromiter((k for k, _ in known), np.uint64, len(known))
    at = np.flatnonzero(heads(keys))
    whole = np.add.reduceat(sizes + 1, at)
    members = widths(at, len(texts))
    held, room, made = [], 0, [tuple(np.empty(0, np.int64) for _ in range(4))]
    # a group of one segment has nothing to be compared with
    number = np.bincount(of, times, len(texts)).astype(np.int64)
    compared = np.flatnonzero(np.add.reduceat(number, at) > 1)
    if times is None and (long := compared[whole[compared] > LONG]).size:
        compared = compared[whole[compared] <= LONG]
        which = spread(at[long], members[long])
        # what stands in one text only has that text's first document as its earliest
        several = which[number[which] > 1]
        made.append((several, np.zeros(len(several), np.int64), sizes[several] - WINDOW + 1, first[several]))
        owner, start, n = recurring([texts[i] for i in which.tolist()], keys[which])
        owner = which[owner]
        parts = [texts[i][x : x + k + WINDOW - 1] for i, x, k in zip(owner.tolist(), start.tolist(), n.tolist())]
        if parts:
            piece, a, b, early = earliest(keys[owner], parts, first[owner], number[owner])
            less = early < first[owner[piece]]
            piece, a, b, early = piece[less], a[less], b[less], early[less]
            made.append((owner[piece], a + start[piece], b + start[piece], early))
    for k in compared[np.argsort(whole[compared], kind="stable")].tolist():
        held.append(k)
        room += int(whole[k])
        if room >= MOST or (room >= BLOCK and len(held) >= TEXTS):
            made.append(_classes(held, at, members, whole, texts, sizes, first))
            held, room = [], 0
    if held:
        made.append(_classes(held, at, members, whole, texts, sizes, first))
    text, a, b, early = (np.concatenate([m[j] for m in made]) for j in range(4))
    order = np.lexsort((a, text))
    text, a, b, early = text[order], a[order], b[order], early[order]
    if len(text):  # runs that go on make one
        new = heads(text) | heads(early)
        new[1:] |= a[1:] != b[:-1]
        head = np.flatnonzero(new)
        text, a, b, early = text[head], a[head], b[head - 1 + widths(head, len(b))], early[head]
    low = np.searchsorted(text, of)
    many = np.searchsorted(text, of, "right") - low
    run = spread(low, many)
    return np.repeat(np.arange(len(of)), many), a[run], b[run], early[run]


def _classes(held, at, members, whole, texts, sizes, first):
    """(text, a, b, earliest document) for the texts of the groups held, each group by one suffix array."""
    many = members[held]
    which = spread(at[held], many)
    raw = np.frombuffer(b"\0".join([texts[i] for i in which.tolist()]) + bytes(9), np.uint8)
    size = sizes[which]
    n = int(size.sum()) + len(which)
    begin = np.cumsum(size + 1) - size - 1
    # a symbol is the next six bytes: the order of suffixes stays, and groups are small from the start
    symbols = (np.ndarray((n,), ">u8", raw, strides=(1,)).astype(np.uint64) >> np.uint64(16)).astype(np.int64)
    total = whole[held]
    start = np.cumsum(total) - total
    few = len(held) - apart(total)
    orders = [suffix_arrays(symbols[: start[few]] if few < len(held) else symbols, total[:few])] if few else []
    orders += [np.frombuffer(suffix_array(symbols[s : s + k]), np.int32).astype(np.int64) + s for s, k in zip(start[few:].tolist(), total[few:].tolist())]
    order = np.concatenate(orders)
    own = np.repeat(np.arange(len(which)), size + 1)
    group = np.repeat(np.arange(len(held)), many)
    order = order[order + WINDOW <= (begin + size)[own[order]]]
    words = np.ndarray((n,), "<u8", raw, strides=(1,))
    same = np.flatnonzero(group[own[order[1:]]] == group[own[order[:-1]]])
    for k in (*range(0, WINDOW - 8, 8), WINDOW - 8):
        same = same[words[order[same + 1] + k] == words[order[same] + k]]
    new = np.ones(len(order), bool)
    new[same + 1] = False
    cut = np.flatnonzero(new)
    least = np.minimum.reduceat(first[which][own[order]], cut)
    early = np.full(n + 1, -1)
    early[order] = np.repeat(least, np.diff(np.r_[cut, len(order)]))
    edge = np.flatnonzero(early[1:] != early[:-1]) + 1
    a = np.r_[0, edge]
    b = np.r_[edge, n]
    value = early[a]
    a, b, value = a[value >= 0], b[value >= 0], value[value >= 0]
    return which[own[a]], a - begin[own[a]], b - begin[own[a]], value


def learned(chunks: DataFrame, masks: DataFrame, parts: int) -> DataFrame:
    """(chunk, runs array<struct<part, piece, a, b, early>>): windows of a chunk's segments that a document earlier than the
    chunk's own first one with that segment starts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for k, (chunk, sizes, body, mask) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4)))):
                (rank,), values = ranked(batch.column(1)[k].values)
                own = Pieces(texts_of(sizes, body), rank, mask, parts)
                edges = part_edges(own.key, parts)
                some = np.flatnonzero(np.diff(edges))
                cuts = np.r_[edges[some], len(own.key)]
                size = np.fromiter(map(len, own.body), np.int32, len(own.body))
                columns = [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), chunk, np.int64))]
                columns += [slices(own.key, cuts, 8), slices(size, cuts, 4)]
                columns.append(pa.array([press.compress(b"".join(own.body[x:y])) for x, y in zip(cuts.tolist(), cuts[1:].tolist())], pa.binary()))
                columns.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), values.take(pa.array(own.least))))
                yield pa.RecordBatch.from_arrays(columns, names=["part", "chunk", "key", "size", "body", "least"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for part, held in by_part(batches):
            key = np.frombuffer(b"".join(x[2] for x in held), np.uint64)
            bodies = []
            for _, _, _, size, body, _ in held:
                body, ends = unpress.decompress(body), np.cumsum(np.frombuffer(size, np.int32)).tolist()
                bodies += [body[x:y] for x, y in zip([0, *ends], ends)]
            (least,), values = ranked(pa.array([x for row in held for x in row[5]], ids))
            piece, a, b, early = earliest(key, bodies, least)
            late = early < least[piece]  # else the chunk's own first document is the earliest
            piece, a, b, early = piece[late], a[late], b[late], early[late]
            cuts = np.searchsorted(piece, np.r_[0, np.cumsum([len(x[2]) // 8 for x in held])])
            some = np.flatnonzero(np.diff(cuts))
            start = np.r_[0, np.cumsum([len(x[2]) // 8 for x in held])]
            piece = piece - np.repeat(start[:-1], np.diff(cuts))
            edges = np.r_[cuts[some], cuts[-1]]
            columns = [pa.array([held[k][1] for k in some.tolist()], pa.int64()), pa.array(np.full(len(some), part, np.int32))]
            columns += [slices(x.astype(np.int32), edges, 4) for x in (piece, a, b)]
            columns.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), values.take(pa.array(early))))
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "part", "piece", "a", "b", "early"])

    kind = chunks.schema["ids"].dataType.elementType.simpleString()
    ids = to_arrow_type(chunks.schema["ids"].dataType.elementType)
    rows = chunks.join(masks, "chunk").select("chunk", "ids", "sizes", "body", "masks")
    sent = rows.mapInArrow(send, f"part int, chunk long, key binary, size binary, body binary, least array<{kind}>")
    found = dealt(sent, parts).mapInArrow(compare, f"chunk long, part int, piece binary, a binary, b binary, early array<{kind}>")
    return written(found.groupBy("chunk").agg(F.collect_list(F.struct("part", "piece", "a", "b", "early")).alias("runs")), "runs")


def spans_of(texts: list[bytes], ids: pa.Array, masks: list[dict], runs: list[dict], parts: int) -> list[list[tuple[int, int]]]:
    """For each text of a chunk the byte ranges to remove, unsorted."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    early = pa.array([x for r in runs for x in r["early"]], ids.type)
    (rank, early), _ = ranked(ids, early)
    own = Pieces(texts, rank, masks, parts)
    edges = part_edges(own.key, parts)
    piece, a, b = (np.concatenate([np.empty(0, np.int32), *(np.frombuffer(r[c], np.int32) for r in runs)]).astype(np.int64) for c in ("piece", "a", "b"))
    piece += np.repeat(*(np.array([f(r) for r in runs], np.int64) for f in (lambda r: edges[r["part"]], lambda r: len(r["early"]))))
    # where no earlier document is told, the segment's first one here is the earliest
    size = np.fromiter(map(len, own.body), np.int64, len(own.body)) - WINDOW + 1
    piece, a, b = np.r_[piece, np.arange(len(size))], np.r_[a, np.zeros(len(size), np.int64)], np.r_[b, size]
    early = np.r_[early, own.least]
    many = own.at[piece + 1] - own.at[piece]
    run = np.repeat(np.arange(len(piece)), many)
    place = spread(own.at[piece], many)
    row, first = own.row[place], own.first[place]
    late = early[run] < rank[row]
    row, first, run = row[late], first[late], run[late]
    for r, x, y in zip(row.tolist(), (first + a[run]).tolist(), (first + b[run] + WINDOW - 1).tolist()):
        out[r].append((x, y))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal runs removed)."""
    kept, removed, count, stop = [], 0, 0, -1
    end = 0
    for a, b in sorted(spans):
        if a > stop:
            count += 1
            kept.append(text[end:a])
            removed += b - a
        elif b > stop:
            removed += b - stop
        end = stop = max(stop, b)
    return b"".join([*kept, text[end:]]), removed, count


def deduplicated(docs: DataFrame, with_text: bool = False, common: int = COMMON) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunks = chunked(docs)
    parts = parts_for(chunks)
    masks = shared(chunks, _keys, parts, common)
    runs = learned(chunks, masks, parts)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (sizes, body, mask, found) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3, 4)))):
                ids, texts, made = batch.column(0)[k].values, texts_of(sizes, body), []
                for text, spans in zip(texts, spans_of(texts, ids, mask or [], found or [], parts)):
                    kept, removed, count = without(text, spans)
                    made.append((len(text), removed, count, hashlib.sha256(kept).hexdigest(), kept))
                columns = [ids, *(pa.array([m[j] for m in made], pa.int64()) for j in range(3)), pa.array([m[3] for m in made], pa.string())]
                columns += [pa.array([m[4] for m in made], pa.binary())] * with_text
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = chunks.join(masks, "chunk", "left").join(runs, "chunk", "left").select("ids", "sizes", "body", "masks", "runs")
    made = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return rows.mapInArrow(run, made)


def op3_suffix_array(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return deduplicated(read(spark, sf_dir, "documents"))


#: Bytes are pairs of hexadecimal digits here, as SQL has no substrings of binary values.
OP3_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT rid, doc_id, i, substring(h, 2 * i + 1, 100) AS s
  FROM (SELECT rid, doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 49))) AS i FROM d)
), f AS (
  SELECT s, min(doc_id) AS first_id FROM w GROUP BY s HAVING count(*) > 1
), r AS (
  SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM w JOIN f USING (s) WHERE w.doc_id > f.first_id
), g AS (
  SELECT rid, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM r
), runs AS (
  SELECT rid, run, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY rid, run
), e AS (
  SELECT rid, a, b, lead(a) OVER (PARTITION BY rid ORDER BY a) AS next, row_number() OVER (PARTITION BY rid ORDER BY a) AS k FROM runs
), parts AS (
  SELECT rid, 0 AS k, substring(h, 1, 2 * a) AS p FROM e JOIN d USING (rid) WHERE e.k = 1
  UNION ALL SELECT rid, k, substring(h, 2 * b + 1, 2 * (coalesce(next, length(h) // 2) - b)) FROM e JOIN d USING (rid)
), kept AS (SELECT rid, string_agg(p, '' ORDER BY k) AS h FROM parts GROUP BY rid),
n AS (SELECT rid, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY rid)
SELECT doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (rid) LEFT JOIN n USING (rid)
"""
