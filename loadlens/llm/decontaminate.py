"""Benchmark decontamination: passages of documents within a small edit distance of a benchmark item.

Texts and items are compared as lower-case (A-Z) words joined by single spaces. The CGK random walk maps strings to ones
whose Hamming distance follows the edit distance; repeated bit-sampling LSH over them fills bucket tables with the
items, and windows of the items' sizes look themselves up in these: whatever shares a bucket is a candidate, decided by
the exact edit distance. There are as many tables as a simulation needs for the mean recall of its pairs at the largest
distance; if MOST_TABLES don't reach it, every window is decided by the exact distance instead.

Windows that can't be near any item aren't walked, and this loses none that is: an item is cut into one piece more than
the edits allowed, so whatever lies within the distance holds a piece unchanged, at its place but for these edits, and
shares as many 4-byte strings with the item as the edits leave. Windows start at words.

Documents are only mapped: the benchmark is small, travels with the tasks and is split into blocks beyond BLOCK_BYTES.

Defined cases: null and wordless texts or items match nothing; an item longer than LONG characters counts as several
parts of at most that, and a document that holds one of them holds the item (its distance and length are then those of
the part); repeated items count as one by item_id each; long texts are searched whole; an empty table gives an empty
result; ``decontaminated`` keeps every column, null ids and repeated rows of clean documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import small_batches

#: Largest edit distance as a share of the item's length.
DISTANCE = 0.1
RECALL = 0.98
SAMPLED = 6
WALKS = 16
MOST_TABLES = 4096
#: Pairs that the simulation takes at most.
SIMULATED = 256
LONG = 1000
BLOCK_BYTES = 4 << 20
#: Bytes of texts that are searched, and of windows that are walked, at once.
SEARCHED = 4 << 20
WALKED = 4 << 20
GRAM = 4
#: The walk's sampled steps lie within this many times the item's length (it advances every other step).
STEPS = 1.8
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz     ")


def normal(text: bytes) -> bytes:
    """Lower-case words joined by single spaces."""
    text = text.translate(_PLAIN).strip(b" ")
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


def embed(rows: np.ndarray, walk: np.ndarray) -> np.ndarray:
    """CGK: each step emits a string's current symbol, and a random bit of (step, symbol) says whether it advances."""
    n, width = rows.shape
    padded = np.c_[rows, np.zeros((n, 1), np.uint8)].ravel()
    at = np.arange(n) * (width + 1)
    last = at + width
    out = np.empty((len(walk), n), np.uint8)
    for step in range(len(walk)):
        symbol = padded[at]
        out[step] = symbol
        at += walk[step, symbol]
        np.minimum(at, last, at)
    return out.T


def edit_within(item: str, text: str) -> int:
    """The least edit distance between item and any substring of text (Myers' bit vectors)."""
    if item in text:
        return 0
    m = len(item)
    peq: dict[str, int] = {}
    for k, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += 1 if ph & top else -1 if mh & top else 0
        best = min(best, score)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
    return best


def bits_of(key: np.ndarray) -> np.ndarray:
    return (key * _FACTOR) >> np.uint64(44)


def spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first, first + 1, ... many of them, for each."""
    ends = many.cumsum()
    return (first - ends + many).repeat(many) + np.arange(int(ends[-1]) if len(ends) else 0)


class Items:
    """Pieces, walks and bucket tables of a block of items; the same on every worker."""

    def __init__(self, items: list[tuple[object, bytes]], distance: float = DISTANCE, recall: float = RECALL, seed: int = 11):
        parts = [(i, c[k * len(c) // n : (k + 1) * len(c) // n]) for i, t in items if (c := normal(t or b"").decode(errors="replace")) for n in [-(-len(c) // LONG)] for k in range(n)]
        self.ids = [i for i, _ in parts]
        self.chars = np.array([len(t) for _, t in parts], np.int64)
        self.texts = [t.encode() for _, t in parts]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.distance = distance
        self.edits = (distance * self.chars).astype(np.int64)
        #: Bytes by which edits can move what stands behind them.
        self.room = np.array([e * max(len(c.encode()) for c in t) for e, (_, t) in zip(self.edits.tolist(), parts)], np.int64) + 1
        self._cut(parts)
        rng = np.random.default_rng(seed)
        self.walks = rng.integers(0, 2, (WALKS, int(STEPS * self.sizes.max(initial=1)) + 2, 256)).astype(np.int8)
        self.draws = rng.random((MOST_TABLES, SAMPLED))
        self.tables, self.exact = self._tables(rng, recall)
        self.bucket, self.bucket_item = np.empty(0, np.uint64), np.empty(0, np.int64)
        if self.texts and not self.exact:
            signs = np.concatenate([s for _, s in self.sign(self.texts, self.sizes)])
            order = np.argsort(signs.ravel(), kind="stable")
            self.bucket, self.bucket_item = signs.ravel()[order], order // self.tables
            order = np.concatenate([k for k, _ in self.sign(self.texts, self.sizes)])
            self.bucket_item = order[self.bucket_item]

    def _cut(self, parts: list[tuple[object, str]]) -> None:
        """Pieces by the bytes q of them that are looked up: sorted first bytes, last bytes, lengths, items, places."""
        found: dict[int, list[tuple[bytes, int, int]]] = {}
        for i, (_, chars) in enumerate(parts):
            n = int(self.edits[i]) + 1
            cuts = [len(chars) * k // n for k in range(n + 1)]
            at = 0
            for a, b in zip(cuts, cuts[1:]):
                piece = chars[a:b].encode()
                found.setdefault(min(8, len(piece)), []).append((piece, i, at))
                at += len(piece)
        self.pieces = {}
        for q, rows in sorted(found.items()):
            key, tail = (np.array([int.from_bytes(x, "little") for x in own], np.uint64) for own in ([p[:q] for p, _, _ in rows], [p[-q:] for p, _, _ in rows]))
            order = np.argsort(key, kind="stable")
            some = np.zeros(1 << 20, bool)
            some[bits_of(key)] = True
            rest = (np.array([f(r) for r in rows], np.int64)[order] for f in (lambda r: len(r[0]), lambda r: r[1], lambda r: r[2]))
            self.pieces[q] = (key[order], tail[order], *rest, some)
        self.some_gram = np.zeros(1 << 20, bool)
        self.grams = np.empty(len(parts), np.int64)
        for i, (_, chars) in enumerate(parts):
            text = np.frombuffer(self.texts[i] + bytes(GRAM), np.uint8)
            codes = np.ndarray((max(0, int(self.sizes[i]) - GRAM + 1),), "<u4", text, strides=(1,)).astype(np.uint64)
            self.some_gram[bits_of(codes | np.uint64(i << 32))] = True
            # an edit spoils GRAM of them, of wide characters more
            self.grams[i] = len(codes) - self.edits[i] * (GRAM + max(len(c.encode()) for c in chars) - 1)

    def _tables(self, rng: np.random.Generator, recall: float) -> tuple[int, bool]:
        """Tables for the mean recall at the largest distance, by simulated edits of items; whether MOST_TABLES fall short."""
        chosen = rng.permutation(len(self.texts))[:SIMULATED].tolist()
        if not chosen:
            return WALKS, False
        rows = np.zeros((2, len(chosen), int(self.sizes[chosen].max())), np.uint8)
        for r, k in enumerate(chosen):
            text = self.texts[k]
            changed = bytearray(text)
            for _ in range(int(self.edits[k])):
                at, kind = int(rng.integers(0, len(changed) + 1)), rng.integers(0, 3)
                if kind == 0 or not changed:
                    changed.insert(at, int(rng.integers(97, 123)))
                elif kind == 1:
                    changed[min(at, len(changed) - 1)] = int(rng.integers(97, 123))
                else:
                    del changed[min(at, len(changed) - 1)]
            for row, own in zip(rows[:, r], (text, bytes(changed[: len(text)]))):
                row[: len(own)] = np.frombuffer(own, np.uint8)
        steps = (STEPS * self.sizes[chosen]).astype(np.int64) + 1
        missed = np.zeros(len(chosen))  # log of the chance that a table of every walk misses the pair
        for walk in self.walks:
            equal = embed(rows[0], walk[: int(steps.max())]) == embed(rows[1], walk[: int(steps.max())])
            hit = (equal & (np.arange(equal.shape[1]) < steps[:, None])).sum(axis=1) / steps
            missed += np.log1p(-np.minimum(hit**SAMPLED, 1 - 1e-9)) / WALKS
        tables = WALKS
        while float(np.mean(-np.expm1(tables * missed))) < recall:
            tables += WALKS
            if tables > MOST_TABLES:
                return WALKS, True
        return tables, False

    def sign(self, strings: list[bytes], sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which, LSH keys by table) of strings cut or zero-filled to the sizes, some at a time; zeros walk in place.

        A key holds its table and the size, as steps are drawn by it."""
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            many = 1
            while at + many < len(order) and (many + 1) * STEPS * sizes[order[at + many]] <= WALKED:
                many += 1
            which = order[at : at + many]
            at += many
            own = sizes[which]
            rows = np.zeros((len(which), int(own.max())), np.uint8)
            for row, k, n in zip(rows, which.tolist(), own.tolist()):
                part = np.frombuffer(strings[k][:n], np.uint8)
                row[: len(part)] = part
            out = np.empty((len(which), self.tables), np.uint64)
            steps = (STEPS * own).astype(np.int64) + 1
            every = np.arange(len(which))[:, None]
            for k in range(WALKS):
                shape = embed(rows, self.walks[k, : int(steps.max())])
                mine = np.arange(k, self.tables, WALKS)
                key = np.tile(mine.astype(np.uint64), (len(which), 1)) | (own.astype(np.uint64) << np.uint64(16))[:, None]
                for j in range(SAMPLED):
                    key = (key ^ shape[every, (self.draws[mine, j] * steps[:, None]).astype(np.int64)]) * _FACTOR
                    key ^= key >> np.uint64(29)
                out[:, mine] = key
            yield which, out

    def places(self, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, byte) of where items may begin: a piece stands in its place, and enough 4-byte strings are there.

        The buffer ends in 8 spare bytes."""
        n = len(buffer) - 8
        words = np.ndarray((n,), "<u8", buffer, strides=(1,))
        items, starts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for q, (keys, tails, length, item, place, some) in self.pieces.items():
            mask = np.uint64((1 << 8 * q) - 1)
            code = words & mask if q < 8 else words.astype(np.uint64)
            at = np.flatnonzero(some[bits_of(code)])
            code = code[at]
            low = np.searchsorted(keys, code)
            many = np.searchsorted(keys, code, "right") - low
            which, at = spread(low, many), at.repeat(many)
            end = at + length[which] - q
            fits = end < n
            fits[fits] = words[end[fits]] & mask == tails[which[fits]]
            items.append(item[which[fits]])
            starts.append(at[fits] - place[which[fits]])
        key = np.unique(np.concatenate(items) << 40 | np.concatenate(starts) + (1 << 39))
        item, start = key >> 40, (key & ((1 << 40) - 1)) - (1 << 39)
        fits = self.grams[item] <= 0
        grams = np.ndarray((n,), "<u4", buffer, strides=(1,))
        left = np.flatnonzero(~fits)
        for k in range(0, len(left), 4096):
            some = left[k : k + 4096]
            own = item[some]
            low = np.maximum(start[some] - self.room[own], 0)
            many = np.minimum(start[some] + self.sizes[own] + self.room[own], n) - low
            code = grams[spread(low, many)].astype(np.uint64) | (own.astype(np.uint64) << np.uint64(32)).repeat(many)
            ends = np.cumsum(many)
            count = np.r_[0, np.cumsum(self.some_gram[bits_of(code)])]
            fits[some] = count[ends] - count[ends - many] >= self.grams[own]
        return item[fits], start[fits]

    def windows(self, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first byte) of the windows that begin at a word where an item may begin, with the item's size."""
        item, start = self.places(buffer)
        words = np.flatnonzero(np.r_[True, (buffer[:-9] == 32) | (buffer[:-9] == 10)])
        low = np.maximum(np.searchsorted(words, start - self.room[item], "right") - 1, 0)
        many = np.maximum(np.searchsorted(words, start + self.room[item], "right"), low + 1) - low
        key = np.unique(item.repeat(many) << 40 | words[spread(low, many)])
        return key >> 40, key & ((1 << 40) - 1)

    def candidates(self, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first byte): windows with an item of a bucket they look up."""
        item, start = self.windows(buffer)
        if self.exact or not len(item):
            return item, start
        key = np.unique(self.sizes[item] << 40 | start)
        size, start = key >> 40, key & ((1 << 40) - 1)
        raw = buffer.tobytes()
        ends = np.r_[np.flatnonzero(buffer[:-8] == 10), len(buffer) - 8]
        stop = np.minimum(start + size, ends[np.searchsorted(ends, start)])
        found = [np.empty(0, np.int64)]
        for which, keys in self.sign([raw[a:b] for a, b in zip(start.tolist(), stop.tolist())], size):
            low = np.searchsorted(self.bucket, keys.ravel())
            met = np.flatnonzero(self.bucket[np.minimum(low, len(self.bucket) - 1)] == keys.ravel())
            low = low[met]
            many = np.searchsorted(self.bucket, keys.ravel()[met], "right") - low
            own = self.bucket_item[spread(low, many)]
            found.append(np.unique(own << 40 | start[which[met // self.tables]].repeat(many)))
        key = np.unique(np.concatenate(found))
        return key >> 40, key & ((1 << 40) - 1)

    def matches(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """(text, item, distance) of the items that each of the texts holds within the distance; of an item's parts the nearest."""
        best: dict[tuple[int, object], tuple[float, int, int]] = {}
        plain = [normal(t) for t in texts]
        at = 0
        while at < len(plain) and self.texts:
            many, room = 1, len(plain[at])
            while at + many < len(plain) and room + len(plain[at + many]) <= SEARCHED:
                room += len(plain[at + many])
                many += 1
            whole = b"\n".join(plain[at : at + many])
            begin = np.cumsum([0] + [len(t) + 1 for t in plain[at : at + many]])
            item, start = self.candidates(np.frombuffer(whole + bytes(8), np.uint8))
            row = np.searchsorted(begin, start, "right") - 1
            held: tuple | None = None
            for r, i, s in [*sorted(zip(row.tolist(), item.tolist(), start.tolist())), (-1, -1, 0)]:
                if held and held[:2] == (r, i) and s <= held[3]:  # windows that overlap are searched at once
                    held = (r, i, held[2], s + int(self.sizes[i] + self.room[i]))
                    continue
                if held:
                    text, own = plain[at + held[0]], held[1]
                    shift = int(begin[held[0]])
                    d = edit_within(self.texts[own].decode(), text[max(0, held[2] - shift) : held[3] - shift].decode(errors="replace"))
                    if d <= self.edits[own]:
                        key, told = (at + held[0], self.ids[own]), (d / int(self.chars[own]), own, d)
                        best[key] = min(best.get(key, told), told)
                held = (r, i, s - int(self.room[i]), s + int(self.sizes[i] + self.room[i]))
            at += many
        return sorted((row, i, d) for (row, _), (_, i, d) in best.items())


def blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items, in blocks of about BLOCK_BYTES of text that a worker can hold."""
    rows = benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else rows
        items = sorted(((r["item_id"], bytes(r["text"])) for r in part.collect()), key=lambda r: (str(r[0]), r[1]))
        yield Items(items)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, item_chars): each pair once, with the least distance (a row of docs is one document)."""
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    small_batches(docs.sparkSession)
    rows, out = docs.select("doc_id", F.col("text").cast("string").alias("text")), None
    for items in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1)]
                found = items.matches(texts)
                of = batch.column(0).take(pa.array([r for r, _, _ in found], pa.int64()))
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": of, "item_id": pa.array([items.ids[i] for _, i, _ in found], item_type), "distance": pa.array([d for _, _, d in found], pa.int32()),
                     "item_chars": pa.array([int(items.chars[i]) for _, i, _ in found], pa.int32())}
                )

        part = rows.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, distance int, item_chars int")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item."""
    small_batches(docs.sparkSession)
    at, out = docs.columns.index("text"), docs
    for items in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(at)]
                bad = {r for r, _, _ in sent.value.matches(texts)}
                yield batch.filter(pa.array([r not in bad for r in range(len(texts))]))

        out = out.mapInArrow(run, docs.schema)
    return out


def op5_cgk_decontamination(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
