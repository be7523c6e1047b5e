"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a small Hamming distance through BK-trees.

A BK-tree over all fingerprints visits most of itself for a radius of 4 bits in 64, so the trees are sharded: two
fingerprints that differ in at most r bits agree on at least B - r of B bit bands, so every choice of B - r bands gives
a table whose buckets are shards, and each linked pair shares a bucket. A bucket's distinct fingerprints form one tree,
children keyed by their integer distance to the parent; queries follow only edges within the radius. The shards grow
with the corpus, so trees and their queries meet by shuffle instead of broadcast; B grows with the number of
fingerprints, which keeps trees small. In a dense bucket most members are joined while its tree is built, and a query
skips the trees that are its own component already, so members of one group aren't paired one by one.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other; fewer words than a shingle
make one shingle of all words; a very long text is hashed whole, its bits summed in pieces; repeated rows and exact copies share a fingerprint and are never paired; a null doc_id
gets a component but is never its smallest id while another is there; an empty table gives an empty result; columns
other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, small_batches, written
from .components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
BITS = 64
#: Rows of a partition that are made into trees at once, and (query, node) pairs followed at once.
BLOCK = 200_000
FRONTIER = 500_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit b is 1 where over half the shingles' XXH64 hashes have it; repeats count."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    whole = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    ends = ends.tolist()[shingle - 1 :] or [len(whole)]
    hashes = np.array([xxh64_intdigest(whole[a:b], SEED) for a, b in zip(starts, ends)], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 16_384):
        part = hashes[k : k + 16_384].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of whole texts; fp holds the 64 bits as a signed long."""
    kind = docs.schema[doc_id].dataType
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            made = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(made, np.uint64).view(np.int64))], names=["doc_id", "fp"]
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, fp long")


def joined(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Gives all nodes that u and v connect the smallest label among them; labels are nodes that label themselves."""
    while True:
        a, b = label[u], label[v]
        if not (apart := a != b).any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label[:] = label[label]


class Forest:
    """BK-trees over the groups of a sorted array, every group's first fingerprint a root, and what their links connect."""

    def __init__(self, fps: np.ndarray, group: np.ndarray, radius: int):
        self.fps, self.radius = fps, radius
        n = len(fps)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        self.root = np.repeat(first, np.diff(np.r_[first, n]))
        self.label = np.arange(n)
        rest = np.flatnonzero(self.root != self.label)
        at = self.root[rest]
        keys, nodes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        levels = []
        while len(rest):
            d = np.bitwise_count(fps[rest] ^ fps[at])
            near = d <= radius  # a node on the way is a link already
            joined(self.label, rest[near], at[near])
            edge, where, back = np.unique(at * (BITS + 1) + d, return_index=True, return_inverse=True)
            keys.append(edge)
            nodes.append(rest[where])
            levels.append((rest[where], at[where]))
            at = rest[where][back]
            left = at != rest
            rest, at = rest[left], at[left]
        order = np.argsort(key := np.concatenate(keys))
        self.edge, self.child = key[order], np.concatenate(nodes)[order]
        # the least and the greatest label below each node: a query need not enter a tree that is all its own component
        self.low, self.high = self.label.copy(), self.label.copy()
        for child, parent in reversed(levels):
            np.minimum.at(self.low, parent, self.low[child])
            np.maximum.at(self.high, parent, self.high[child])

    def connected(self) -> np.ndarray:
        """For each member the first one of its group that links within the radius connect it to."""
        label = self.label
        todo = [(q := np.arange(len(self.fps)), self.root[q])]
        while todo:
            q, node = todo.pop()
            new = (self.low[node] != self.high[node]) | (label[self.low[node]] != label[q])
            q, node = q[new], node[new]
            d = np.bitwise_count(self.fps[q] ^ self.fps[node]).astype(np.int64)
            near = d <= self.radius
            joined(label, q[near], node[near])
            low = np.searchsorted(self.edge, node * (BITS + 1) + np.maximum(d - self.radius, 0))
            many = np.searchsorted(self.edge, node * (BITS + 1) + np.minimum(d + self.radius, BITS), "right") - low
            ends = np.cumsum(many)
            cuts = [0, *np.searchsorted(ends, np.arange(FRONTIER, ends[-1] if len(ends) else 0, FRONTIER)).tolist(), len(q)]
            for a, b in zip(cuts, cuts[1:]):
                if total := int(many[a:b].sum()):
                    skip = np.repeat(low[a:b] - (np.cumsum(many[a:b]) - many[a:b]), many[a:b])
                    todo.append((np.repeat(q[a:b], many[a:b]), self.child[skip + np.arange(total)]))
        return label


def bands(count: int, radius: int) -> tuple[int, list[list[tuple[int, int]]]]:
    """The number of bands, and for every table the (shift, width) of the bands that make its key."""
    n = radius + 2
    while count > 16 * 2 ** ((n - radius) * (BITS // n)) and n < 3 * radius:
        n += 1
    cuts = [round(BITS * k / n) for k in range(n + 1)]
    spans = [(cuts[k], cuts[k + 1] - cuts[k]) for k in range(n)]
    return n, [list(c) for c in combinations(spans, n - radius)]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints fp that connect exactly what pairs within the radius connect."""
    tables = bands(fps.count(), radius)[1]

    def key(spans: list[tuple[int, int]]):
        out, at = F.lit(0).cast("long"), 0
        for shift, width in spans:
            part = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
            out, at = out.bitwiseOR(F.shiftleft(part, at)), at + width
        return out

    rows = fps.select("fp", F.posexplode(F.array(*[key(s) for s in tables])).alias("tab", "key"))
    rows = rows.repartition("tab", "key").sortWithinPartitions("tab", "key", "fp").select("tab", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(tab: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            group = np.cumsum(np.r_[0, (tab[1:] != tab[:-1]) | (key[1:] != key[:-1])])
            shared = np.bincount(group)[group] > 1
            if shared.any():
                fp, group = fp[shared], group[shared]
                label = Forest(fp.view(np.uint64), group, radius).connected()
                if (far := label != np.arange(len(fp))).any():
                    yield pa.RecordBatch.from_arrays([pa.array(fp[far]), pa.array(fp[label[far]])], names=["u", "v"])

        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size >= BLOCK:
                tab, key, fp = (np.concatenate(x) for x in zip(*held))
                cut = int(np.flatnonzero((tab != tab[-1]) | (key != key[-1]))[-1]) + 1 if (tab[0], key[0]) != (tab[-1], key[-1]) else 0
                yield from linked(tab[:cut], key[:cut], fp[:cut]) if cut else ()
                held, size = [[tab[cut:], key[cut:], fp[cut:]]], len(tab) - cut
        if size:
            yield from linked(*(np.concatenate(x) for x in zip(*held)))

    return rows.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links can reach."""
    marks = written(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    distinct = written(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    label = components(links(distinct.select("fp"), radius).distinct())
    root = distinct.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = root.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = root.join(least, "label").select("fp", "component_id")
    return marks.join(ids, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Of each component the document with the smallest doc_id.

    Rows without a doc_id, and rows that repeat one, are documents of their own, told apart by their place: of a
    component one row stays, one with a doc_id if there is any."""
    if docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").limit(1).count():
        place = next(name for k in range(len(docs.columns) + 1) if (name := f"place_{k}") not in docs.columns)
        placed = written(docs.withColumn(place, F.monotonically_increasing_id()), "rows")
        found = near_duplicates(placed, place, radius=radius).withColumnRenamed("doc_id", place)
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", place)).alias("f")
        stay = found.join(placed.select(place, "doc_id"), place).groupBy("component_id").agg(first).select(f"f.{place}")
        return placed.join(written(stay, "stay"), place, "left_semi").drop(place)
    found = written(near_duplicates(docs, radius=radius), "components")
    stay = found.filter("doc_id = component_id").select(F.col("doc_id").alias("__stay"))
    return docs.join(stay, docs["doc_id"] == stay["__stay"], "left_semi")


def op7_simhash_bk(spark, sf_dir: str) -> DataFrame:
    from .common import read

    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
