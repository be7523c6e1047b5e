"""What documents have in common, found through packed keys instead of rows.

Documents are written once in chunks. A chunk sends its sorted distinct keys, one packed value for each part of the key
space; where a part's values meet, equal keys are seen, and every chunk gets a bit per key back. A key of a third of all
documents is sent once a chunk, so nothing is hot, and only what is shared has to be handled further.

Keys are compared by their upper 47 bits, so a few that no other document has may count as shared; none is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, small_batches, written

#: Bytes of texts in a chunk, about; a longer text has one of its own. Larger chunks send fewer, larger values.
CHUNK_BYTES = 1 << 20
#: Bytes of texts whose keys meet in one part, about.
PART_BYTES = 16 << 20
#: A key is marked as common if this many chunks hold it.
COMMON = 4096
#: Chunks are long rows: small row groups keep readers and writers small.
LONG_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}

Keys = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def chunked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(chunk, ids, sizes, body, n_bytes): the rows of docs in chunks, as a written table; null texts are empty.

    ``texts_of(sizes, body)`` are a chunk's texts; they are packed, so that a chunk travels small."""
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            size = pc.binary_length(batch.column(1)).to_numpy().astype(np.int64)
            ends = np.cumsum(size)
            block = ends // CHUNK_BYTES
            cuts = np.r_[np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), batch.num_rows]
            bodies = [press.compress(b"".join(batch.column(1).slice(a, b - a).to_pylist())) for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
            columns = [pa.array(number + np.arange(len(bodies))), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), batch.column(0))]
            columns += [slices(size, cuts, 8), pa.array(bodies, pa.binary()), pa.array(np.add.reduceat(size, cuts[:-1]))]
            number += len(bodies)
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "sizes", "body", "n_bytes"])

    made = f"chunk long, ids array<{kind}>, sizes binary, body binary, n_bytes long"
    return written(rows.mapInArrow(run, made), "chunks", **LONG_ROWS)


def texts_of(sizes: bytes, body: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, np.int64)).tolist()
    whole = zstandard.ZstdDecompressor().decompress(body)
    return [whole[a:b] for a, b in zip([0, *ends], ends)]


def parts_for(chunks: DataFrame) -> int:
    """Parts of the key space: a few for each shuffle partition, more where they would grow too large."""
    size = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(2 * shuffle_width(chunks.sparkSession), -(-size // PART_BYTES))


def part_edges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins among rising keys, and the end."""
    of = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(of, np.arange(parts + 1, dtype=np.uint64))


def heads(x: np.ndarray) -> np.ndarray:
    """True where a run of equal values begins."""
    out = np.empty(len(x), bool)
    out[:1] = True
    np.not_equal(x[1:], x[:-1], out[1:])
    return out


def widths(first: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(len(first), np.int64)
    np.subtract(first[1:], first[:-1], out[:-1])
    out[-1:] = n - first[-1:]
    return out


def spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first, first + 1, ... many of them, for each."""
    ends = many.cumsum()
    return (first - ends + many).repeat(many) + np.arange(int(ends[-1]) if len(ends) else 0)


class Distinct:
    """The distinct keys of a chunk in rising order, and which of them each key is."""

    def __init__(self, key: np.ndarray, row: np.ndarray):
        order = np.argsort(key, kind="stable")
        of = key[order]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.empty(0, np.int64)
        self.keys = of[first]
        width = np.diff(np.r_[first, len(of)])
        self.of = np.empty(len(of), np.int64)
        self.of[order] = np.repeat(np.arange(len(first)), width)
        row = row[order]
        self.several = row[first] != row[first + width - 1] if len(of) else np.empty(0, bool)


def slices(data: np.ndarray, edges: np.ndarray, width: int = 1) -> pa.Array:
    """The bytes of data between the edges (counted in items of width bytes), one value each."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def shared(chunks: DataFrame, keys: Keys, parts: int, common: int = COMMON) -> DataFrame:
    """(chunk, masks array<struct<part, shared, common>>), as a written table: bits of the chunk's distinct keys by part.

    shared: another row holds the key too; common: at least that many chunks do. Chunks that share nothing are left out.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sizes, body in zip(*(c.to_pylist() for c in batch.columns)):
                own = Distinct(*keys(texts_of(sizes, body)))
                packed = own.keys >> np.uint64(17) << np.uint64(1) | own.several.astype(np.uint64)
                edges = part_edges(own.keys, parts)
                some = np.flatnonzero(np.diff(edges))
                data = packed.view(np.uint8).reshape(-1, 8)[:, :6]
                columns = [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), chunk, np.int64)), slices(data, np.r_[edges[some], edges[-1]], 6)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "chunk", "keys"])

    def answer(part: int, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        sizes = np.array([len(k) // 6 for _, k in held])
        packed = np.zeros((int(sizes.sum()), 8), np.uint8)
        packed[:, :6] = np.frombuffer(b"".join(k for _, k in held), np.uint8).reshape(-1, 6)
        packed = packed.view("<u8").ravel()
        order = np.argsort(packed, kind="stable")
        key = packed[order] >> np.uint64(1)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[first, len(key)])
        several = np.bitwise_or.reduceat(packed[order] & np.uint64(1), first) > 0
        bits = np.empty((2, len(key)), bool)
        bits[0, order] = np.repeat((count > 1) | several, count)
        bits[1, order] = np.repeat(count >= common, count)
        at = np.r_[0, np.cumsum(sizes)].tolist()
        out = []
        for (chunk, _), a, b in zip(held, at, at[1:]):
            if bits[0, a:b].any():
                out.append((chunk, np.packbits(bits[0, a:b]).tobytes(), np.packbits(bits[1, a:b]).tobytes() if bits[1, a:b].any() else b""))
        columns = [pa.array([x[0] for x in out], pa.int64()), pa.array(np.full(len(out), part, np.int32)), *(pa.array([x[k] for x in out], pa.binary()) for k in (1, 2))]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "part", "shared", "common"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in by_part(batches):
            yield answer(part, [(row[1], row[2]) for row in held])

    sent = chunks.select("chunk", "sizes", "body").mapInArrow(send, "part int, chunk long, keys binary")
    met = dealt(sent, parts).mapInArrow(meet, "chunk long, part int, shared binary, common binary")
    return written(met.groupBy("chunk").agg(F.collect_list(F.struct("part", "shared", "common")).alias("masks")), "masks")


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """rows with the same part together."""
    return rows.repartition(min(parts, shuffle_width(rows.sparkSession)), "part").sortWithinPartitions("part")


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(part, its rows) of rows whose first column is the part, in order of parts."""
    part, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[0] != part:
                yield part, held
                held = []
            part = row[0]
            held.append(row)
    if held:
        yield part, held


def marked(own: Distinct, masks: list[dict], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of a chunk's distinct keys is shared, and whether it is common."""
    edges = part_edges(own.keys, parts)
    out = np.zeros((2, len(own.keys)), bool)
    for mask in masks:
        a, b = edges[mask["part"]], edges[mask["part"] + 1]
        for k, name in enumerate(("shared", "common")):
            if mask[name]:
                out[k, a:b] = np.unpackbits(np.frombuffer(mask[name], np.uint8), count=b - a).astype(bool)
    return out[0], out[1]


def ranked(*arrays: pa.Array) -> tuple[list[np.ndarray], pa.Array]:
    """The rank of each value of the arrays among all of them (nulls -1), and the values in order."""
    whole = pa.chunked_array([a.cast(arrays[0].type) for a in arrays]).combine_chunks()
    whole = whole if isinstance(whole, pa.Array) else whole.chunk(0)
    values = pc.unique(whole.drop_null())
    values = values.take(pc.sort_indices(values))
    rank = pc.fill_null(pc.index_in(whole, value_set=values), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.cumsum([len(a) for a in arrays])[:-1]
    return np.split(rank, cuts), values
