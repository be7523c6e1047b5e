"""Best-fit packing planned on a histogram of lengths.

Documents become token ids, long ones pieces; the number of pieces of each length (at most as many rows as a sequence
has tokens) goes to the driver, where best-fit decreasing runs over counts: all pieces of one length and all sequences
with the same room are handled at once. The plan is a list of runs, bounded by the sequence size whatever the corpus.
Each piece then takes the slot of its rank within its length.

Defined cases: a null or empty text is one piece that holds only the closing id; a very long text is encoded whole, then
cut; repeated rows are packed one by one;
an empty table gives an empty result and no sequences; only the id and the text are read.
"""

from __future__ import annotations

import json
import string
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width, small_batches, written

SIZE = 2048
END = np.zeros(1, "<u4").tobytes()
#: Words, and stems without case and marks, whose ids a worker remembers at most; it starts anew beyond that.
REMEMBERED = 200_000
STEMS = 300_000
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level vocabularies write each byte as a letter: itself where it prints, else from code point 256 on.
_LETTERS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_MARKS = "".join(c for c in string.punctuation if c != "'")


class WordTokens:
    """Ids of a text, word by word: the tokenizer parts words at white space, so words can be remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        steps = json.loads(self.tokenizer.to_str())
        kinds = [s["type"] for s in (steps["normalizer"] or {}).get("normalizers", ())], [
            s["type"] for s in (steps["pre_tokenizer"] or {}).get("pretokenizers", ())
        ]
        #: Then a run of lower-case letters goes through the steps before the model as it is, but for its bytes' letters.
        self.direct = kinds == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and not steps["post_processor"]
        self.words: dict[bytes, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def encoded(self, text: str) -> bytes:
        if self.direct and text.isalpha() and text == text.lower() == unicodedata.normalize("NFC", text):
            tokens = self.model.tokenize(text.encode().decode("latin-1").translate(_LETTERS))
            return np.array([t.id for t in tokens], "<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def stem(self, text: str) -> bytes:
        ids = self.stems.get(text)
        if ids is None:
            if len(self.stems) > STEMS:
                self.stems.clear()
            ids = self.stems[text] = self.encoded(text)
        return ids

    def word(self, word: bytes) -> bytes:
        """Letters and the marks behind them are tokenized apart, and case is folded: such parts recur far more often."""
        text = word.decode()
        core = text.rstrip(_MARKS)
        if len(text) > 100:
            return self.encoded(text)
        if not (core.isalpha() and max(core) < "ƀ"):
            return self.stem(text)
        return self.stem(core.lower()) + (self.stem(text[len(core) :]) if len(core) < len(text) else b"")

    def ids(self, text: bytes) -> bytes:
        words, known = text.split(), self.words
        out = list(map(known.get, words))
        if None in out:
            if len(known) > REMEMBERED:
                known.clear()
            for k in [k for k, ids in enumerate(out) if ids is None]:
                word = words[k]
                ids = known.get(word)
                if ids is None:
                    ids = self.word(word)
                    if len(word) < 60:
                        known[word] = ids
                out[k] = ids
        return b"".join(out)


_LOADED: dict[str, WordTokens] = {}


def loaded(path: str) -> WordTokens:
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids binary]): every document's ids and a closing 0, cut at size tokens."""
    path = path or default_vocabulary()
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = loaded(path)
        for batch in batches:
            of, piece, start, length, crc, kept = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = (tokens.ids(text.as_buffer().to_pybytes()) if text.is_valid else b"") + END
                for k in range(0, len(ids), 4 * size):
                    part = ids[k : k + 4 * size]
                    of.append(row)
                    piece.append(k // (4 * size))
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(part)
            columns = [batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc)] + [pa.array(kept, pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    made = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return rows.mapInArrow(run, made)


def plan(counts: dict[int, int], size: int = SIZE) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over counts: runs (length, first rank, count, first sequence, offset, pieces a sequence)."""
    runs: list[tuple[int, ...]] = []
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    sequences = 0

    def give(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], rooms[at]
            else:
                left, first, n = size, sequences, -(-todo // (size // length))
                sequences += n
            each = left // length
            for taken, bins in ((each, min(n, todo // each)), (todo % each, 1)):
                if bins and n and todo >= taken > 0 and (taken == each or todo == taken):
                    runs.append((length, rank, taken * bins, first, size - left, taken))
                    give(left - taken * length, first, bins)
                    rank, todo, first, n = rank + taken * bins, todo - taken * bins, first + bins, n - bins
            give(left, first, n)
    return np.array(runs, np.int64).reshape(-1, 6), sequences


def ranked(pieces: DataFrame) -> DataFrame:
    """pieces with rank, from 0 within each length; a length of a third of all rows is ranked in buckets."""
    width = max(16, shuffle_width(pieces.sparkSession))
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(width)).cast("int"))
    count = rows.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    count = count.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start")
    rows = rows.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    return rows.join(count, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before")).drop("bucket", "before")


def packed(docs: DataFrame, path: str | None = None, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and its offset there; offsets of a sequence are gapless from 0."""
    pieces = written(token_pieces(docs, path, size, with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most size rows
    runs, _ = plan(counts, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((runs[:, 1], runs[:, 0]))
        table = runs[order]
        by_length = {int(x): np.flatnonzero(table[:, 0] == x) for x in np.unique(table[:, 0])}
        for batch in batches:
            at = batch.schema.get_field_index
            length, rank = (batch.column(at(c)).to_numpy() for c in ("length", "rank"))
            hit = np.empty(len(length), np.int64)
            for x in np.unique(length):
                mine, own = np.flatnonzero(length == x), by_length[int(x)]
                hit[mine] = own[np.searchsorted(table[own, 1], rank[mine], "right") - 1]
            _, first, _, sequence, offset, each = table[hit].T
            k = rank - first
            columns = [batch.column(at(c)) for c in kept]
            columns += [pa.array(sequence + k // each), pa.array(offset + k % each * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "offset"])

    kept = pieces.columns
    rows = ranked(pieces).select(*kept, "rank")
    made = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return rows.mapInArrow(run, f"{made}, sequence_id long, offset long")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return packed(read(spark, sf_dir, "documents"))
