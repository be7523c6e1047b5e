"""Quality classifier: supervised subword embeddings.

A document is the mean of hashed vectors of its words, of their character 3- to 5-grams, and of its immediate word
repetitions; a softmax over the mean is trained together with the vectors by stochastic gradient descent in numpy. Both
are linear, so scoring adds one number per feature: a worker keeps the sum of each word it has seen.

Training takes at most SAMPLE labelled documents, those with the smallest hash of their id; scoring takes all rows.

Defined cases: a null or empty text has no features, so only the bias speaks; repeated rows get equal scores; labels
other than 0 and 1 are ignored; without labels of both classes every score is the share of label 1 (0.5 without any);
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BUCKETS = 1 << 17
WIDTH = 8
EPOCHS = 6
RATE = 0.5
#: Labelled documents used for training at most.
SAMPLE = 4_000
#: Words whose sums a worker remembers at most; it starts anew beyond that.
REMEMBERED = 1_000_000
REPEATED = 0
_MODEL: list = [None, {}]


def word_features(word: bytes) -> list[int]:
    """Buckets of a word and its character n-grams, with marks for its ends; a very long word gives all of its own."""
    text = f"<{word.decode()}>"
    crc = zlib.crc32
    out = [crc(word) % (BUCKETS - 1) + 1]
    for n in (3, 4, 5):
        out += [crc(text[k : k + n].encode()) % (BUCKETS - 1) + 1 for k in range(len(text) - n + 1)]
    return out


def features(text: bytes, seen: dict[bytes, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) of a document; the shares add up to 1."""
    words = text.split()
    parts, times = [np.zeros(1, np.int32)], [sum(map(eq, words, words[1:]))]
    for w, n in Counter(words).items():
        if w not in seen:
            if len(seen) > REMEMBERED // 10:
                seen.clear()
            seen[w] = np.array(word_features(w), np.int32)
        parts.append(seen[w])
        times.append(n)
    keys, back = np.unique(np.concatenate(parts), return_inverse=True)
    count = np.bincount(back, np.repeat(times, [len(p) for p in parts]), len(keys))
    keys, count = keys[count > 0], count[count > 0]
    return keys, (count / max(1.0, count.sum())).astype(np.float32)


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weight per bucket, bias) of the log-odds of label 1."""
    share = float(labels.mean()) if len(labels) else 0.5
    if not (len(labels) and 0 < share < 1):
        return np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = rng.uniform(-0.1, 0.1, (2, WIDTH)), np.log([1 - share, share])
    seen: dict[bytes, np.ndarray] = {}
    rows = [features(t, seen) for t in texts]
    del seen
    steps, step = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            rate = RATE * (1 - step / steps)
            step += 1
            keys, parts = rows[k]
            own = vectors[keys]
            mean = parts @ own
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = p @ out
            out -= rate * p[:, None] * mean
            bias -= rate * 0.1 * p
            # a vector's step is scaled by the number of features, so that rare buckets of long texts learn too
            vectors[keys] = own - (rate * np.minimum(1.0, parts * 50))[:, None] * back
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def score(text: bytes, weight: np.ndarray, bias: float, seen: dict[bytes, complex]) -> float:
    words = text.split()
    pairs = list(map(seen.get, words))
    if None in pairs:
        if len(seen) > REMEMBERED:
            seen.clear()
        for k in [k for k, pair in enumerate(pairs) if pair is None]:
            word = words[k]
            pair = seen.get(word)
            if pair is None:
                own = word_features(word)
                pair = complex(float(weight[own].sum()), len(own))
                if len(word) < 60:
                    seen[word] = pair
            pairs[k] = pair
    total = sum(pairs, 0j)
    same = sum(map(eq, words, words[1:]))
    z = bias + (total.real + same * float(weight[REPEATED])) / max(1.0, total.imag + same)
    return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def sampled(docs: DataFrame, labels: DataFrame, label: str, size: int = SAMPLE) -> tuple[list[bytes], np.ndarray]:
    """Whole texts of at most size labelled documents, those whose ids hash lowest, and their labels."""
    some = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("label"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(size)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id")
    rows = rows.select("doc_id", "label", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    table = rows.toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    return table.column("text").to_pylist(), table.column("label").to_numpy().astype(np.int64)


def scores(docs: DataFrame, weight: np.ndarray, bias: float) -> DataFrame:
    """(doc_id, score) of all whole texts."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((weight, bias))
    mark = zlib.crc32(weight.tobytes())
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loadlens.llm import quality

        if quality._MODEL[0] != mark:
            quality._MODEL[:] = [mark, {}]
        weight, bias = sent.value
        for batch in batches:
            made = [score(t.as_buffer().to_pybytes() if t.is_valid else b"", weight, bias, quality._MODEL[1]) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.float64())], names=["doc_id", "score"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, score double")


def op2_subword_quality(spark, sf_dir: str) -> DataFrame:
    from .common import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    weight, bias = train(*sampled(docs, read(spark, sf_dir, "labels").filter(~held), "quality"))
    return scores(docs, weight, bias).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
