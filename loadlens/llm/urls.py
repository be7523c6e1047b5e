"""URL filter: host and path rules first, then the ratio of two character language models.

Variable-order Markov models of the characters of host and path, one of the URLs that rules allow and one of those they
block, smoothed by interpolating each order with the next shorter one (Witten-Bell). Counts come from all URLs with a
rule's verdict but a held-out fifth, and are kept under 54 bits of a hash of the context, so contexts stay apart and a model grows with the contexts the
corpus has; it is collected and sent to the tasks. The threshold on the log-likelihood difference per character is calibrated on the held-out fifth.

Defined cases: a null URL or one without "://" has an empty host and path, fits no rule and scores 0; repeated rows are
judged one by one; without any URL of a class its model is uniform; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 5
BINS = 400
SPREAD = 4.0
#: (rule, verdict): a host with all its subdomains, then how the path begins.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.regexp_extract(url, _PARTS, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    name = verdict = F.lit(None).cast("string")
    for rule, said in sorted(rules, key=lambda r: len(r[0])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.withColumn("rule", name).withColumn("said", verdict)


def coded(urls: list[bytes], order: int = ORDER) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of each character, and for each order k the code context * 256 + character, of all urls at once."""
    size = np.array([len(u) for u in urls], np.int64)
    text = np.frombuffer(b"".join(bytes(order) + u for u in urls), np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(urls)), size)
    first = np.cumsum(size + order) - size
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    codes, context = [], np.full(len(at), 1469598103934665603, np.uint64)
    for k in range(order + 1):
        if k:
            context = (context ^ (text[at - k] + np.uint64(1))) * np.uint64(1099511628211)
        bucket = ((context ^ (context >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(10)
        codes.append((bucket * np.uint64(256) + text[at]).astype(np.int64))
    return row, codes


class Markov:
    """Interpolated probabilities from counts of codes (all orders share the table)."""

    def __init__(self, code: np.ndarray, count: np.ndarray):
        order = np.argsort(code)
        self.code, self.count = code[order], count[order].astype(float)
        self.context, of, kinds = np.unique(self.code // 256, return_inverse=True, return_counts=True)
        self.total = np.bincount(of, self.count, len(self.context))
        self.kinds = kinds.astype(float)

    def log_likelihood(self, codes: list[np.ndarray]) -> np.ndarray:
        p = np.full(len(codes[0]), 1 / 256)
        for code in codes:
            if not len(self.code):
                break
            at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
            c = np.where(self.code[at] == code, self.count[at], 0.0)
            at = np.minimum(np.searchsorted(self.context, code // 256), len(self.context) - 1)
            known = self.context[at] == code // 256
            total, kinds = np.where(known, self.total[at], 0.0), np.where(known, self.kinds[at], 0.0)
            p = np.where(total > 0, (c + kinds * p) / np.maximum(total + kinds, 1), p)
        return np.log(p)


def _urls(batch: pa.RecordBatch, host: int, path: int) -> list[bytes]:
    return [(h + p).encode() for h, p in zip(batch.column(host).to_pylist(), batch.column(path).to_pylist())]


def counted(known: DataFrame) -> list[Markov]:
    """Models of the blocked and of the allowed URLs of (host, path, good)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, codes = coded(_urls(batch, 0, 1))
            good = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            key, n = np.unique(np.concatenate([good[row] << 62 | c for c in codes]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    table = known.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = (table.column(c).to_numpy() for c in ("key", "n"))
    return [Markov(key[key >> 62 == k] & ((1 << 62) - 1), n[key >> 62 == k]) for k in (0, 1)]


def scored(rows: DataFrame, models: list[Markov]) -> DataFrame:
    """rows with score: the allowed model's log-likelihood less the blocked one's, per character."""
    from pyspark.sql import types as T

    sent = rows.sparkSession.sparkContext.broadcast(models)
    host, path = rows.columns.index("host"), rows.columns.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good = sent.value
        for batch in batches:
            row, codes = coded(urls := _urls(batch, host, path))
            ratio = np.bincount(row, good.log_likelihood(codes) - bad.log_likelihood(codes), len(urls))
            score = ratio / np.maximum(1, [len(u) for u in urls])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))


def calibrated(held: DataFrame, models: list[Markov]) -> float:
    """The threshold with the least mean error of both classes on held-out URLs; ties go to the one nearest 0."""
    slot = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") / SPREAD + 1) * (BINS // 2)))).cast("int")
    rows = scored(held, models).groupBy("good", slot.alias("slot")).count().collect()  # at most 2 * BINS rows
    n = np.zeros((2, BINS))
    for r in rows:
        n[int(r["good"]), r["slot"]] += r["count"]
    share = n / np.maximum(1, n.sum(1, keepdims=True))
    below = np.c_[np.zeros(2), np.cumsum(share, 1)]
    error = below[1] + (share[0].sum() - below[0])
    edges = (np.arange(BINS + 1) / (BINS // 2) - 1) * SPREAD
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float(edges[best[np.argmin(np.abs(edges[best]))]])


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): the rule's verdict, else allow where the score reaches the threshold."""
    rows = ruled(pages, rules)
    known = rows.filter("said is not null").select("host", "path", (F.col("said") == "allow").alias("good"))
    held = F.pmod(F.crc32(F.concat("host", "path")), F.lit(5)) == 0
    models = counted(known.filter(~held))
    least = calibrated(known.filter(held), models)
    verdict = F.coalesce("said", F.when(F.col("score") >= least, "allow").otherwise("block"))
    return scored(rows, models).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op8_url_language_model(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return judged(read(spark, sf_dir, "pages").select("page_id", "url"))
