"""Personal data by weak supervision: regex, gazetteer and context labelers vote on candidate spans, expectation
maximisation weighs the labelers by how they agree over the whole corpus, and a span classifier learns from the result.

Every labeler answers yes, no or nothing for a span, and a span's shape is a small code, so the corpus reduces to counts
of (kind, votes, shape): a table of bounded size, the only thing that reaches the driver. Spans that the base patterns
find are always kept; the classifier decides on the others.

Defined cases: a null text counts as empty; long texts are searched whole, in time linear in their length; spans of one
kind never overlap, added spans overlap no other; repeated rows are searched one by one; an empty table gives an empty
result; ``redacted`` passes other columns through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = re.compile(r"[\[({]\s?at\s?[\])}]", re.I)
_VEILED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?[\[({]\s?at\s?[\])}]\s?[A-Za-z0-9-]+(?:\s?(?:\.|[\[({]\s?dot\s?[\])}])\s?[A-Za-z0-9-]+)+", re.I)
_NUMBER = re.compile(r"(?<![0-9A-Za-z.+])\(?[0-9](?:[0-9 ().-]{5,23})[0-9](?![0-9A-Za-z])")
_NAMED = re.compile(r"\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)\b[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9+/_.-]{12,}=*)", re.I)
_HEX = re.compile(r"(?<![A-Za-z0-9])(?=[A-Fa-f]*[0-9])[A-Fa-f0-9]{32,}(?![A-Za-z0-9])")
#: A named secret holds one of these, whatever the case.
_NAMES = ("token", "secret", "passw", "pwd", "key")
_GROUPED = re.compile(r"\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4})+")

#: Gazetteers: top domains, first digits of country calling codes (a third digit follows some), card issuers.
TOP_DOMAINS = frozenset(
    "com net org edu gov mil int info biz io co me tv app dev ai eu uk de fr es it nl be ch at pt pl cz se no fi dk ie gr hu ro bg"
    " ru ua tr il in cn jp kr tw hk sg my id th vn au nz us ca mx br ar cl pe za ng ke eg ma".split()
)
COUNTRY_CODES = ("1", "7", *(str(k) for k in (20, 27, *range(30, 35), 36, 39, 40, 41, *range(43, 50), *range(51, 59), *range(60, 67), 81, 82, 84, 86, *range(90, 96), 98)),
                 *(str(k) for k in (21, 22, 23, 24, 25, 26, 29, 35, 37, 38, 42, 50, 59, 67, 68, 69, 85, 88, 96, 97, 99)))
CARD_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "22", "23", "24", "25", "26", "27")
#: Context words, whole ones: for a kind, and against any.
CUES = {
    "email": r"e-?mails?|mail|contact|write to|reach|address", "ip": r"ips?|hosts?|servers?|addr|address|ping|login from",
    "card": r"cards?|visa|mastercard|amex|account|pay|payment|credit", "phone": r"phones?|telephone|tel|call|mobile|cell|fax|dial|ring",
    "secret": r"token|secret|password|passwd|pwd|key|api[_-]?key|access[_-]?key|credentials?",
}
AGAINST = r"versions?|ver|isbn|issn|pages?|pp|sections?|order no|order|invoice|chapters?|doi|sha|commit|build|serial|part no"
_CUES = {kind: re.compile(rf"(?<![a-z0-9])(?:{words})(?![a-z0-9])") for kind, words in CUES.items()}
_AGAINST = re.compile(rf"(?<![a-z0-9])(?:{AGAINST})(?![a-z0-9])")
_NEAR = 24


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _ip_holds(text: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in text.split("."))


def _card_holds(text: str) -> bool:
    d = _digits(text)
    return 16 <= len(d) <= 19 and luhn(d)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain.domain, found from each '@' outwards."""
    found, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            low = match.end()
            found.append((start, low))
        at = text.find("@", max(at + 1, low))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    found = [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if _ip_holds(m[0])]
        found += [("card", *m.span()) for m in _CARD.finditer(text) if _card_holds(m[0])]
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def before(text: str, start: int) -> str:
    """What stands right before a span, from a word's beginning on."""
    low = max(0, start - _NEAR)
    while 0 < low < start and text[low - 1].isalnum():
        low += 1
    return text[low:start]


def votes(kind: str, span: str, context: str, base: bool) -> tuple[int, int, int]:
    """What the regex, gazetteer and context labelers say: 1 yes, -1 no, 0 nothing."""
    d, low = _digits(span), context.lower()
    if kind == "email":
        form = 1
        book = 1 if re.split(r"[^a-z]+", span.lower())[-1] in TOP_DOMAINS else -1
    elif kind == "ip":
        form = 1 if base else -1
        book = -1 if span.split(".")[0].lstrip("0") in ("", "127", "255") else 0
    elif kind == "card":
        form = 1 if base else -1
        book = 1 if d.startswith(CARD_ISSUERS) else -1
    elif kind == "phone":
        form = 1 if base or _GROUPED.fullmatch(span) else -1
        book = (1 if d.startswith(COUNTRY_CODES) else -1) if span[0] == "+" else 0
    else:
        mixed = any(c.isdigit() for c in span) and any(c.isalpha() for c in span)
        form = (1 if mixed else 0) if len(set(span)) >= 8 else -1
        book = 1 if re.search(r"(?:token|secret|passw|pwd|key)\W*$", low) else 0
    near = -1 if _AGAINST.search(low) else 1 if _CUES[kind].search(low) else 0
    return form, book, near


def shape(span: str) -> int:
    """A code below 256: length bucket, and whether digits, letters and separators occur."""
    bucket = min(31, len(span) // 2)
    return bucket * 8 + 4 * any(c.isdigit() for c in span) + 2 * any(c.isalpha() for c in span) + any(c in " ().-" for c in span)


def _named(text: str) -> bool:
    low = text.lower()
    return any(name in low for name in _NAMES)


def candidates(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, int]]]:
    """The base spans, and all candidates as (kind, start, end, pattern); the pattern codes kind, votes and shape."""
    base = base_spans(text)
    spans = [(k, a, b, True) for k, a, b in base]
    if _AT.search(text):
        spans += [("email", *m.span(), False) for m in _VEILED.finditer(text)]
    if ("=" in text or ":" in text) and _named(text):
        spans += [("secret", *m.span(1), False) for m in _NAMED.finditer(text)]
    if _DIGIT.search(text):
        spans += [("secret", *m.span(), False) for m in _HEX.finditer(text)]
        spans += [("ip", *m.span(), False) for m in _IP.finditer(text)]
        for m in _NUMBER.finditer(text):
            n = len(_digits(m[0]))
            if 7 <= n <= 19:
                spans.append(("card" if n >= 13 else "phone", *m.span(), False))
    taken: list[tuple[int, int]] = [(a, b) for _, a, b, own in spans if own]
    out = []
    if len(spans) > len(taken):
        free = np.ones(len(text), bool)
        for a, b in taken:
            free[a:b] = False
        rest = []
        for k, a, b, own in spans:
            if not own and free[a:b].all():
                free[a:b] = False
                rest.append((k, a, b, own))
        spans = [s for s in spans if s[3]] + rest
    for k, a, b, own in spans:
        form, book, near = votes(k, text[a:b], before(text, a), own)
        code = (((KINDS.index(k) * 3 + form + 1) * 3 + book + 1) * 3 + near + 1) * 256 + shape(text[a:b])
        out.append((k, a, b, -1 - code if own else code))
    return base, out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


_FOUND = (
    "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "spans array<struct<kind:string,start:long,end:long,pattern:long>>"
)


def candidate_table(docs: DataFrame) -> DataFrame:
    """One row per document: base counts and digest, and all candidates; a negative pattern marks a base span."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, found = [], [], []
            for text in batch.column(1):
                base, spans = candidates(text.as_py() or "")
                counts.append([sum(k == x for k, _, _ in base) for x in BASE_KINDS])
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                found.append([dict(zip(("kind", "start", "end", "pattern"), s)) for s in spans])
            columns = [batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4))]
            columns += [pa.array(digests, pa.string()), pa.array(found, item)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, {_FOUND}")


def reliabilities(votes: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """Dawid-Skene for two classes: posterior per vote pattern, P(vote | class) per labeler, P(class 1)."""
    post = np.clip(0.5 + votes.sum(1) * 0.2, 0.05, 0.95)
    for _ in range(rounds):
        prior = (1 + weight @ post) / (2 + weight.sum())
        table = np.empty((votes.shape[1], 2, 3))
        for j in range(votes.shape[1]):
            for v in (-1, 0, 1):
                hit = weight * (votes[:, j] == v)
                # pseudo-counts say that labelers are rather right than wrong
                table[j, 1, v + 1] = hit @ post + (1 + v) / 2 + 0.5
                table[j, 0, v + 1] = hit @ (1 - post) + (1 - v) / 2 + 0.5
        table /= table.sum(2, keepdims=True)
        log1, log0 = np.log(prior), np.log(1 - prior)
        for j in range(votes.shape[1]):
            log1 = log1 + np.log(table[j, 1, votes[:, j] + 1])
            log0 = log0 + np.log(table[j, 0, votes[:, j] + 1])
        post = 1 / (1 + np.exp(np.clip(log0 - log1, -50, 50)))
    return post, table, float(prior)


def _features(codes: np.ndarray) -> np.ndarray:
    rest, form = codes // 256, codes % 256
    near, book, regex, kind = rest % 3, rest // 3 % 3, rest // 9 % 3, rest // 27
    one_hot = lambda x, n: np.eye(n)[x]
    bits = np.stack([form >> 2 & 1, form >> 1 & 1, form & 1], 1)
    return np.hstack([one_hot(near, 3), one_hot(book, 3), one_hot(regex, 3), one_hot(kind, len(KINDS)), one_hot(form // 32, 8), bits])


def fitted(counts: list[tuple[int, int]]) -> dict[int, float]:
    """Probability that a span is personal data for each pattern seen; counts: (pattern, spans) with base spans negative."""
    if not counts:
        return {}
    codes = np.array([c if c >= 0 else -1 - c for c, _ in counts])
    weight = np.array([n for _, n in counts], float)
    rest = codes // 256
    vote = np.stack([rest // 9 % 3 - 1, rest // 3 % 3 - 1, rest % 3 - 1], 1)
    post = np.empty(len(codes))
    for k in range(len(KINDS)):
        if (mine := rest // 27 == k).any():
            post[mine] = reliabilities(vote[mine], weight[mine])[0]
    x, share = _features(codes), weight / weight.sum()
    w = np.zeros(x.shape[1])
    for _ in range(500):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 2.0 * (x.T @ (share * (p - post)) + 1e-4 * w)
    return {int(c): float(p) for c, p in zip(codes, 1 / (1 + np.exp(-x @ w)))}


def trained(found: DataFrame) -> dict[int, float]:
    rows = found.select(F.explode("spans.pattern").alias("pattern")).groupBy("pattern").count().collect()  # bounded: patterns
    return fitted(sorted((r["pattern"], r["count"]) for r in rows))


def accepted(spans, model: dict[int, float]) -> list[tuple[str, int, int]]:
    return [(k, a, b) for k, a, b, p in spans if p < 0 or model.get(p, 0.0) >= 0.5]


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, base_sha256 and all accepted spans as one string."""
    found = written(candidate_table(docs), "spans")
    model = trained(found)
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for row in batch.column(6).to_pylist():
                texts.append(_joined(accepted([(s["kind"], s["start"], s["end"], s["pattern"]) for s in row or ()], model)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(texts, pa.string())], names=[*batch.schema.names[:6], "spans"])

    made = f"doc_id {kind.simpleString()}, {_FOUND.split(', spans')[0]}, spans string"
    return found.mapInArrow(run, made)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every accepted span replaced by its kind in brackets; n_chars follows the text; nulls stay null."""
    model = trained(written(candidate_table(docs).select("spans"), "spans"))
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value in batch.column(at):
                text = value.as_py()
                if text:
                    spans = sorted((a, b, k) for k, a, b in accepted(candidates(text)[1], model))
                    out, end = [], 0
                    for a, b, k in spans:
                        if b > end:
                            out += [text[end:a], f"[{k.upper()}]"] if a >= end else []
                            end = b
                    text = "".join([*out, text[end:]])
                texts.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if size is not None:
                columns[size] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op9_weak_pii(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return find_spans(read(spark, sf_dir, "documents"))
