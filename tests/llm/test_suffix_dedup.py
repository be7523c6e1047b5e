import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loadlens.llm import suffix_dedup as sd


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(text):
    assert sd.suffix_array(np.array(text, np.int64)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_of_periodic_and_random_texts():
    rng = random.Random(1)
    for text in ([1] * 300, [1, 2] * 150, [2, 1] * 150, [1, 1, 2] * 90 + [1], [rng.randrange(250) for _ in range(3000)], [rng.randrange(2) for _ in range(3000)]):
        assert sd.suffix_array(np.array(text, np.int64)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=25), min_size=1, max_size=8))
def test_suffix_arrays_side_by_side(texts):
    sizes = np.array([len(t) for t in texts])
    got = sd.suffix_arrays(np.array([x for t in texts for x in t]), sizes)
    start = 0
    for t in texts:
        assert (got[start : start + len(t)] - start).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        start += len(t)


def test_suffix_arrays_of_long_and_periodic_texts():
    rng = random.Random(3)
    texts = [[1] * 300, [1, 2] * 150, [2, 1] * 170, [1, 1, 2] * 90 + [1], [rng.randrange(250) for _ in range(3000)], [rng.randrange(2) for _ in range(3000)]]
    got = sd.suffix_arrays(np.array([x for t in texts for x in t]), np.array([len(t) for t in texts]))
    assert got.tolist() == [i + s for t, s in zip(texts, np.cumsum([0] + [len(t) for t in texts])) for i in sd.suffix_array(np.array(t))]


def brute(rows):
    first = {}
    for i, text in rows:
        for p in range(len(text) - 49 if i is not None else 0):
            w = text[p : p + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, text in rows:
        gone = [False] * len(text)
        for p in range(len(text) - 49):
            if i is not None and first[text[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(text, gone) if not g)
        out.append((str(i), len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(docs, **options):
    return sorted((str(r.doc_id), *tuple(r)[1:]) for r in sd.deduplicated(docs, **options).collect())


def texts_with_copies(seed):
    rng = random.Random(seed)
    words = ["été", "alpha", "b", "gamma,", "delta\n", "x" * 30, "0"]
    pool = [" ".join(rng.choices(words, k=rng.randint(5, 60))) for _ in range(12)]
    texts = [None, "", "a" * 49, "a" * 50, "a" * 200, "ab" * 100, "x" + "a" * 60]
    for _ in range(70):
        parts = [rng.choice(pool) if rng.random() < 0.6 else " ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(rng.randint(1, 5))]
        texts.append("".join(p[rng.randint(0, 9) : len(p) - rng.randint(0, 9)] for p in parts))
    return texts + [texts[20]] * 3


@pytest.mark.parametrize("common", [2, 4096])
def test_against_brute_force(spark, common):
    """Also with every anchor of two chunks dealt out again by its wider ones."""
    texts = texts_with_copies(6)
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, segment string")
    assert found(docs, common=common) == brute([(i, (t or "").encode()) for i, t in enumerate(texts)])


def test_string_ids_and_ids_that_repeat(spark):
    texts = texts_with_copies(7)
    rows = [(f"k{i % 23:02d}", t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert found(docs) == brute([(i, (t or "").encode()) for i, t in rows])


def test_odd_rows(spark):
    text = "".join(chr(97 + k % 26) * (k % 5 + 1) for k in range(60))
    other = "".join(chr(97 + k * k % 23) for k in range(193))
    rows = [(None, text), (None, text), (2, text), (2, text), (7, text), (7, other), (9, None), (9, other)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = found(docs)
    assert got == brute([(i, (t or "").encode()) for i, t in rows])
    assert [r[2] for r in got if r[0] == "7"] == [len(text), 0] and [r[2] for r in got if r[0] == "2"] == [0, 0]
    assert found(docs.limit(0)) == []
    assert found(docs.filter("doc_id = 9")) == brute([(9, b""), (9, other.encode())])


def test_unequal_texts_of_one_id_are_judged_apart(spark):
    first, other = ("".join(chr(97 + (k * f) % 19) + str(k) for k in range(70)) for f in (3, 7))
    for rows in ([(1, first), (2, first), (2, other)], [(1, first), (2, other), (2, first)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert found(docs) == brute([(i, t.encode()) for i, t in rows])


def test_long_texts_are_hashed_piece_by_piece(monkeypatch):
    rng = random.Random(2)
    text = bytes(rng.choice(b"ab c") for _ in range(3000))
    whole = sd.segments([text, text[100:900]])
    monkeypatch.setattr(sd, "PIECE", 64)
    assert all((a == b).all() for a, b in zip(whole, sd.segments([text, text[100:900]])))


def test_query_against_sql(spark, sf_small):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_small}/documents.parquet'")
    want = sorted(db.execute(sd.OP3_SQL).fetchall())
    assert sorted(map(tuple, sd.op3_suffix_array(spark, sf_small).collect())) == want


@pytest.mark.parametrize("long", [10, 10**9])
def test_earliest_documents_of_windows(monkeypatch, long):
    """Every window of every segment gets the first document that starts it, also where only recurring parts are compared."""
    monkeypatch.setattr(sd, "LONG", long)
    rng = random.Random(12)
    pool = ["".join(rng.choices("ab c", k=90)) for _ in range(6)]
    key, bodies, least = [], [], []
    for _ in range(150):
        text = rng.choice(pool)
        a = rng.randrange(30)
        body = rng.choice(["", "".join(rng.choices("abc", k=rng.randrange(9)))]) + text[a : a + rng.randint(50, 90)]
        if len(body) >= 50:
            key.append(rng.randrange(3))
            bodies.append(body.encode())
            least.append(rng.randrange(40))
    first = {}
    for k, body, d in zip(key, bodies, least):
        for p in range(len(body) - 49):
            w = (k, body[p : p + 50])
            first[w] = min(first.get(w, d), d)
    found = [[least[i]] * (len(b) - 49) for i, b in enumerate(bodies)]
    for i, a, b, d in zip(*(x.tolist() for x in sd.earliest(np.array(key, np.uint64), bodies, np.array(least)))):
        for p in range(a, b):
            found[i][p] = min(found[i][p], d)
    assert found == [[first[k, b[p : p + 50]] for p in range(len(b) - 49)] for k, b in zip(key, bodies)]


def test_long_texts_dont_keep_short_ones_waiting(monkeypatch):
    """Only what may recur goes into suffix arrays, and one long text isn't stepped through beside many short ones."""
    rng = random.Random(5)
    rows = [(k, "".join(rng.choices("abcdefgh ", k=80))) for k in range(300) for _ in range(2)]  # nothing recurs
    rows += [(k, text) for k in range(300, 340) for text in ["".join(rng.choices("abcdefgh ", k=60))] for text in (text, text + "!")]
    hot = "".join(rng.choices("abcdefgh ", k=6000))
    rows += [(999, hot), (999, "?" + hot[7:])]
    seen = []
    singly, beside = sd.suffix_array, sd.suffix_arrays
    monkeypatch.setattr(sd, "suffix_array", lambda text: seen.append(("singly", len(text))) or singly(text))
    monkeypatch.setattr(sd, "suffix_arrays", lambda symbols, sizes: seen.append(("beside", int(sizes.max()), len(symbols))) or beside(symbols, sizes))
    key, bodies = np.array([k for k, _ in rows], np.uint64), [t.encode() for _, t in rows]
    early = {i: [0] * (len(b) - 49) for i, b in enumerate(bodies)}
    for i, a, b, d in zip(*(x.tolist() for x in sd.earliest(key, bodies, np.arange(len(rows))))):
        if d < i:
            early[i][a:b] = [1] * (b - a)
    assert {i: sum(x) for i, x in early.items() if any(x)} == {**{600 + 2 * k + 1: 11 for k in range(40)}, 681: 6000 - 7 - 49}
    assert max(x[1] for x in seen if x[0] == "beside") < 200 and ("singly", 6000 - 7 + 1) in seen  # equal parts are one text
    assert sum(x[-1] for x in seen) < 6000 + 40 * 62


def test_recurring_windows_are_found_block_by_block(monkeypatch):
    rng = random.Random(8)
    pool = ["".join(rng.choices("ab c", k=120)).encode() for _ in range(4)]
    texts = [rng.choice(pool)[rng.randrange(40) : rng.randrange(91, 120)] for _ in range(80)]
    key = np.sort(np.array([rng.randrange(20) for _ in texts], np.uint64))
    whole = sd.recurring(texts, key)
    monkeypatch.setattr(sd, "JUDGED", 150)
    assert len(whole[0]) and all(np.array_equal(a, b) for a, b in zip(whole, sd.recurring(texts, key)))
