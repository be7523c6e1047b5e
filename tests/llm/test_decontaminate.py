import random

import numpy as np

from loadlens.llm import decontaminate as dec


def brute_within(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choices("abé", k=rng.randint(1, 70)))
        b = "".join(rng.choices("abé", k=rng.randint(0, 80)))
        assert dec.edit_within(a, b) == brute_within(a, b)


def words(rng, n):
    return ["".join(rng.choices("abcdefghijkl", k=rng.randint(2, 9))) for _ in range(n)]


def changed(rng, text, n):
    text = list(text)
    for _ in range(n):
        k = rng.randrange(len(text))
        text[k : k + 1] = rng.choice([[], ["q"], [text[k], "z"]])
    return "".join(text)


def test_recall_and_precision_against_brute_force(spark):
    rng = random.Random(2)
    items = [" ".join(words(rng, rng.randint(12, 45))) for _ in range(12)]
    texts, expected = [], set()
    for i in range(120):
        filler = " ".join(words(rng, 30))
        item = rng.randrange(12)
        edits = rng.choice([0, 0.03, 0.06, 0.09, 0.3])
        texts.append(f"{filler}\n{changed(rng, items[item], int(edits * len(items[item]))).upper()}\n{filler}")
    for i, t in enumerate(texts):
        for k, x in enumerate(items):
            if brute_within(x, " ".join(t.lower().split())) <= 0.1 * len(x):
                expected.add((i, k))
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(500, None, 1), (501, "", 1), (None, texts[0], 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, " \n"), (92, "two words")], "item_id long, text string")
    rows = dec.contaminated(docs, bench).collect()
    found = {(r.doc_id, r.item_id) for r in rows if r.doc_id is not None}
    assert found <= expected
    assert len(found & expected) >= 0.9 * len(expected) and len(expected) > 60
    for r in rows:
        if r.doc_id is not None:
            assert r.distance == brute_within(items[r.item_id], " ".join(texts[r.doc_id].lower().split()))
    clean = {r.doc_id for r in dec.decontaminated(docs, bench).collect()}
    assert clean == ({*range(120), 500, 501, None} - {d for d, _ in found} - ({None} if any(d == 0 for d, _ in found) else set()))


def test_short_items_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "here are Two  words"), (2, "two other words")], "doc_id long, text string")
    bench = spark.createDataFrame([(92, "two words")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in dec.contaminated(docs, bench).collect()] == [(1, 92)]
    assert dec.contaminated(docs, bench.limit(0)).collect() == []
    assert dec.contaminated(docs.limit(0), bench).collect() == []
    assert dec.decontaminated(docs, bench.limit(0)).count() == 2


def test_mean_recall_by_rate_of_edits():
    rng = random.Random(3)
    texts = [" ".join(words(rng, rng.randint(15, 40))) for _ in range(120)]
    items = dec.Items([(k, t.encode()) for k, t in enumerate(texts)])
    for rate in (0.0, 0.03, 0.06, 0.08, 0.095):
        held = [f"{' '.join(words(rng, 20))} {changed(rng, t, int(rate * len(t)))} {' '.join(words(rng, 20))}" for t in texts]
        near = [k for k, t in enumerate(held) if dec.edit_within(texts[k], t) <= 0.1 * len(texts[k])]
        found = {(r, i) for r, i, _ in items.matches([t.encode() for t in held])}
        assert all((k, k) in found for k in near) if not rate else sum((k, k) in found for k in near) >= 0.95 * len(near), rate


def test_items_without_three_words_in_a_row():
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefghijkl", k=rng.randint(4, 9))) for _ in range(24)) for _ in range(40)]
    items = dec.Items([(k, t.encode()) for k, t in enumerate(texts)])
    held = []
    for t in texts:
        own = t.split()
        for j in range(0, 24, 3):
            own[j] = own[j][:2] + "q" + own[j][3:]
        held.append(f"{' '.join(words(rng, 20))} {' '.join(own)} {' '.join(words(rng, 20))}")
    found = {(r, i) for r, i, _ in items.matches([t.encode() for t in held])}
    assert sum((k, k) in found for k in range(40)) >= 39


def test_no_window_within_the_distance_is_left_out():
    """What is walked holds, for every passage within the distance, a window at the word where it begins or beside it."""
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdé ", k=rng.randint(2, 9))).strip() or "x" for _ in range(rng.randint(2, 50))) for _ in range(150)]
    texts = [dec.normal(t.encode()).decode() for t in texts]
    items = dec.Items([(k, t.encode()) for k, t in enumerate(texts)])
    for k, t in enumerate(texts):
        own = dec.normal(changed(rng, t, int(0.1 * len(t))).encode()).decode()
        if brute_within(t, own) <= int(0.1 * len(t)):
            before = dec.normal(" ".join(words(rng, 9)).encode()) + b" "
            whole = np.frombuffer(before + own.encode() + b" zz" + bytes(8), np.uint8)
            item, start = items.windows(whole)
            assert any(i == k and abs(s - len(before)) <= items.room[k] for i, s in zip(item.tolist(), start.tolist())), (t, own)


def test_beyond_the_tables_every_window_is_decided(monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(words(rng, rng.randint(15, 40))) for _ in range(60)]
    monkeypatch.setattr(dec, "MOST_TABLES", 16)
    items = dec.Items([(k, t.encode()) for k, t in enumerate(texts)])
    assert items.exact
    held = [f"{' '.join(words(rng, 20))} {changed(rng, t, int(0.09 * len(t)))} {' '.join(words(rng, 20))}" for t in texts]
    near = {k for k, t in enumerate(held) if dec.edit_within(texts[k], t) <= 0.1 * len(texts[k])}
    assert {(r, i) for r, i, _ in items.matches([t.encode() for t in held])} >= {(k, k) for k in near}


def test_long_items_count_by_parts(spark):
    rng = random.Random(7)
    item = " ".join(words(rng, 1200))
    own = item.split()
    docs = spark.createDataFrame([(1, " ".join(own[:600])), (2, " ".join(words(rng, 600))), (3, item), (4, " ".join(words(rng, 30_000)) + " " + item)], "doc_id long, text string")
    bench = spark.createDataFrame([("long", item), ("short", " ".join(own[100:120]))], "item_id string, text string")
    rows = dec.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(k, i) for k in (1, 3, 4) for i in ("long", "short")}
    assert all(r.distance == 0 and r.item_chars <= dec.LONG for r in rows)


def test_repeated_rows_ties_and_extra_columns(spark):
    rng = random.Random(8)
    item = " ".join(words(rng, 20))
    docs = spark.createDataFrame([(1, item, 5), (1, item, 6), (None, item, 7), (2, "other text", 8)], "doc_id long, text string, distance int")
    bench = spark.createDataFrame([(1, item, "x"), (2, item, "y"), (1, item, "z")], "item_id long, text string, doc_id string")
    rows = dec.contaminated(docs, bench).collect()
    assert sorted((str(r.doc_id), r.item_id, r.distance) for r in rows) == sorted((d, i, 0) for d in ("1", "1", "None") for i in (1, 2))
    assert [tuple(r) for r in dec.decontaminated(docs, bench).collect()] == [(2, "other text", 8)]


def test_batches_with_and_without_matches(spark):
    rng = random.Random(9)
    item = " ".join(words(rng, 20))
    docs = spark.createDataFrame([(k, item if k in (3, 70) else " ".join(words(rng, 20))) for k in range(100)], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, item)], "item_id int, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    assert sorted(r.doc_id for r in dec.contaminated(docs, bench).collect()) == [3, 70]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
