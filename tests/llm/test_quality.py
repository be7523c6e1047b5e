import random

import numpy as np

from loadlens.llm import quality


def test_scoring_equals_the_mean_of_all_vectors():
    rng = np.random.default_rng(1)
    weight, bias = rng.normal(size=quality.BUCKETS).astype(np.float32), 0.25
    for text in (b"", b"one", b"one one two", "été déjà vu vu vu".encode(), b"x" * 500):
        keys, parts = quality.features(text, {})
        z = bias + float(parts @ weight[keys])
        assert abs(quality.score(text, weight, bias, {}) - 1 / (1 + np.exp(-z))) < 1e-4


def test_learns_from_labels_and_keeps_all_rows(spark):
    rng = random.Random(3)
    good = ["river", "mountain", "valley", "forest", "lake"]
    bad = ["BUY!!", "CHEAP!!", "WIN!!", "NOW!!"]
    rows = [(i, " ".join(rng.choices(good if i % 2 else bad + good[:1], k=30)), i % 2) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "q") for i, t, _ in rows] + [(300, None, "q"), (301, "", "q"), (7, rows[7][1], "q")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i < 200] + [(5, None), (6, 9)], "doc_id long, quality int")
    weight, bias = quality.train(*quality.sampled(docs, labels, "quality"))
    got = quality.scores(docs, weight, bias).collect()
    assert len(got) == 303
    held = [(r.score >= 0.5) == r.doc_id % 2 for r in got if 200 <= r.doc_id < 300]
    assert sum(held) / len(held) > 0.97
    assert len({r.score for r in got if r.doc_id >= 300}) == 1
    again = quality.train(*quality.sampled(docs, labels, "quality"))
    assert np.array_equal(again[0], weight)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    weight, bias = quality.train(*quality.sampled(docs, labels, "quality"))
    assert [round(r.score, 3) for r in quality.scores(docs, weight, bias).collect()] == [0.5]
    assert quality.scores(docs.limit(0), weight, bias).collect() == []
