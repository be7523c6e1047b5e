import random
import time

import numpy as np
import xxhash

from loadlens.llm import simhash


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    label = dict(zip(ids, ids))
    changed = True
    while changed:
        changed = False
        for a, x in zip(ids, fps):
            for b, y in zip(ids, fps):
                if (x ^ y).bit_count() <= 4 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "BETA", "gamma", "ÉTÉ", "delta", "eps", "z"]
    texts = [None, "", " \n\t", "one", "One", "a b c", "x\x0by\x0cz w v"]
    for _ in range(25):
        base = [rng.choice(words) + str(rng.randrange(50)) for _ in range(rng.randrange(3, 60))]
        for _ in range(4):
            copy = list(base)
            if rng.random() < 0.6:
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(rng.choice([" ", "\n", "  "]).join(copy))
    ids = list(range(len(texts)))
    docs = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts)], "doc_id long, text string, fp int")
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    label = brute_components(ids, fps)
    assert got == {i: (fps[i], label[i]) for i in ids}


def test_links_find_every_pair_in_radius(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), False))) for c in centres for _ in range(8)]
    fps = sorted({int(x) for x in [*centres, *near]})
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    label = {x: x for x in fps}
    for _ in fps:
        for e in edges:
            a, b = e.u % 2**64, e.v % 2**64
            label[a] = label[b] = min(label[a], label[b])
    expected = brute_components(fps, fps)
    assert label == expected


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []
    docs = spark.createDataFrame([(3, "a b c d e", "k"), (3, "a b c d e", "k"), (4, "a b c d e", "l"), (9, "q", "m")], "doc_id long, text string, label string")
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [3, 9]
    assert simhash.one_of_each(docs).columns == docs.columns


def test_odd_ids_keep_unlike_documents(spark):
    long = [" ".join(f"{w}{k}" for k in range(60)) for w in "abcd"]
    rows = [(None, long[0], 1), (None, long[1], 2), (None, long[0], 3), (5, long[2], 4), (5, long[3], 5), (None, long[3], 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place_0 int")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.text[0] for r in kept.collect()) == ["a", "b", "c", "d"]
    assert {r.place_0 for r in kept.collect()} >= {2, 4, 5}
    assert simhash.one_of_each(docs.limit(0)).collect() == []


def test_dense_group_is_not_paired():
    rng = np.random.default_rng(9)
    fps = {int(rng.integers(0, 2**63))}
    centre = next(iter(fps))
    while len(fps) < 10_000:
        fps.add(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), False)))
    fps = np.array(sorted(fps), np.uint64)
    began = time.perf_counter()
    label = simhash.Forest(fps, np.zeros(len(fps), np.int64), 4).connected()
    assert (label == 0).all() and time.perf_counter() - began < 3


def test_groups_stay_apart_and_trees_find_all(spark):
    rng = np.random.default_rng(4)
    fps, group = [], []
    for g in range(30):
        own = {int(x) & ~0xFFFF | g for x in rng.integers(0, 2**63, 3, dtype=np.uint64)}
        own |= {x ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), False)) for x in list(own) for _ in range(12)}
        fps += sorted(own)
        group += [g] * len(own)
    fps, group = np.array(fps, np.uint64), np.array(group)
    label = simhash.Forest(fps, group, 4).connected()
    for g in range(30):
        at = np.flatnonzero(group == g)
        want = brute_components(at.tolist(), [int(x) for x in fps[at]])
        assert {int(i): int(label[i]) for i in at} == want


def test_query(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    fps = [brute_fingerprint(d.text) for d in docs]
    label = brute_components([d.doc_id for d in docs], fps)
    want = {d.doc_id: (f"{fp:016x}", label[d.doc_id]) for d, fp in zip(docs, fps)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op7_simhash_bk(spark, sf_small).collect()} == want
