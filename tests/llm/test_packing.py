import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from loadlens.llm import packing


def brute_best_fit(lengths, size):
    bins = []
    for x in sorted(lengths, reverse=True):
        fit = [b for b in bins if b[0] >= x]
        if fit:
            min(fit)[0] -= x
        else:
            bins.append([size - x])
    return len(bins)


def test_plan_equals_best_fit_decreasing():
    rng = random.Random(1)
    for size in (10, 64, 200):
        for _ in range(40):
            lengths = [rng.randint(1, size) if rng.random() < 0.5 else rng.randint(1, size // 4) for _ in range(rng.randint(1, 300))]
            counts = {x: lengths.count(x) for x in set(lengths)}
            runs, n = packing.plan(counts, size)
            assert n == brute_best_fit(lengths, size)
            used = {}
            for length, first, count, sequence, offset, each in runs.tolist():
                for k in range(count):
                    used.setdefault(sequence + k // each, []).append((offset + k % each * length, length))
            assert sorted(x for v in used.values() for _, x in v) == sorted(lengths)
            for v in used.values():
                end = 0
                for at, length in sorted(v):
                    assert at == end
                    end += length
                assert end <= size


def test_pieces_and_places(spark):
    rng = random.Random(2)
    words = ["Étude", "naïve,", "it's", "don't...", "42nd", "<|endoftext|>", "a<|startoftext|>b", "x y", "ΣΑΣ", "éa", "İx", "foo!!", "日本語", "tail.", "🎉🎉", "́z", "a\x1cb", "ǅ", "ß***"]
    texts = [None, "", " \n", "word " * 5000] + [" ".join(rng.choices(words, k=rng.randint(1, 900))) for _ in range(40)]
    texts += [texts[5]] * 20
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, length string")
    rows = packing.packed(docs, with_ids=True).collect()
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 2048)))
        for r in own:
            part = np.array(ids[2048 * r.piece : 2048 * r.piece + 2048], "<u4").tobytes()
            assert (r.start, r.length, r.ids_crc32, bytes(r.ids)) == (2048 * r.piece, len(part) // 4, zlib.crc32(part), part)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in places.values():
        end = 0
        for at, length in sorted(v):
            assert at == end
            end += length
        assert end <= 2048
    assert len(places) == brute_best_fit([r.length for r in rows], 2048)


def test_empty(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string")).collect() == []
