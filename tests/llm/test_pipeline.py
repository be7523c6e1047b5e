import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from loadlens.llm import clean_lines, decontaminate, pii, simhash

from .test_simhash import brute_components, brute_fingerprint


@pytest.fixture(scope="module")
def stages(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").filter("length(text) < 6000")
    out = [docs.toPandas().set_index("doc_id")]
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf_small).toPandas())
        out.append(docs.toPandas().set_index("doc_id"))
    return out


def test_columns_stay(stages):
    for rows in stages[1:-1]:
        assert list(rows.columns) == list(stages[0].columns)
        assert (rows["text"].str.len() == rows["n_chars"]).all()


def test_near_duplicates(stages):
    before, after = stages[1], stages[2]
    label = brute_components(list(before.index), [brute_fingerprint(t) for t in before["text"]])
    assert set(after.index) == {i for i in before.index if label[i] == i}


def test_benchmark_passages(spark, sf_small, stages):
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    before, after = stages[2], stages[3]
    plain = {i for i, t in before["text"].items() if any(x in " ".join(t.lower().split()) for x in items)}
    assert plain.isdisjoint(after.index)
    for i in set(before.index) - set(after.index) - plain:
        text = " ".join(before["text"][i].lower().split())
        assert any(decontaminate.edit_within(x, text) <= 0.1 * len(x) for x in items)


def test_personal_data(stages):
    before, after = stages[3], stages[4]
    assert list(sorted(before.index)) == list(sorted(after.index))
    for t in after["text"]:
        assert not pii.base_spans(t)


def test_packing(stages):
    before, after = stages[4], stages[5]
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = sum(len(whole.encode(t, add_special_tokens=False).ids) + 1 for t in before["text"])
    assert after["length"].sum() == n and after.groupby("sequence_id")["length"].sum().max() <= 2048
    assert after["sequence_id"].nunique() <= -(-n // 2048) * 1.1 + 1


def test_odd_rows(spark):
    text = " ".join(f"word{k}" for k in range(40)) + "."
    docs = spark.createDataFrame([(1, None, "a", 0), (2, "", "a", 0), (None, text, "a", 5), (4, text, None, 5), (4, text, None, 5)], "doc_id long, text string, __row string, n_chars int")
    kept = clean_lines.cleaned(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["4", "4", "None"]
    assert [r.doc_id for r in simhash.one_of_each(kept).collect()] == [4]
    assert clean_lines.cleaned(docs.limit(0)).collect() == []
