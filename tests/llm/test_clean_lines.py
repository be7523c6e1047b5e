import random
import re

import pytest

from loadlens.llm import clean_lines as cl
from loadlens.llm.queries import ORACLE, QUERIES

TEXTS = [
    None, "", " \t\n", "one", "one two\r\nthree", "Licensed under X.\nA good line, that stays.",
    "\n".join(["Same line here, again."] * 5), " ".join(["und"] * 40) + ".", " ".join(f"w{k}" for k in range(40)) + ".",
    "A | B | C | D\n" + " ".join(f"w{k}" for k in range(30)) + ".", "BUY!! NOW!! CHEAP!!\n" * 12, "a*** b$$$ c%%% d&&&\n" * 9,
    " ".join(f"w{k}" for k in range(30)), "  nbsp em \u0085 nel.\x0bvt\x0cff " * 9, "\U0001f600 emoji, text " * 12,
]


def brute_repeat(words):
    grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)}
    return len(covered)


def test_base_columns_against_plain_python(spark):
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choices("abc", k=rng.randint(1, 60))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    got = {r.doc_id: r for r in cl.line_stats(docs).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        repeat = brute_repeat(words)
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), repeat), t
        assert (r.n_symbols, r.n_dup_lines) == (len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines))), t
        assert r.base_failed == (len(words) < 20 or 100 * repeat > 30 * len(words))
        assert not (r.base_failed and r.kept)


def test_sql_agrees(spark, sf_small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_small}/documents.parquet')")
    there = con.execute(ORACLE["op6_line_rules"]).df()
    here = QUERIES["op6_line_rules"](spark, sf_small).toPandas()[list(there.columns)]
    assert sorted(here.itertuples(index=False, name=None)) == sorted(there.itertuples(index=False, name=None))


def test_rules_and_cleaning(spark):
    good = " ".join(f"word{k}" for k in range(40)) + "."
    docs = spark.createDataFrame([(1, f"{good}\nHome | News | Shop | Login\nAll rights reserved.", 0), (2, "\n".join(["Home | News | Shop | Login"] * 9), 0), (3, good, 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in cl.cleaned(docs).collect()}
    assert set(got) == {1, 3} and got[1].text == good and got[1].n_chars == len(good) and cl.cleaned(docs).columns == docs.columns
