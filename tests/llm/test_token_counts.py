"""Token counts against the library on whole texts: random strings, special strings, very long runs, nulls."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumaframe.llm import tokencount as T

LIBRARY = Tokenizer.from_file(T.default_tokenizer())
PIECES = list("ab's'tre 'LL\t\n\x0b\x85\xa0\x1c19²é<|>!") + ["<|endoftext|>", "İ", "ſ", "ß", "К", "漢", "é", "́", "　", "​", "ς", "Σ", "🎉"]


def library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.characters(exclude_categories=["Cs"])), max_size=25).map("".join))
def test_units_give_the_library_s_counts(text):
    two_tiers = T.Lookup(("the a ' 's".encode(), b"\1\0\1\0\1\0\1\0"), T.cache(T.default_tokenizer()))
    assert two_tiers.count(text) == library(text)
    assert sum(map(two_tiers.__getitem__, (u for part in T.slices(text, 3) for u in T.units(part)))) == library(text) or "<|endoftext|>" in text


@pytest.mark.parametrize("text", [" " * 1_200_000, "\n" * 1_200_000, "a" * 400_000, "Ab, " * 300_000, "é漢" * 100_000, " " * 1_200_000 + "漢"])
def test_very_long_texts(text):
    assert T.lookup(T.default_tokenizer(), (b"", b"")).count(text) == library(text)


def test_summaries_keep_what_is_frequent_in_any_order():
    rng = random.Random(3)
    rows = [f"w{min(int(rng.paretovariate(0.7)), 5000)}" for _ in range(40_000)]
    truth, kept = Counter(rows), []
    for size in (700, 9000, 40_000):
        total = Counter()
        for i in range(0, len(rows), size):
            total = T.shrink(total + T.shrink(Counter(rows[i : i + size]), 50), 50)
        kept.append(total)
    for total in kept:
        assert len(total) <= 50
        assert all(w in total for w, n in truth.items() if n > len(rows) / 50)


def test_count_tokens(spark):
    texts = [None, "", " ", "It's A TEST\u0085", "<|endoftext|> x<|startoftext|>", "word " * 3000, "été 漢字 " * 50, "x", "x"]
    rows = [(i if i != 3 else None, t, 7, "k") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, known string").repartition(3)
    got = T.count_tokens(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "", r.n_tokens) for r in got.collect()) == sorted((i if i and i != 3 else -1, t or "", library(t)) for i, t in enumerate(texts))
    assert T.count_tokens(docs.limit(0), "n").count() == 0
    assert T.frequent(docs)[0] == "word"


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = T.op11_tokens(spark, sf)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    rows = got.collect()
    assert len(rows) == len(texts) and any(r.over_limit for r in rows)
    for r in rows:
        n = library(texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 2048)


def test_no_pre_token_is_shuffled(spark):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    plan = T.count_tokens(docs)._jdf.queryExecution().toString()
    assert "Exchange" not in plan
