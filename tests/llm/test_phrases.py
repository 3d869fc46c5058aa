"""Phrase mining against plain counting of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lumaframe.llm import phrases as P


def plain(rows, least, longest=5):
    """{(lang, phrase): (a, l, r, n, score)} by dictionaries and Python's integers."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang, text = lang or "und", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = tuple(re.findall("[^ \t]+", piece))
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, w[i : i + k]) for i in range(len(w) - k + 1))
    f = {g: a for g, a in f.items() if a >= least}
    out = {}
    for (lang, w), a in f.items():
        if len(w) == 1 or any(o == lang and len(v) > len(w) and b >= a and any(v[i : i + len(w)] == w for i in range(len(v))) for (o, v), b in f.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out[lang, " ".join(w)] = (a, left, right, n[lang], score)
    return out, n


def texts():
    rng = random.Random(5)
    words = ["The", "of", "new", "YORK", "york", "É", "é", "city.", "is", "\tbig", "a;", "b", "\x0bc", "\x1cd", "\xa0", "a b c d e f"]
    rows = [(rng.choice(["en", "fr", None]), " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for _ in range(150)]
    return [*rows, ("en", None), ("xx", ""), (None, " . \n"), ("en", "a a a a a a " * 40), ("en", "a" * 5000), ("und", "new york city"), *[("en", "New York, new york")] * 9]


@pytest.mark.parametrize("bits, block", [(None, P.BLOCK), (6, 100), (17, 1)])
def test_like_plain_counting(spark, monkeypatch, bits, block):
    """Saturated bitmaps (64 bits) let more through and change nothing; nor do small blocks."""
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "KNOWN_WORDS", 5 if block < 1000 else 1000)
    monkeypatch.setattr(P, "SLICE", 40 if block < 1000 else 1 << 22)
    rows = texts()
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "lang string, text string, n int, phrase string").repartition(3)
    want, n = plain(rows, 8)
    got = {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in P.collocations(docs, 8, bits=bits).collect()}
    assert got == want and len({lang for lang, _ in want}) == 3 and max(len(p.split(" ")) for _, p in want) == 5
    totals, _ = P.frequent_phrases(docs, 8, bits=bits)
    assert {r.lang: r.n for r in totals.collect()} == {k: v for k, v in n.items() if k != "xx"}


def test_nothing_and_nothing_frequent(spark):
    docs = spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")
    assert P.collocations(docs).count() == 0 and P.collocations(docs.limit(0)).count() == 0


def test_equal_hashes_are_told_apart():
    ids = np.array([1, 2, 0, 3, 4, 0, 1, 2, 0])
    at, n = P.counted(ids, np.array([0, 3, 6]), np.zeros(9, np.uint64), 2)
    assert sorted(zip(ids[at].tolist(), n.tolist(), strict=True)) == [(1, 2), (3, 1)]


def test_pruned_before_counting():
    """Pass 2 counts a pair only if its bucket is set and both words may be frequent."""
    ids, numbers = np.array([1, 2, 1, 3, 0]), np.array([0, 11, 12, 13], np.uint64)
    own, every, none = numbers[ids], np.full(8, 255, np.uint8), np.zeros(8, np.uint8)
    assert P.may_be_frequent(ids, own, 2, 7, (every, every)).tolist() == [True, True, True, False]
    assert not P.may_be_frequent(ids, own, 2, 7, (none, every)).any()
    words = none.copy()
    for h in P.rolled(numbers[[1, 2]], 1, 7).tolist():
        words[h % 64 // 8] |= 1 << h % 8
    assert P.may_be_frequent(ids, own, 2, 7, (every, words)).tolist()[:2] == [True, True]


def test_query(spark):
    """The query's ranks against plain counting, few enough for every phrase to be in it."""
    sf = "/root/testdata/sf0.001"
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    want, _ = plain(rows, 100)
    got = P.op13_phrases(spark, sf).collect()
    assert {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in got} == want
    for lang in {r.lang for r in got}:
        own = sorted((r for r in got if r.lang == lang), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        assert own == sorted(own, key=lambda r: (-r.score, -r.a, r.phrase.encode()))
