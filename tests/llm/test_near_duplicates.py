"""The near-duplicate stage against brute-force Jaccard, with crowded templates and copies at 0.8 to 0.9."""

import numpy as np
import pytest

from lumaframe.llm import simhash


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 1 << 40, n)]


def texts():
    rng = np.random.default_rng(3)
    out = []
    for _ in range(2):
        template = words(rng, 340)
        made = [template + words(rng, 60) for _ in range(60)]
        for w in made[:30]:
            # in the template, so that the copy shares with the others what it shares with its original
            copy = list(w)
            for at in rng.choice(340, int(rng.integers(3, 9)), replace=False):
                copy[at] = words(rng, 1)[0]
            made.append(copy)
        out += made
    for _ in range(20):
        w = words(rng, 200)
        near = list(w)
        for at in rng.choice(190, 5, replace=False):
            near[at] = "edit"
        out += [w, near]
    out += [words(rng, n) for n in (0, 1, 4, 5, 6, 90)]
    return [" ".join(w) for w in out]


def brute(texts):
    """Kept positions: the first of each component of pairs of Jaccard similarity 0.8 or more."""
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    group = list(range(len(sets)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    n = 0
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= 0.8 * (len(a) + len(sets[j]) - both):
                n += 1
                x, y = sorted((top(i), top(j)))
                group[y] = x
    return {i for i in range(len(sets)) if top(i) == i}, n


def test_no_pair_in_a_crowded_template_is_missed(spark):
    all_texts = texts()
    expected, pairs = brute(all_texts)
    docs = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert pairs >= 50 and got == expected


@pytest.mark.parametrize("work", [1 << 20, 8])
def test_prefix_pairs_hold_every_similar_pair(spark, work):
    all_texts = texts()
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in all_texts]
    similar = set()
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and both >= 0.8 * (len(a) + len(sets[j]) - both):
                similar.add((i, j))
    docs = spark.createDataFrame(list(enumerate(all_texts)), "uid long, text string")
    ranks = spark.sparkContext.broadcast(simhash.commonness(docs, 5, 16))
    signed = docs.selectExpr("uid", "uid as component", "text").select("uid", "component", simhash.prefixes(5, 0.8, ranks)("text").alias("s"))
    got = {(r.u, r.v) for r in simhash.prefix_pairs(signed.select("uid", "component", "s.*"), 0.8, work).collect()}
    assert similar <= got and len(got) < 2 * len(similar)


def test_commonness_is_the_number_of_texts_however_they_are_dealt(spark):
    texts = [" ".join(f"w{(i * k) % 41}" for k in range(30)) for i in range(60)] + [None, "", "w1"]
    rows = spark.createDataFrame([(t,) for t in texts if t is not None], "text string")
    n = np.zeros(1 << 15, np.int64)
    for t in texts:
        if t is not None:
            n[np.unique(simhash.shingle_hashes(t.encode(), 5) >> np.uint64(64 - 15))] += 1
    want = np.minimum(255, np.round(8 * np.log2(n + 1.0))).astype(np.uint8)
    for parts in (1, 7):
        assert (simhash.commonness(rows.repartition(parts), 5, 15) == want).all()
    assert not simhash.commonness(rows.limit(0), 5, 15).any()
