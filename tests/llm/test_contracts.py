"""Queries over small tables against plain versions; columns that clash, repeated rows, null ids, small splits."""

import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumaframe.llm import chat, pii, simhash, substrings, topk, warc
from lumaframe.llm.common import new_path

RNG = np.random.default_rng(13)


def prose(n):
    return " ".join(f"w{x}" for x in RNG.integers(0, 500, n))


def plain_fingerprint(text):
    w = text.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op5_fingerprints_and_components(spark, tmp_path):
    texts = [prose(int(n)) for n in RNG.integers(1, 300, 40)]
    texts += [texts[0].upper(), texts[1] + " more", None, "", " \t", "One two", "Éa Éa Éa Éa", texts[5] + " " + prose(2), texts[6] + "\n"]
    rows = [(i * 3 if i != 7 else None, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = simhash.op5_simhash(spark, str(tmp_path)).collect()
    fp = [plain_fingerprint(t or "") for _, t in rows]
    group = list(range(len(rows)))
    for _ in range(len(rows)):
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fp[i] ^ fp[j]).bit_count() <= 2:
                    group[i] = group[j] = min(group[i], group[j])
    low = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == sorted(((rows[i][0], f"{fp[i]:016x}", low[group[i]]) for i in range(len(rows))), key=key)


def test_op9_query_against_brute_force(spark, tmp_path):
    shared = prose(160)
    texts = [prose(120), prose(50) + " " + shared, shared[:700] + " é " + prose(40), shared[:399], None, "", "ab" * 600, prose(55) + "x" * 10, shared[100:520] * 3]
    few = " ".join("abcdefgh"[int(k)] for k in RNG.integers(0, 8, 60))  # a passage of 60 words in 119 bytes
    texts += [f"{prose(20)} {few} {prose(9)}", f"{prose(3)} {few}"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in substrings.op9_substrings(spark, str(tmp_path)).collect()}
    data = [(t or "").encode() for t in texts]
    places = {}
    for i, d in enumerate(data):
        for at in range(len(d) - 399):
            places.setdefault(d[at : at + 400], []).append((i, at))
    gone = [set() for _ in data]
    for found in places.values():
        if len(found) > 1:
            for i, at in found:
                gone[i].update(range(at, at + 400))
    for i, d in enumerate(data):
        kept = bytes(b for at, b in enumerate(d) if at not in gone[i])
        spans = sum(at - 1 not in gone[i] for at in gone[i])
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(d), len(gone[i]), spans, hashlib.sha256(kept).hexdigest())
    words = [d.split() for d in data]
    for i, w in enumerate(words):
        own = {tuple(w[k : k + 50]) for k in range(len(w) - 49)}
        grams = {tuple(w[k : k + 25]) for k in range(len(w) - 24)}
        others = [x for j, x in enumerate(words) if j != i]
        if any(own & {tuple(x[k : k + 50]) for k in range(len(x) - 49)} for x in others):
            assert got[i].n_passages > 0
        if not any(grams & {tuple(x[k : k + 25]) for k in range(len(x) - 24)} for x in others):
            assert got[i].n_passages == 0
    assert got[9].n_removed == got[10].n_removed == 0 and got[9].n_passages and got[10].n_passages


def test_archives_read_in_small_splits(spark):
    rows = [(i, f"u{i}", "WARC/1.0\r\n" * (i % 3) + prose(30) + "\r\n\r\nWARC/1.0\r\n") for i in range(40)]
    path = new_path(spark, "warc")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_warc(pages.withColumn("digest", F.lit("d")).withColumn("bytes", F.lit(1)), path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {r.page_id: (r.bytes, r.digest, r.kind) for r in warc.read_warc(spark, path).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: (len(h), warc.digest(h.encode()), "response") for i, _, h in rows}


def test_chats_with_clashing_columns_and_repeated_rows(spark):
    rows = [(1, 0, "user", "q", 5), (1, 0, "user", "q", 5), (1, 1, "assistant", "a", 5), (None, 0, "user", "n", 5), (None, 1, "assistant", None, 5)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, branch int")
    got = {r.tree_id: chat.parse(r.formatted) for r in chat.format_chats(chat.conversations_as_trees(table)).collect()}
    assert got == {1: [("user", "q"), ("user", "q"), ("assistant", "a")], None: [("user", "n"), ("assistant", "")]}
    tree = spark.createDataFrame([(1, 1, None, "user", "q", 0.0, 9), (1, 2, 1, "assistant", "a", 1.0, 9)], "tree_id long, message_id long, parent_id long, role string, text string, score double, depth int")
    assert [chat.parse(r.formatted) for r in chat.format_chats(tree).collect()] == [[("user", "q"), ("assistant", "a")]]


def test_personal_data_with_clashing_columns_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a@b.de", "k", 3), (1, "a@b.de", "k", 3), (2, None, "k", 3)], "doc_id long, text string, email string, pii int")
    found = pii.find_pii(docs).collect()
    assert sorted((r.doc_id, r.email, len(r.pii)) for r in found) == [(1, "k", 1), (1, "k", 1), (2, "k", 0)]
    assert sorted(map(str, pii.redact(docs).collect())) == sorted(map(str, spark.createDataFrame([(1, "[EMAIL]", "k", 3), (1, "[EMAIL]", "k", 3), (2, None, "k", 3)], docs.schema).collect()))


@pytest.mark.parametrize("block", [8, 1000])
def test_top_k_with_clashing_columns_wide_numbers_and_few_rows(spark, block):
    vectors = [[int(x) for x in RNG.integers(-300, 300, 6)] for _ in range(30)] + [[1 << 17, -(1 << 17), 3, 0, 0, 0], [0] * 6]
    rows = [(100 + i, i if i % 11 else None, v, "r", 1) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "uid long, vec_id long, v array<long>, queries string, p int")
    got = topk.top_k(df, df.where("uid % 5 = 0"), 4, block=block, together=3).collect()
    want = []
    for u, q, v, *_ in rows:
        if u % 5 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i is None, i or 0) for o, i, w, *_ in rows if o != u)[:4]
            want += [(str(q), k + 1, str(None if none else i), -s) for k, (s, none, i) in enumerate(best)]
    assert sorted((str(r.query_id), r["rank"], str(r.vec_id), r.score) for r in got) == sorted(want)
    assert len(topk.top_k(df.limit(3), df.limit(3), 20).collect()) == 6
