"""Each operator against a plain version, with nulls, empty and long texts, ties, repeated rows, empty tables
and extra columns whose names clash."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaframe.llm import chat, decontaminate, langid, lm, packing, pii, simhash, substrings, topk, warc
from lumaframe.llm.common import connected_components, new_path

RNG = np.random.default_rng(7)
WORDS = ["alpha", "beta", "gamma", "delta", "eins", "zwei", "drei", "été", "naïve", "omega"]
PASSAGE = " ".join(RNG.choice(WORDS, 120).tolist())


def prose(n):
    return " ".join(RNG.choice(WORDS, n).tolist())


LONG = prose(15_000)
TEXTS = [None, "", " ", "x", PASSAGE, "Before. " + PASSAGE + " after", PASSAGE, LONG, prose(9), prose(40), "123 !!", "aaaa" * 400, "Z" * 3000, PASSAGE[:410] + "#" + PASSAGE[300:]]
SCHEMA = "doc_id long, text string, row string, uid long, n int, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 9 else None, t, "r", 1, 2, "ab"[i % 2] if i % 5 else None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("block_rows", [200_000, 20])
def test_decontaminate(spark, docs, nothing, block_rows):
    items = [(1, PASSAGE[:300]), (2, "Été, NAÏVE"), (3, None), (4, ""), (None, "alpha"), (5, "x"), (5, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(docs, bench, block_rows=block_rows).collect()
    wins = {}
    for i, t in items:
        w = decontaminate.words((t or "").encode())
        if w:
            for k in range(max(1, len(w) - 9)):
                wins.setdefault(tuple(w[k : k + 10]), set()).add(i)
    assert len(got) == len(TEXTS) + 1
    for r in got:
        w, hit, ids = decontaminate.words((r.text or "").encode()), set(), set()
        for win, items_ in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    ids |= items_
        c = r.contamination
        assert (c.n_words, {i for s in c.spans for i in range(s.start, s.end)}, c["items"]) == (len(w), hit, sorted(ids, key=lambda i: (i is None, i or 0)))
    assert decontaminate.find_contamination(nothing, bench).count() == 0
    clean = decontaminate.find_contamination(docs, bench.limit(0)).collect()
    assert all(not r.contamination.spans for r in clean)


def test_warc_round_trip_with_magic_in_payloads(spark, nothing):
    bad = "x\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 1\r\n\r\na\r\n\r\nWARC/1.0\r\n"
    rows = [(1, "u", "a"), (2, "u\r\nX: y", "a"), (3, None, None), (4, "v", ""), (5, "w", bad), (6, "w", bad), (None, "n", "é\n"), (8, "w", bad + "WARC/1.0\r\n" + "é" * 50_000), (2, "u", "a")]
    path = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = warc.resolve_revisits(warc.read_warc(spark, path)).collect()
    first = {}
    for i, _, h in rows:
        first[h or ""] = max(first.get(h or "", -1), -1 if i is None else i)
    expected = []
    for i, _, h in rows:
        p = (h or "").encode()
        again = i is not None and first[h or ""] != i
        expected.append((str(i), len(p), warc.digest(p), "revisit" if again else "response", str(first[h or ""] if again else None)))
    assert sorted((str(r.page_id), r.bytes, r.digest, r.kind, str(r.refers_to)) for r in got) == sorted(expected)
    path = new_path(spark, "warc")
    warc.write_warc(nothing.selectExpr("doc_id as page_id", "text as url", "text as html"), path)
    assert warc.read_warc(spark, path).count() == 0


def test_language_network(spark, docs, nothing):
    a, b = ["der die und nicht sch ei" * 30] * 30, ["the of and thing wh ing" * 30] * 30
    p = langid.train([t.encode() for t in a + b], np.array([0] * 30 + [1] * 30), 2)
    assert langid.pooled(p, [b"die und nicht ei schei", b"the thing and of wh", b""]).argmax(1)[:2].tolist() == [0, 1]
    text, label = np.array([[100, 101], [0, 255]], np.uint8), np.array([0, 1])
    inside = np.array([[1, 1], [1, 0]], np.float32)
    _, grad = langid.gradients(p, text, label, inside)
    for key, at in (("u", (0, 1, 2)), ("u", (1, 2, 8)), ("x", (1, 101, 3)), ("v", (2, 1))):
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[key][at] += 1e-2
        down[key][at] -= 1e-2
        slope = (langid.gradients(up, text, label, inside)[0] - langid.gradients(down, text, label, inside)[0]) / 2e-2
        assert abs(slope - grad[key][at]) < 2e-3
    out = {r.doc_id: r.language for r in langid.label_language(docs, (["de", "en"], p)).collect()}
    assert all(out[i].lang == "und" and out[i].score == 0 for i in (0, 1, 2, 10)) and all(0 <= x.score <= 1 for x in out.values())
    assert langid.fit(nothing)[0] == [] and langid.label_language(nothing, langid.fit(nothing)).count() == 0


def test_chat(spark):
    tree = [(1, 1, None, "user", "q<|im_end|>", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good\\", 0.9), (1, 4, 3, "user", None, 0.5), (2, 1, 9, None, "root", None), (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0)]
    rows = spark.createDataFrame(tree, "tree_id long, message_id long, parent_id long, role string, text string, score double")
    got = {(r.tree_id, r.branch): r for r in chat.format_chats(rows, 2).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1)}
    assert chat.parse(got[1, 1].formatted) == [("user", "q<|im_end|>"), ("assistant", "good\\"), ("user", "")]
    r = got[1, 2]
    assert [r.formatted[s.start : s.end] for s in r.loss] == ["bad"] and chat.parse(got[2, 1].formatted) == [("", "root")]
    assert chat.format_chats(rows.limit(0)).count() == 0
    for t in ("", "<|", "\\<|", "<\\|", "\\n", "\n", "<", "<<|im_end|>"):
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)


@pytest.mark.parametrize("tau,crowd", [(2, 4096), (2, 1), (4, 64)])
def test_fingerprint_links(spark, tau, crowd):
    base = RNG.integers(-(1 << 63), 1 << 63, 30, dtype=np.int64)
    fps = {int(b) for b in base} | {0, -1}
    for b in base[:10]:
        for _ in range(12):
            flips = sum(1 << int(bit) for bit in RNG.choice(64, RNG.integers(1, 6), replace=False))
            fps.add(int(b) ^ (flips - (1 << 64) if flips >> 63 else flips))
    got = connected_components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), tau, crowd))
    label = {f: f for f in fps} | {r.node: r.component for r in got.collect()}
    group = {f: f for f in fps}

    def top(f):
        while group[f] != f:
            f = group[f]
        return f

    for f in fps:
        for g in fps:
            if f < g and ((f ^ g) & (1 << 64) - 1).bit_count() <= tau:
                a, b = sorted((top(f), top(g)))
                group[b] = a
    assert {f: label[f] for f in fps} == {f: top(f) for f in fps}


def test_simhash_and_near_duplicates(spark, docs, nothing):
    out = {r.doc_id: r for r in simhash.fingerprint_components(docs).collect()}
    assert out[0].fp == out[1].fp == out[2].fp == 0 and out[2].component_id == 0 and out[6].component_id == 4
    assert simhash.fingerprint_components(nothing).count() == 0 and simhash.drop_near_duplicates(nothing).count() == 0
    near = PASSAGE + " one more"
    more = spark.createDataFrame([(50, near, "r", 1, 2, None), (51, prose(200), "r", 1, 2, None)], SCHEMA)
    kept = simhash.drop_near_duplicates(docs.union(more))
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids))
    assert 4 in ids and 51 in ids and 7 in ids and not {1, 2, 5, 6, 50} & set(ids)


def test_pii(spark, nothing):
    luhn = "4532015112830366"
    texts = [
        (1, f"é mail a.b@c.de, ip 10.0.0.255 or 10.0.0.256, card {luhn[:4]} {luhn[4:8]} {luhn[8:]}, call +49 (30) 1234-5678."), (2, None), (3, ""),
        (4, "iban GB82 WEST 1234 5698 7654 32"), (5, "a@b.c%x@d.e"), (6, "x" * 50_000 + "@" + "1" * 50_000), (7, "token = " + "0a" * 20), (8, "plain " + "0a" * 20),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: [(x.kind, x.start, x.end) for x in r.pii] for r in pii.find_pii(docs).collect()}
    t = texts[0][1]
    at = lambda s: (t.index(s), t.index(s) + len(s))
    assert got[1] == [("email", *at("a.b@c.de")), ("ip", *at("10.0.0.255")), ("card", *at(f"{luhn[:4]} {luhn[4:8]} {luhn[8:]}")), ("phone", *at("+49 (30) 1234-5678"))]
    assert got[2] == got[3] == got[6] == got[8] == [] and [x[0] for x in got[4]] == ["iban"] and [x[0] for x in got[7]] == ["secret"]
    assert got[5] == [("email", 0, 5), ("email", 5, 11)]
    red = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert red[2] is None and red[5] == "[EMAIL][EMAIL]" and "[CARD], call [PHONE]." in red[1]
    assert pii.redact(nothing).count() == 0


def test_language_model(spark, docs, nothing):
    learn = F.col("doc_id") < 8
    rows = lm.score_texts(docs, learn, top=4).collect()
    count = Counter(k for t in TEXTS[:8] + [TEXTS[4]] for k in lm.keys((t or "").encode()))
    total, distinct = sum(count.values()), len(count)
    for r in rows:
        keys = lm.keys((TEXTS[9 if r.doc_id is None else r.doc_id] or "").encode())
        base = sum(np.log10((count[k] + 1) / (total + distinct + 1)) for k in keys)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(keys), sum(k in count for k in keys), total)
        assert abs(r.base_score - base) < 1e-6 * max(1, -base) and r.score < 0
    assert len(rows) == len(TEXTS) + 1 and lm.score_texts(docs, F.lit(False)).count() == len(rows) and lm.score_texts(nothing).count() == 0


@pytest.mark.parametrize("top", [3, 200])
def test_language_model_scores_like_a_plain_one(spark, monkeypatch, top):
    """Over words, kept or not, broadcast or joined, and unseen ones: whole texts against loops, and all
    probabilities of a context add up to 1."""
    monkeypatch.setattr(lm, "OWN", 4)
    monkeypatch.setattr(lm, "LEAST_KEPT", 20)
    monkeypatch.setattr(lm, "HASHED", 8)
    texts = [" ".join(f"{WORDS[int(k) % 9]}{k}" for k in RNG.zipf(1.3, 60) % 90) for _ in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", "never seen alpha0 WORDS"])], "doc_id long, text string")
    _, _, total, vocab = lm.gather(docs.where("doc_id < 12"), top)
    p = lm.start(vocab)
    p[:, : lm.DIM] *= 9
    monkeypatch.setattr(lm, "train", lambda coded, blob: p)
    count = Counter(k for t in texts for k in lm.keys(t.encode()))
    order = sorted(count, key=lambda w: (-count[w], w))
    order = [w for w in order if w in vocab.index]
    kept = order[: vocab.kept]
    own = [w for w in kept if w != lm.END][:4]
    group = lambda w: zlib.crc32(w[:3]) % vocab.groups
    members = {g: [w for w in kept if w != lm.END and w not in own and group(w) == g] for g in range(vocab.groups)}

    def row(w, place):
        at = -1 if w is None else kept.index(w) if w in kept else len(kept) + zlib.crc32(w) % 8
        return p[place * (len(kept) + 9) + (len(kept) + 8 if w is None else at)]

    def softmax(x):
        e = np.exp(np.array(x, float) - max(x))
        return e / e.sum()

    def probability(w, before):
        h = sum(row(x, k)[: lm.DIM].astype(float) for k, x in enumerate(before))
        by = lambda table: softmax([r[: lm.DIM].astype(float) @ h + r[lm.DIM] for r in table])
        classes = by(p[vocab.q : vocab.w])
        if w in own or w == lm.END:
            return classes[own.index(w) if w in own else 4]
        g = group(w)
        inner = by(p[vocab.w + vocab.first[g] : vocab.w + vocab.first[g + 1]])
        if w in members[g]:
            return classes[5 + g] * inner[members[g].index(w)]
        rest = [x for x in count if x != lm.END and x not in own and group(x) == g and x not in members[g]]
        return classes[5 + g] * inner[-1] * (count[w] + 1) / (sum(count[x] for x in rest) + len(rest) + 1)

    for r in lm.score_texts(docs, F.col("doc_id") < 12, top).collect():
        keys = lm.keys(([*texts, "", "never seen alpha0 WORDS"][r.doc_id]).encode())
        padded = [None] * lm.ORDER + keys
        plain = sum(np.log10(probability(w, [padded[lm.ORDER + i - 1 - k] for k in range(lm.ORDER)])) for i, w in enumerate(keys))
        assert abs(r.score - plain) < 1e-4 * len(keys)
    before = lm.contexts(vocab, np.array([0, 1, 2, 0]))[2:3]
    choices = [(c, -1) for c in range(5)] + [(5 + g, vocab.first[g] + k) for g in range(vocab.groups) for k in range(vocab.first[g + 1] - vocab.first[g])]
    cls, out = (np.array(x) for x in zip(*choices, strict=True))
    logs = lm.log_words(p, vocab, np.repeat(before, len(cls), axis=0), cls, out)
    assert abs((10**logs).sum() - 1) < 1e-5


def test_language_model_learns(spark):
    texts = ["a b c d e f " * 200] * 40 + ["x y z " * 400] * 40
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    rows = lm.score_texts(docs).collect()
    assert sum(r.score for r in rows) > 0.8 * sum(r.base_score for r in rows)


def test_top_k(spark):
    x = [[None, 1.0]] + [None, [float("nan"), 0.0], []] + [[float(a), float(b)] for a, b in RNG.normal(0, 1, (60, 2))] + [[0.5, 0.5]] * 3
    rows = [(i, v) for i, v in enumerate(x)] + [(60, x[60])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("vec_id", "embedding", "monotonically_increasing_id() as uid")
    df = df.select("uid", "vec_id", topk.integers(64)("embedding").alias("v"))
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), 5).collect()
    good = [(r.uid, r.vec_id, r.v) for r in df.collect() if r.v]
    expected = []
    for u, q, v in good:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for o, i, w in good if o != u)[:5]
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(expected)
    small = topk.top_k(df, df.where("vec_id % 20 = 0"), 5, block=7, together=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in small) == sorted(expected)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("length,q", [(400, 64), (20, 8)])
def test_repeats(spark, docs, nothing, length, q):
    span = substrings.remove_repeats(docs, length) if q == 64 else None
    uids = docs.where("length(text) < 20000").selectExpr("monotonically_increasing_id() as uid", "text").collect()
    rows = spark.createDataFrame(uids, "uid long, text string")
    if span is None:
        substrings.WIDTHS, before = (4, 1), substrings.WIDTHS
    try:
        got = substrings.repeated_spans(rows, length, q).collect()
    finally:
        if span is None:
            substrings.WIDTHS = before
    seen = Counter()
    texts = {r.uid: (r.text or "").encode() for r in uids}
    for t in texts.values():
        seen.update(t[i : i + length] for i in range(len(t) - length + 1))
    for u, t in texts.items():
        expected = set()
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                expected.update(range(i, i + length))
        assert {i for r in got if r.uid == u for i in range(max(0, r.start), min(len(t), r.end))} == expected
    if span is not None:
        for r in span.collect():
            assert hashlib.sha256(r.repeats.kept).hexdigest() == r.repeats.sha256
        assert substrings.remove_repeats(nothing).count() == 0


def test_packing(spark, docs, nothing):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    odd = ["a  b   c \n\n d\t\te ", "it's I'll 12 3４ ٣ 漢字　x  y", "x <|endoftext|> y", "<|endoftext|>   \x1c z", "  lead", "é́ ﷽ 🙂🙂 \r\n x"]
    more = spark.createDataFrame([(100 + i, t, "r", 1, 2, None) for i, t in enumerate(odd)], SCHEMA)
    rows = packing.pack(docs.where("doc_id <> 4").union(more), capacity=64, with_ids=True).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    texts = {i: t for i, t in enumerate(TEXTS) if i not in (4, 9)} | {100 + i: t for i, t in enumerate(odd)}
    assert set(by_doc) == set(texts)
    for i, t in texts.items():
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert np.frombuffer(b"".join(bytes(r.ids) for r in pieces), "<u4").tolist() == ids
        assert all(r.length == 64 for r in pieces[1:]) and all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in pieces)
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert packing.pack(nothing).count() == 0
    lengths = RNG.integers(1, 65, 500).tolist()
    bins = []
    for n in sorted(lengths, reverse=True):
        room = min((b for b in bins if b >= n), default=None)
        if room is None:
            bins.append(64 - n)
        else:
            bins[bins.index(room)] -= n
    placed = packing.best_fit(Counter(lengths), 64)
    used = {first + k // each for n, segs in placed.items() for j, (rank, first, each, _) in enumerate(segs) for k in range((segs[j + 1][0] if j + 1 < len(segs) else Counter(lengths)[n]) - rank)}
    assert len(used) == len(bins)
