"""Each stage of the pipeline against a plain version, on documents with clashing columns, nulls, crowded
templates, copies, benchmark passages and personal data."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline as pipeline
from lumaframe.llm import decontaminate, langid, packing, simhash

RNG = np.random.default_rng(11)
EN, DE = ["the", "of", "and", "thing", "with", "house", "water"], ["der", "die", "und", "nicht", "schule", "baum", "eis"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, uid long, language string, contamination int, pii string, h string"


def prose(words, n):
    return " ".join(f"{w}{x}" for w, x in zip(RNG.choice(words, n), RNG.integers(0, 300, n), strict=True))


ITEM = prose(EN, 24)


def texts():
    template = prose(DE, 200)
    out = [prose(EN if i % 2 else DE, int(n)) for i, n in enumerate(RNG.integers(12, 160, 24))]
    out += [f"{template} {prose(DE, 60)}" for _ in range(12)]  # too unlike each other to be duplicates
    out += [out[3], out[4] + " one more", None, "", "12 !!", "x", out[30].replace(template[:20], "kurz")]
    out += [f"{prose(EN, 30)} {ITEM[40:120]} {prose(EN, 5)}", f"{prose(DE, 9)} {ITEM.upper()}"]
    out += [f"{prose(EN, 20)} write to a.b@c.de or call +49 30 1234-5678 from 10.0.0.255, {prose(EN, 4)}", prose(EN, 3000)]
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = [(100 + i, t, ("en", "de")["der" in (t or "") or "die" in (t or "")] if t and i % 5 else None, "s", len(t or ""), "r", 1, "l", 7, "p", "h") for i, t in enumerate(texts())]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def stages(spark, tables):
    """The rows that go into each stage, and the last one's."""
    docs, out = spark.read.parquet(f"{tables}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        out.append(docs.collect())
        docs = pipeline.staged(stage(spark, docs, tables), name)
        assert name == "packing" or docs.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    return [*out, docs.collect()]


def unchanged(before, after):
    rows = {r.doc_id: r for r in before}
    return all(rows[r.doc_id] == r for r in after)


def test_language(spark, tables, stages):
    langs, p = langid.fit(spark.read.parquet(f"{tables}/documents.parquet"))
    keep = set()
    for r in stages[0]:
        if r.text and re.search(r"[^\W\d_]", r.text):
            column = np.frombuffer(r.text.encode(), np.uint8)[:, None]
            both = np.concatenate([langid.states(p, side, column, None) for side in (0, 1)], axis=2)[:, 0]
            e = np.exp(both @ p["v"] + p["c"])
            if (e / e.sum(1, keepdims=True)).mean(0).max() >= pipeline.LEAST_LANGUAGE_SCORE:
                keep.add(r.doc_id)
    assert {r.doc_id for r in stages[1]} == keep and unchanged(stages[0], stages[1]) and 0 < len(keep) < len(stages[0])


def test_near_duplicates(stages):
    sets = [(r.doc_id, set(simhash.shingle_hashes((r.text or "").encode(), 5).tolist()), " ".join((r.text or "").lower().split())) for r in stages[1]]
    group = {i: i for i, _, _ in sets}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a, x in sets:
        for j, b, y in sets:
            if i < j and (x == y or (a and len(a & b) >= 0.8 * len(a | b))):
                low, high = sorted((top(i), top(j)))
                group[high] = low
    assert {r.doc_id for r in stages[2]} == {i for i in group if top(i) == i} and unchanged(stages[1], stages[2]) and len(stages[2]) < len(stages[1])


def test_decontamination(stages):
    w = decontaminate.words(ITEM.encode())
    windows = {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
    keep = set()
    for r in stages[2]:
        own = decontaminate.words((r.text or "").encode())
        if not windows & {tuple(own[k : k + 10]) for k in range(len(own) - 9)}:
            keep.add(r.doc_id)
    assert {r.doc_id for r in stages[3]} == keep and unchanged(stages[2], stages[3]) and len(keep) < len(stages[2])


def test_personal_data(stages):
    after = {r.doc_id: r for r in stages[4]}
    assert set(after) == {r.doc_id for r in stages[3]}
    for r in stages[3]:
        plain = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", r.text or "")
        plain = re.sub(r"\+[0-9][ ().0-9-]+[0-9]", "[PHONE]", plain)
        plain = re.sub(r"\b[0-9]+(\.[0-9]+){3}\b", "[IP]", plain)
        got = after[r.doc_id]
        assert got.text == (r.text if r.text is None else plain) and got.n_chars == len(plain) if r.text is not None else got.text is None
    assert any("[PHONE] from [IP]" in (r.text or "") for r in stages[4])


def test_packing(stages):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    pieces = {}
    for r in stages[5]:
        pieces.setdefault(r.doc_id, []).append(r)
    lengths = []
    assert set(pieces) == {r.doc_id for r in stages[4]}
    for r in stages[4]:
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(pieces[r.doc_id], key=lambda x: x.piece)
        assert sum(x.length for x in own) == len(ids)
        for x in own:
            assert zlib.crc32(ids[x.start : x.start + x.length].tobytes()) == x.ids_crc32
            lengths.append(x.length)
    rooms = []
    for n in sorted(lengths, reverse=True):
        room = min((x for x in rooms if x >= n), default=None)
        if room is None:
            rooms.append(packing.CAPACITY - n)
        else:
            rooms[rooms.index(room)] -= n
    by_sequence = {}
    for r in stages[5]:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(by_sequence) == len(rooms)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_run_gives_what_the_stages_give(spark, tables, stages):
    got = pipeline.run(spark, tables).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in stages[5])


def test_empty_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, tables)
        assert out.count() == 0
