"""Language ID: segments against a whole read, short texts, whole rows in the sample, and the held-out rule."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaframe.llm import langid
from lumaframe.llm.common import crc_mod

RNG = np.random.default_rng(5)
DE, EN = "der die und nicht sch ei".split(), "the of and thing wh ing".split()


def prose(words, n):
    return " ".join(RNG.choice(words, n).tolist())


@pytest.fixture(scope="module")
def network():
    texts = [prose(DE, 40) for _ in range(20)] + [prose(EN, 40) for _ in range(20)]
    return langid.train([t.encode() for t in texts], np.array([0] * 20 + [1] * 20), 2)


def plain(p, text):
    """Both directions over the whole text, no segments."""
    column = np.frombuffer(text, np.uint8)[:, None]
    both = np.concatenate([langid.states(p, side, column, None) for side in (0, 1)], axis=2)[:, 0]
    e = np.exp(both @ p["v"] + p["c"])
    return (e / e.sum(1, keepdims=True)).mean(0)


def test_segments_give_what_a_whole_read_gives(network):
    texts = [prose(w, n).encode() for n in (1, 3, 30, 90, 400, 2000) for w in (DE, EN)] + [prose(DE + EN, 200).encode(), b"x"]
    got = langid.pooled(network, texts)
    for text, row in zip(texts, got, strict=True):
        assert np.abs(plain(network, text) - row).max() < (1e-5 if len(text) <= langid.SEGMENT else 2e-3)
    exact = langid.pooled(network, texts, segment=1 << 20)
    assert all(np.abs(plain(network, t) - r).max() < 1e-5 for t, r in zip(texts, exact, strict=True))


def test_short_texts_are_learned_from(spark):
    rows = [(i, prose(DE, 3), "de") for i in range(60)] + [(60 + i, prose(EN, 60), "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, p = langid.fit(docs)
    assert langs == ["de", "en"]
    names = [langs[k] for k in langid.pooled(p, [t.encode() for _, t, _ in rows]).argmax(1)]
    assert sum(a == b for a, (_, _, b) in zip(names, rows, strict=True)) >= 118


def test_the_sample_is_bounded_by_different_texts(spark, monkeypatch):
    hot = prose(EN, 5)
    rows = [(hot, "en")] * 500 + [(prose(EN, 6) + str(i), "en") for i in range(60)] + [(prose(DE, 6) + str(i), "de") for i in range(5)] + [("", "de"), (None, "de"), ("x", None)]
    seen = {}

    def train(texts, labels, classes, seed=42):
        seen["rows"] = list(zip(texts, labels.tolist(), strict=True))
        return langid.start(classes)

    monkeypatch.setattr(langid, "train", train)
    langid.fit(spark.createDataFrame(rows, "text string, lang string").repartition(4), rows_per_lang=20)
    assert len(seen["rows"]) == len(set(seen["rows"])) == 25 and set(seen["rows"]) <= {(t.encode(), int(n == "en")) for t, n in rows if t and n}


def test_held_out_rows_teach_nothing(spark, tmp_path, monkeypatch):
    rows = [(i, prose(DE if i % 2 else EN, 30), "de" if i % 2 else "en") for i in range(400)] + [(None, "the of", "en"), (401, "12 !", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    learned = []
    fit = langid.fit
    monkeypatch.setattr(langid, "fit", lambda docs: (learned.extend(r.doc_id for r in docs.collect()), fit(docs))[1])
    got = langid.op3_langid(spark, str(tmp_path)).collect()
    rest = {r.doc_id: r.m for r in spark.createDataFrame(rows, "doc_id long, text string, lang string").select("doc_id", crc_mod(F.col("doc_id"), 4).alias("m")).collect()}
    assert set(learned) == {i for i, m in rest.items() if m is not None and m != 2} and len(got) == len(rows)
    lang = {i: n for i, _, n in rows}
    assert all(r.held_out == (rest[r.doc_id] == 2) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in got if r.held_out) >= 0.95 * sum(r.held_out for r in got)
    assert next(r for r in got if r.doc_id == 401).lang_pred == "und"
