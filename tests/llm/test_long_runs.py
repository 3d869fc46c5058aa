"""Packing of texts with very long runs: ids equal the library's on the whole text."""

import zlib

import numpy as np
import pytest

from lumaframe.llm import packing

RUNS = [" " * 1_200_000, "\t" * 1_200_000, "\n" * 1_200_000, " " * 1_200_000 + "漢", "x" + " " * 1_200_000 + "é" + "\n" * 30_000, "a" * 300_000, "!" * 300_000]


@pytest.mark.parametrize("k", range(len(RUNS)))
def test_ids_of_long_runs(k):
    words = packing.vocabulary(*packing.default_vocabulary())
    assert np.frombuffer(words.encode(RUNS[k]), "<u4").tolist() == words.full.encode(RUNS[k], add_special_tokens=False).ids


def test_packing_stage_with_long_runs(spark):
    import corpus_pipeline

    full = packing.vocabulary(*packing.default_vocabulary()).full
    docs = spark.createDataFrame([(1, RUNS[0], "x"), (2, RUNS[3], "y"), (3, None, None)], "doc_id long, text string, lang string")
    got = corpus_pipeline.pack_sequences(spark, docs, "").collect()
    for doc_id, text in ((1, RUNS[0]), (2, RUNS[3]), (3, "")):
        ids = np.array([*full.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()
        own = sorted((r for r in got if r.doc_id == doc_id), key=lambda r: r.piece)
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in own]
        assert sum(r.length for r in own) == len(ids) // 4 and all(r.length == packing.CAPACITY for r in own[1:])
