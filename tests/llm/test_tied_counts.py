"""More words share the highest count than may be broadcast."""

import numpy as np

from lumaframe.llm import lm


def test_words_tied_at_the_highest_count_are_known(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    _, least, total, vocab = lm.gather(docs, top=10)
    assert (least, total, set(vocab.index)) == (2, 31, {lm.END})
    row = lm.score_texts(docs, top=10).first()
    base = 31 * np.log10(2 / (31 + 31 + 1))
    assert row.n_known == row.n_tokens == 31 and abs(row.base_score - base) < 1e-6
