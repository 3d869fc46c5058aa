"""The language model learns from every position of every training text."""

from pyspark.sql import functions as F

from lumaframe.llm import lm


def test_every_position_is_learned_from(spark):
    texts = ["", "one", "one two", "one two three four five six seven", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    _, _, total, vocab = lm.gather(docs)
    coded = spark.createDataFrame([(lm.encode(vocab, (t or "").encode())[0].tobytes(),) for t in texts], "codes binary").repartition(3)
    rows = lm.learned_rows(coded, spark.sparkContext.broadcast(vocab))
    # each position uses one row of the table of each place of its context, and one class beside the noise
    place = [rows.where((F.col("row") >= k * (vocab.start + 1)) & (F.col("row") < (k + 1) * (vocab.start + 1))).agg(F.sum("used")).first()[0] for k in range(lm.ORDER)]
    assert place == [total] * lm.ORDER == [15] * lm.ORDER
