"""From documents to packed training sequences: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.llm.common import staged, table
from lumaframe.llm.decontaminate import find_contamination
from lumaframe.llm.langid import UNKNOWN, fit, label_language
from lumaframe.llm.packing import pack
from lumaframe.llm.pii import redact
from lumaframe.llm.simhash import drop_near_duplicates

#: A document stays if some learned language has at least this mean probability over its bytes.
LEAST_LANGUAGE_SCORE = 0.35


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or without a language; keep the others as they are."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    labelled = label_language(rows, fit(docs), "language")
    good = (F.col("language.lang") != UNKNOWN) & (F.col("language.score") >= LEAST_LANGUAGE_SCORE)
    return labelled.where(good).select("row.*")


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest doc_id of each group of near-duplicates."""
    return drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    found = find_contamination(rows, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.where(F.size("contamination.spans") == 0).select("row.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets; n_chars follows the text."""
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of at most 2048 tokens."""
    return pack(docs.select("doc_id", "text"))


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: The network, the pairs' confirmation and the tokenizer are beyond SQL; the tests hold the stages against
#: plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
