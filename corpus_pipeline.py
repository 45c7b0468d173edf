"""The corpus pipeline: toxicity, near duplicates, benchmark items, personal data, tokens."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ticklane.llm import bpe, contamination, near_join, pii, toxicity
from ticklane.llm.queries import WORD_BPE, table
from ticklane.llm.tables import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that with the smallest doc_id."""
    return near_join.without_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return contamination.without_items(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced."""
    return pii.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document."""
    return bpe.digests(docs, public_tokenizers.path(WORD_BPE))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pii", redact),
    ("bpe", encode),
]

#: A trained classifier and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each stored before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
