"""The corpus pipeline: documents go through five of the document operators, each on what the one before has kept.

All stages take whole texts, however long, and bear nulls in any column, further columns whatever their names, and empty
tables (of documents, labels or benchmark items), which leave nothing out and give no rows for no documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bpe, decontaminate, ngram_join, pii, toxicity
from graphloom.llm.common import Scratch, read_table
from graphloom.llm.queries import WORD_VOCABULARY


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score stays below the threshold; the model learns from the labels of these documents.

    Null and empty texts are scored as texts without any sign; repeated rows stay or go together; without labels of both
    kinds all stay.
    """
    return toxicity.clean(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, that of least id; of equal ids the least hash of the text, and rows
    without an id last. Rows without words stay, once for each id and text."""
    return ngram_join.keep_one(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts stay, repeated rows go together."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; null and empty texts stay as they are."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text; null texts count as empty."""
    return bpe.encode_digests(docs, public_tokenizers.path(WORD_VOCABULARY), memo=40_000)  # workers also hold what other stages left


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaked),
    ("pii", mask_personal_data),
    ("encode", encode),
]

#: No SQL expresses the trees, the join of near copies by minimal sets and the encoding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
