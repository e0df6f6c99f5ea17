"""From raw documents to token counts: five stages, each written and read again.

Every stage takes all the documents its predecessor kept and returns the columns
of ``documents``; the last returns a row of token figures for each document.
Nulls: a null or letterless text is rejected by the first stage, so later
stages see texts only; a null id is carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm import decontamination, language_id, ngram_join, pii, sentencepiece_codec
from mercato.llm.common import read_table
from mercato.llm.queries import LANGUAGE_FOLDS, LANGUAGE_HELD_OUT, SURROGATE_KEY
from mercato.operators.durable import OwnedTables


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the labelled ones; those without language go."""
    out = language_id.held_out("doc_id", LANGUAGE_FOLDS, LANGUAGE_HELD_OUT)
    return language_id.keep_identified(docs, language_id.fit(docs.where(~out)))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id."""
    return ngram_join.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not mostly made of benchmark passages."""
    return decontamination.remove_contamination(docs, read_table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and their new length."""
    clean = pii.with_surrogates(docs, SURROGATE_KEY, records=None)
    if "n_chars" in clean.columns:
        kind = clean.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.char_length("text").cast(kind))
    return clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token figures of every document that is left."""
    return sentencepiece_codec.encode_documents(docs, str(public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", join_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("sentencepiece", encode),
]

#: SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has read is removed once it isn't needed."""
    tables = OwnedTables(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    earlier = None
    for name, stage in STAGES:
        docs = tables.write(stage(spark, docs, sf_dir), name)
        if earlier:
            tables.drop(earlier)
        earlier = name
    return docs
