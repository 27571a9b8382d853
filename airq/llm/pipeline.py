"""A corpus pipeline of five stages, each a Spark job over all that its predecessor kept.

Every stage but the last keeps the columns of its input, whatever their names, and changes only what its docstring says. Nulls
in any column, empty and very long texts, repeated rows and ids, and an empty table are fine; what becomes of them is
said with the stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import langid, mixing, ngram_join, packing, pii_crf
from .common import discard, materialise, own_tables, small_batches

#: Documents whose language is less sure than this are rejected; texts without letters always are.
LEAST_LANGUAGE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language, their ``lang`` set to it. Null texts and texts without letters go."""
    small_batches(spark)
    return langid.keep_identified(docs, LEAST_LANGUAGE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id; unlike texts of one id, and rows without words, all stay."""
    small_batches(spark)
    return ngram_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in ``text`` replaced by its kind. Null texts stay null."""
    small_batches(spark)
    return pii_crf.redact(docs, pii_crf.train(docs.select("text")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it. A null source is a source of its own."""
    return mixing.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences. A null text is a document of the end token alone."""
    small_batches(spark)
    return packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id), ("ngram_join", near_duplicates), ("pii", personal_data), ("mixing", source_mix), ("packing", sequences),
]

#: No stage but the mix can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; once a stage is written, all that was written before it is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with own_tables() as written:
        for name, stage in STAGES[:-1]:
            docs = materialise(stage(spark, docs, sf_dir), name)
            discard(spark, written, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
