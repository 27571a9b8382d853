"""The registered queries of this subpackage, with their production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import embed_neardup, fingerprint, html_extract, langid, lexical, mixing, negatives, ngram_join, pii_crf, quality, token_rollup, toxicity
from .common import read_table
from .packing import pack_documents

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: the words that a mix of 150 % takes of each, sources weighing 3, 1, 2 in turn."""
    return mixing.copies(read_table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings: links of cosine 0.93 or more within a label, found by shared pivots, and their components."""
    return embed_neardup.near_duplicates(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages: the main text of the whole html."""
    return html_extract.extract(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: the language predicted from the whole text."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return langid.identify(docs, langid.train(docs))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and their edited texts: fingerprints of 128 samples and their likenesses."""
    return fingerprint.fingerprints(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: the toxicity of the whole text."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels", "doc_id", "toxic")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: token totals by source, language and tokenizer version after inserts, deletes and revisions."""
    return token_rollup.maintained(read_table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"), TOKENIZER, BYTES)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: the personal data in the whole text."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return pii_crf.find(docs, pii_crf.train(docs))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: the components of those with a Jaccard similarity of 0.8 or more on five-word shingles."""
    return ngram_join.components(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, cut into pieces of at most 2048 ids and packed."""
    return pack_documents(read_table(spark, sf_dir, "documents", "doc_id", "text"), TOKENIZER)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, ranked for each benchmark item: its 50 highest scores."""
    return lexical.search(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings: the hard negatives of every hundredth's five nearest of its label."""
    return negatives.mine(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: the quality of the whole text."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.score(docs, quality.train(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_embedding_neardup": op2_embedding_neardup,
    "op3_html_extraction": op3_html_extraction,
    "op4_language_id": op4_language_id,
    "op5_fingerprints": op5_fingerprints,
    "op6_toxicity": op6_toxicity,
    "op7_token_counts": op7_token_counts,
    "op8_pii": op8_pii,
    "op9_ngram_join": op9_ngram_join,
    "op10_packing": op10_packing,
    "op11_lexical_search": op11_lexical_search,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_quality": op13_quality,
}

ORACLES: dict[str, str] = {
    "op1_mixing": mixing.ORACLE,
    "op11_lexical_search": lexical.ORACLE,
    "op12_hard_negatives": negatives.ORACLE,
}
