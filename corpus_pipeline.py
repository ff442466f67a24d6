"""A training corpus from documents: quality, near-duplicates, decontamination, personal data, token ids.

All stages take nulls in any column, empty and very long texts, repeated rows and empty tables (which give empty ones);
columns that they don't name are handed on. What each makes of such rows is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontaminate, pieces, pii, quality, simhash
from quire.llm.common import materialise, table
from quire.llm.queries import tokenizer_path


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the scorer keeps; null, empty and blank texts go, repeated rows are judged alike."""
    return quality.score(docs).where("keep").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, that of the smallest id; of rows that repeat an id one stays, rows without an id stay."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8, radius=4)


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without what they share with benchmark; those that lose over half of their words go, null texts stay null."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"), window=10, max_coverage=0.5)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with spans of personal data replaced by their kinds; null texts stay null."""
    return pii.mask(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and ids (packed, little-endian), without the text; null and empty texts have no ids."""
    return pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"), rate=0.1, seed=42).select("doc_id", "lang", "source", "ids")


STAGES = [
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", cut_benchmarks),
    ("personal_data", mask_personal_data),
    ("encode", encode_pieces),
]

#: Trained scorers, fingerprints and merges are not expressible in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
