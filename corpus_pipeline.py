"""Corpus preparation: five stages over ``documents``, each written as Parquet and read again.

STAGES lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)``.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import decontaminate, jaccard, langid, packing, secrets
from lumenframe.llm.common import free_name, table, written

#: A document whose best language scores below this is rejected, as is one without letters.
LEAST_SCORE = 0.3

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters or with no clear language; the others stay as they are.

    Where no labelled row can teach a model, only documents without letters go.
    """
    model = langid.train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = free_name("lang_pred", docs.columns), free_name("score", docs.columns)
    rows = langid.predict(docs, model, "text", lang, score)
    return rows.where((F.col(lang) != langid.UND) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies (five words, SimHash, Jaccard 0.8): the one with the smallest id.

    Rows that repeat an id with different texts are different documents. Of equal rows one stays.
    A row without an id stays, as it can't be told from others.
    """
    return jaccard.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by its kind; all documents stay."""
    return secrets.redact_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
