"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Rows with null or empty texts pass the first stage if the classifier takes
them for good, and fall to the rules. Repeated rows are one document to the
near-duplicate stage. An empty table passes every stage and packs nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from touchline.llm import crf, near_dup, packing, quality_rules, secret_scan
from touchline.llm.common import modest_batches, shared_folder, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier takes for bad."""
    modest_batches(spark)
    model = crf.trained_for(spark, docs, sf_dir)
    return crf.score(docs, model, keep=tuple(docs.columns)).where("score >= 0.5").select("kept.*")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rule or the cascade rejects."""
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near duplicates, by five-word shingles."""
    return near_dup.drop_near_duplicates(docs, words=5).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts."""
    modest_batches(spark)
    return secret_scan.redact(docs, secret_scan.learn_formats(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents."""
    return packing.packed(docs)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", rules), ("near_duplicates", near_duplicates), ("secret_scan", secrets), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are stored in the shared folder before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
