"""From raw documents to a training mixture: five stages, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackweave.catalog.inputs import Query
from trackweave.llm import decontaminate, mixing, quality_rules, secrets, simhash
from trackweave.llm.common import store, table


def long_rows(spark: SparkSession) -> None:
    """Texts are long rows: 1,000 to an Arrow batch keep the memory of a Python worker small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject, their own or their host's, go: null and short texts too, repeated rows alike."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays.

    SimHash fingerprints within three bits and MinHash keys bring pairs together; each is checked on its sets of shingles.
    Null texts and texts without words are one group; of repeated rows one stays; other columns are carried.
    """
    long_rows(spark)
    return simhash.keep_one(docs, simhash.similar_texts(0.8, 5))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; null and empty texts hold none, repeated rows go alike."""
    long_rows(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret values are masked; every document stays, with all its columns. Null and empty texts stay as they are."""
    long_rows(spark)
    return secrets.masked(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every use of every document in the mixture, with its text, by block: at least one, at most four epochs.

    Null texts are used once; a null source is a source of its own; repeated rows are uses of their own.
    """
    return mixing.mixed_texts(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_masks", secret_masks),
    ("mixture", mixture),
]

# SQL knows neither fingerprints nor guess costs; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs


QUERY = Query(run, ORACLE_SQL)
