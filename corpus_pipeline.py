"""From raw documents to packed sequences: quality, near duplicates, benchmark passages, personal data, packing."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm import decontam, jaccard, packing, pii, quality
from slotwise.llm.common import maybe_broadcast, stored, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (and those linked with nothing).

    Rows without an id and repeated rows of one id are not told apart and stay.
    """
    groups = jaccard.jaccard_components(docs)
    gone = stored(groups.where("component_id <> doc_id").select("doc_id", "ver"), "duplicates")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("ver"))
    return keyed.join(maybe_broadcast(gone.distinct(), 32), ["doc_id", "ver"], "left_anti").select("row.*")


def no_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets replaced by their kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(docs, digests=True)


STAGES = [("quality", good_quality), ("near duplicates", one_of_each), ("benchmarks", no_benchmarks), ("personal data", no_personal_data), ("packing", packed)]
#: Classifiers and packing have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
