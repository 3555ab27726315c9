"""A training corpus from raw documents, stage by stage: quality rules, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the columns of documents. Each
stage's rows are written as Parquet in the folder that all executors share, and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidra.llm import mixing, nearduplicates, packing, pii, quality
from evidra.llm.common import table, written

#: Word runs and similarity, in percent, of near duplicates.
SHINGLE, PERCENT = 5, 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and trees keep."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; rows without an id stay, rows that repeat an
    id don't."""
    kept = nearduplicates.groups(docs, SHINGLE, PERCENT).where("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null")).select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each personal datum replaced by its kind."""
    return pii.redact(docs, pii.fit(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, each with its sequence and offset."""
    return packing.pack(docs)


STAGES = [("quality rules", good_quality), ("near-duplicates", one_of_each), ("personal data", without_personal_data), ("mixing", mixed), ("packing", packed)]

#: SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
