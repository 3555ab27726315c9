"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidra.llm import embeddings, licences, merkle, mixing, nearduplicates, packing, pii, quality, ranking, secrets, substrings, tokenids, urls
from evidra.llm.common import table


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.scan(docs, pii.fit(docs))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearduplicates.groups(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model)


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.groups(table(spark, sf_dir, "embeddings"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"), merkle.tampered())


def op12_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, shards = tokenids.write(table(spark, sf_dir, "documents"))
    return tokenids.read(spark, folder, shards)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, figures = ranking.index(table(spark, sf_dir, "documents"))
    return ranking.search(blocks, figures, table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_licence_scan, op2_pii, op3_minhash_near_dedup, op4_best_fit_packing, op5_source_mixing, op6_url_rules, op7_substring_dedup, op8_quality_rules, op9_embedding_near_dedup, op10_secret_scan, op11_merkle_manifest, op12_token_ids, op13_ranked_search)}
ORACLE_SQL: dict[str, str] = {"op3_minhash_near_dedup": nearduplicates.ORACLE_SQL, "op5_source_mixing": mixing.ORACLE_SQL, "op6_url_rules": urls.ORACLE_SQL, "op7_substring_dedup": substrings.ORACLE_SQL, "op9_embedding_near_dedup": embeddings.ORACLE_SQL, "op11_merkle_manifest": merkle.ORACLE_SQL, "op13_ranked_search": ranking.ORACLE_SQL}
