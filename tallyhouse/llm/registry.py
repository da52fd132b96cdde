"""The registered corpus queries and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import (
    centroids, cross_polytope, jaccard, line_templates, mixing, packing, periodic_runs, quality_knn, quality_rules, secrets, substrings,
    token_files, warc,
)
from tallyhouse.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_knn.score(docs, quality_knn.fit(docs, read(spark, sf_dir, "labels")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op4_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_copies(read(spark, sf_dir, "embeddings"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents")).select("doc_id", *quality_rules.BASE)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest_rows(read(spark, sf_dir, "documents"))


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_templates.drop_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_chars", F.col("_n_dropped").alias("n_dropped"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(read(spark, sf_dir, "documents"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read(spark, sf_dir, "pages"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustering(read(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest_rows(read(spark, sf_dir, "documents"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read(spark, sf_dir, "documents"))


QUERIES: tuple[Query, ...] = (
    op1_mixing, op2_quality_knn, op3_packing, op4_cross_polytope, op5_quality_rules, op6_suffix_dedup,
    op7_line_templates, op8_jaccard_join,
    op9_secret_scans, op10_warc, op11_centroids, op12_periodic_runs, op13_token_files,
)


def queries() -> dict[str, Query]:
    return {query.__name__: query for query in QUERIES}


def oracle_sql() -> dict[str, str]:
    from tallyhouse.llm.statements import STATEMENTS

    return dict(STATEMENTS)
