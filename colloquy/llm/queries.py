"""Registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import bpe, centroids, contamination, jaccard, licenses, lm, quality, repeats, runs, secrets, sharding, sql, toxicity, warc
from colloquy.llm.common import table

#: Shards of op9.
N_SHARDS = 8


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: path source/lang/doc_id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.col("doc_id").cast("string"))
    files = docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")
    return licenses.scan(files).withColumnRenamed("file_id", "doc_id")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.digest(contamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the places in the archives, which depend on the packing; the global position stays."""
    return warc.capture_history(table(spark, sf_dir, "pages")).drop("archive", "offset", "length")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), ids=False)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.judge(table(spark, sf_dir, "documents")))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.topology(N_SHARDS)
    return sharding.assign(table(spark, sf_dir, "documents"), tree, sharding.with_new_shard(tree, N_SHARDS))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.digest(jaccard.join(table(spark, sf_dir, "documents")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every tenth text, by a hash of its id, are made periodic first, as the contract says."""
    return runs.digest(runs.detect(table(spark, sf_dir, "documents"), runs.planted))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_suffix_array_dedup, op3_benchmark_decontamination, op4_warc, op5_lm_scoring,
                            op6_bpe, op7_quality_rules, op8_secret_scan, op9_sharding, op10_ngram_jaccard_join,
                            op11_periodic_runs, op12_centroid_clustering, op13_toxicity)}

ORACLE_SQL: dict[str, str] = sql.ORACLE_SQL
