"""The registered queries of the corpus operators, and their SQL where SQL can say them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontamination, exact_dedup, jaccard_join, lm, secrets, substring_dedup, suffix_dedup, toxicity, warc
from millrace.llm.common import scratch_path, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[bytes, str]:
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes(), public_tokenizers.PATTERN


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_id", "n_copies", "n_links", "kept")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *tokenizer())


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "op4-warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.summary(warc.read_archive(spark, path))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.remainder(F.col("doc_id")) != 0)
    return toxicity.toxicity(docs, model)


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"), toxicity.remainder(F.col("doc_id")) != 1)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_key")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_jaccard_join, op2_byte_bpe, op3_exact_dedup, op4_warc, op5_toxicity, op6_lm, op7_decontamination, op8_substring_dedup, op9_secret_scan, op10_suffix_dedup)}
SQL = {"op3_exact_dedup": exact_dedup.ORACLE, "op7_decontamination": decontamination.ORACLE}
