"""A corpus pipeline: toxicity filter, exact dedup, near-duplicate dedup, decontamination, tokenisation.

STAGES lists (name, function); each function takes (spark, docs, sf_dir).  All but the last filter rows and return
the columns of documents, whatever they are called; the last encodes every kept text and checks that decoding gives
it back.

Defined cases, in every stage: null text is the empty text; rows that repeat an id, or have none, are documents of
their own; an empty table stays empty, and without labels or benchmark items nothing is dropped for them.  Ties go to
the smallest id, rows without one last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontamination, exact_dedup, jaccard_join, toxicity
from millrace.llm.common import release, ship, written
from millrace.llm.queries import table, tokenizer


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 and more go; an empty text has the score of no hit and stays, as all do without labels."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.remainder(F.col("doc_id")) != 0)
    return toxicity.keep_clean(docs, model)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the longest stays, then the smallest id; empty ones are equal."""
    ship(spark)
    return exact_dedup.drop_copies(docs)


def jaccard_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the one with the smallest id stays; a text without words is linked with none."""
    ship(spark)
    return jaccard_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; items of fewer than five words, or of none, are held by none."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every kept document, and whether the tokens decode to the text; an empty one has none."""
    ship(spark)
    return bpe.digests(docs, *tokenizer())


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("jaccard_join", jaccard_join_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", bpe_stage),
]

#: A learned score and near-duplicate groups are not to be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
