"""From raw documents to packed training sequences, one operator a stage.

Stages pass documents on as a table: each takes (spark, docs, sf_dir), works on all of docs, and returns the columns of
documents (the last one returns the packing). run() writes what a stage returns to the shared folder and reads it again
for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import mixing, neardup, packing, quality, suffixdup
from skein.llm.shared import materialize

#: Bytes of a repeat that the third stage removes, at least: some 30 to 50 words.
REPEAT = 200


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.5 or more; it learns from labelled documents of docs that aren't held out."""
    trees = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, trees, docs.columns).where("score >= 0.5").select("row.*")


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): the one with the least doc_id."""
    return neardup.drop_near(docs, k=5, percent=80)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of REPEAT bytes or more that occur more than once."""
    return suffixdup.strip(docs, REPEAT)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents repeated, cut or left out to meet their source's target."""
    return mixing.realize(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, window=1024)


STAGES = [(f.__name__, f) for f in (quality_classifier, minhash_near_dedup, suffix_array_dedup, source_mixing, best_fit_packing)]
#: Trees, MinHash and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs.select(*(F.col(c) for c in docs.columns))
