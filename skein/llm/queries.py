"""The contracts' queries: each applies its operator with production parameters to whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embdup, fingerprints, mixing, neardup, packing, quality, sharding, suffixdup, tokenfiles, urlfilter
from .shared import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), [1.0] * 8, [1.0] * 9)


def op2_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdup.near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, window=1024)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokenfiles.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return tokenfiles.read(spark, path)


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdup.report(table(spark, sf_dir, "documents"), least=400)


def op6_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op7_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rules_table(spark))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(table(spark, sf_dir, "documents"), k=3, percent=85).drop("text_hash")


QUERIES = {f.__name__: f for f in (op1_rendezvous_sharding, op2_inverted_multi_index, op3_best_fit_packing, op4_token_files, op5_suffix_array, op6_closed_syncmers, op7_quality_trees, op8_source_mixing, op9_url_filter, op10_minhash)}
ORACLES: dict[str, str] = {"op8_source_mixing": mixing.oracle(), "op9_url_filter": urlfilter.ORACLE, "op2_inverted_multi_index": embdup.ORACLE, "op10_minhash": neardup.ORACLE}
