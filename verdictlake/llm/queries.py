"""The queries op1 to op10 over the driver's tables, with production
parameters; each takes (spark, sf_dir) and returns its operator's full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common, jaccard, lm, mixing, packing, quality, sharding, token_files, topk, toxicity, warc


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(common.table(spark, sf_dir, "documents"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(common.table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(common.table(spark, sf_dir, "pages"), common.work_path(spark, "warc"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = sharding.shard(common.table(spark, sf_dir, "documents"), common.work_path(spark, "shards"))
    return sharding.digest(store.read())


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.work_path(spark, "tokens")
    index = token_files.write_tokens(common.table(spark, sf_dir, "documents"), folder)
    return token_files.read_tokens(spark, folder, index)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(common.table(spark, sf_dir, "embeddings"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(common.table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_jaccard": op2_jaccard,
    "op3_warc": op3_warc,
    "op4_pack": op4_pack,
    "op5_shards": op5_shards,
    "op6_tokens": op6_tokens,
    "op7_topk": op7_topk,
    "op8_lm": op8_lm,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
}
ORACLE_SQL: dict[str, str] = {"op1_mix": mixing.oracle(), "op5_shards": sharding.ORACLE, "op7_topk": topk.ORACLE}
