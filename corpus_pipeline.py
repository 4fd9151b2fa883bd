"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All but the last
return the columns of documents, and further columns that docs may have.  In
every stage nulls in any column, texts of any length, repeated rows and tables
without rows have the result that its operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from verdictlake.llm import common, jaccard, mixing, packing, quality, toxicity

#: Three quarters of the tokens, each document once.
MIX = mixing.Mix(share=(3, 4), max_epochs=1)


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null, empty and very short texts go with what the rules reject."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without sentences are clean."""
    return toxicity.keep_clean(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of repeated rows, and of texts without words, one stays."""
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The text at which a leaf's budget ends is cut, and counted again."""
    kept = mixing.keep_mixed(docs, MIX)
    return kept.withColumn("n_chars", F.expr("if(n_chars is null or text is null, n_chars, length(text))").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every row, in sequences; see packing.pack."""
    return packing.pack(docs)


STAGES = [("quality", drop_bad), ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("mix", mix_sources), ("pack", pack)]

#: An isolation forest, a learned classifier, MinHash and a tokenizer are
#: beyond SQL; tests/llm checks each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = common.work_path(spark, f"stage-{name}")
        kept = stage(spark, docs, sf_dir)
        with common.small_batches(spark):  # the rows are whole texts
            kept.write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
