"""Corpus pipeline: quality, near duplicates, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.llm import bpe, mixing, near_dedup, quality, suffix_dedup
from tessera.llm.shared import partitions, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.7 or more).

    Null and empty texts get the model's score of no evidence; rows that repeat an id are scored each.
    """
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where("score >= 0.7").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id.

    Rows without id, and null and empty texts, are groups of their own; all rows of a kept id stay.
    """
    kept = near_dedup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("own")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("own")), "left_semi").select(*COLUMNS)


@F.pandas_udf(StringType())
def whole_characters(kept: pd.Series) -> pd.Series:
    """Text of bytes; what is left of a character that was cut is dropped."""
    return kept.map(lambda b: bytes(b).decode("utf-8", "ignore"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that also start earlier.

    A document that loses all its bytes stays with an empty text; null texts become empty; rows that repeat an id keep what is left of their own text.
    """
    key = [F.col("doc_id").alias("own"), F.col("version").alias("own_version")]
    out = suffix_dedup.remove_repeats(docs).select(*key, "kept").dropDuplicates(["own", "own_version"])
    out = stage(spark, out, "kept")
    texts = out.select("own", "own_version", whole_characters("kept").alias("text"))
    rest = docs.select("doc_id", "lang", "source", suffix_dedup.version_of(F.col("text")).alias("version"))
    rest = rest.join(texts, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("version") == F.col("own_version")))
    return rest.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in random order within output shards; a null source is a source of its own."""
    out = mixing.mix(docs.select(*COLUMNS))
    n = partitions(spark)
    out = out.repartition(n, "mix_shard", F.pmod("mix_order", F.lit(n))).sortWithinPartitions("mix_shard", "mix_order")
    return out.select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of what they decode to."""
    return bpe.encode(docs)


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: Models, sketches and hashes that the oracle's engine lacks; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(spark, docs, name)
    return docs
