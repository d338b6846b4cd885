"""From raw documents to token ids: five stages, each over all that its predecessor kept.

1. quality: documents go whose tail probability of the top grade is too low.
2. near_dedup: one document of each group of near copies stays.
3. substring_dedup: repeated runs of sentences leave all texts but the first.
4. decontamination: documents that share a passage with the benchmark go.
5. tokens: SentencePiece ids of what is left.

Null and empty texts pass through stages 2 to 5 as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import decontaminate, ordermin, pieces, quality, runtime, spans


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.select(docs, quality.train(docs, quality.grades_of(labels)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ordermin.keep_one(docs)


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = spans.deduplicate(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans.count_names(docs)[1]) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, pieces.load())


STAGES = [
    ("quality", filter_quality),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_spans),
    ("decontamination", drop_benchmark_leaks),
    ("tokens", encode_tokens),
]
#: A trained model, alignments and a vocabulary are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not i else runtime.table(docs), sf_dir)
    return docs
