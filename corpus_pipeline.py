"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, works on all of it, and returns the columns of ``documents`` (the last one the
packed pieces). ``run`` writes every stage's result as a table and goes on from there, so a lost executor costs one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoledger.llm import order_minhash, packing, spaced_seeds, substring_dedup, toxicity
from geoledger.llm.queries import vocabulary_path
from geoledger.session import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go. The models learn from the labels of training documents only."""
    trained = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, trained)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal or similar texts stays: the one with the smallest id."""
    return order_minhash.keep_one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that also stand in a document with a smaller id are cut out of the text."""
    cleaned = substring_dedup.remove_repeats(docs)
    if "n_chars" in cleaned.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(cleaned.schema["n_chars"].dataType))
    return cleaned


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    return spaced_seeds.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of sequences of at most 4096 tokens."""
    return packing.pack(docs, vocabulary_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: Trained models, sketches and a genetic algorithm have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
