"""A corpus from raw documents to mixed, encoded training text."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import jaccard, langid, lattice, mixing, quality
from tidewatch.session import small_batches, staged


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_small_batches(stage: Stage) -> Stage:
    """Whole texts pass to Python a few MB at a time."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@_in_small_batches
def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; others (no letters, a score under 0.5) go. Learns from their own `lang`."""
    return langid.with_known_language(docs)


@_in_small_batches
def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, learned from the labels of what is left, scores 0.7 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return quality.good_documents(docs, labels)


@_in_small_batches
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, Jaccard similarity of 0.8 or more."""
    return jaccard.distinct_documents(docs, n=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, none to three times."""
    return mixing.repeat_documents(docs)


@_in_small_batches
def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, same): piece ids of every copy's whole text, and whether they decode to it."""
    return lattice.round_trip(docs, "source")


STAGES = [
    ("language ID", keep_known_languages),
    ("quality classifier", keep_good_documents),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_texts),
]

ORACLE_SQL = None  # fitted models and drawn copies can't be told in SQL; tests/llm compares each stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
