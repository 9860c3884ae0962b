"""A corpus pipeline of five stages over ``documents``; each stage's result is written as Parquet and read again.

Quality rules drop what they reject; one document of each near-duplicate group (five-word Jaccard similarity of 0.8 or
more) is kept; secrets are replaced in the texts; sources are mixed to target weights within nine tenths of the tokens;
what is left is encoded. Tables that a stage made on its way are deleted when it ends, or when the next stage begins on its written result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import piece_codec, quality_rules, secret_scan, simhash_dedup, source_mix
from tidemill.llm._common import bounded, documents, release, scratch

MIX = source_mix.Mixture(weights=source_mix.MIX.weights, share=0.9, max_epochs=1, seed=source_mix.MIX.seed)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    bounded(spark)
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group."""
    bounded(spark)
    release(docs)
    return simhash_dedup.keep_similar(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    bounded(spark)
    release(docs)
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their leaf's budget."""
    bounded(spark)
    release(docs)
    return source_mix.mixed(docs, MIX, source_mix.domain_of())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    bounded(spark)
    release(docs)
    coded = piece_codec.encode(docs.select("doc_id", "lang", "source", "text"), piece_codec.vocabulary(), drop=("text",), check=True, limit=1 << 20, kept_words=30_000)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secrets),
    ("source_mix", mix),
    ("piece_encoding", encode),
]

#: Stages 1, 3 and 5 are beyond SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = scratch(spark, lambda: stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
