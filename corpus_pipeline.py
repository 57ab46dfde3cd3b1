"""A training-data pipeline over the documents table: STAGES are applied in order, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vqloom.llm import linededup, mixing, sentencepiece_codec, simhash, toxicity
from vqloom.llm.common import remove, shared_path, table
from vqloom.llm.queries import piece_model


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model trained on the labelled ones predicts clean."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat an earlier one up to one word."""
    return linededup.without_duplicate_lines(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document."""
    return sentencepiece_codec.encoded(docs, piece_model())


STAGES = [("toxicity", reject_toxic), ("line_dedup", dedup_lines), ("simhash", dedup_near), ("mixing", mix_sources), ("sentencepiece", encode)]

#: Trained models and sub-word merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is removed once the next one is written; the last one goes when the driver ends."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(out)
        docs = spark.read.parquet(out)
        if last:
            remove(spark, last)
        last = out
    return docs
