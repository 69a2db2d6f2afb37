"""A corpus pipeline of five training-data operators over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm import mixing, neardup, pieces, suffix, toxicity
from clausework.llm.common import written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; null and empty texts have no hits and stay. The lexicon is learned from the labelled rows of documents that are here."""
    lexicon = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, lexicon).where("score < 0.5").select("_row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: that with the smallest id. A text without words is a class of its own; of rows that repeat an id and text one stays."""
    return neardup.one_each(docs)


def suffix_array_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur twice are cut from the texts; the rows stay."""
    return suffix.deduplicated(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; the rows are in shuffled order. A document may have no copy, or several."""
    return mixing.shuffled(mixing.replicate(docs)).select("_row.*")


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as piece ids, each row cut its own way by its place in the table, with the check that they decode to the text. Null texts have no ids."""
    got = pieces.encoded(docs, by_place=True)
    return got.select("_row.doc_id", "_row.text", "_row.lang", "_row.source", "variant", F.size("ids").cast("long").alias("n_tokens"), "ids", "lossless")


STAGES = [("toxicity", toxicity_stage), ("near-dedup", near_dedup_stage), ("suffix-array", suffix_array_stage), ("mixing", mixing_stage), ("pieces", pieces_stage)]

#: Suffix arrays, MinHash classes and pieces have no form in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
