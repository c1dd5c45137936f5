"""The corpus pipeline: language ID, quality rules, near-duplicates, mixing to target weights, packing.

Nulls may stand in any column: a null text has no letter and goes in the first stage; a null lang is a stratum of its own, a null source a source of its own, and a null
doc_id an id like any other, without a label. Repeated rows are duplicates. An empty table passes all stages and gives an empty result. Columns beyond those of documents
go in the first stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickwork.llm import langid, mixing, near_dedup, packing, quality
from wickwork.llm.common import delete, scratch_path
from wickwork.llm.queries import TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject go."""
    model = langid.train(docs.select("doc_id", "text", "lang").where(~langid.held_out()))
    return langid.identify(docs, model).where(~F.col("rejected")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; cutoffs are fitted on the labelled documents that are still there."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.kept_documents(docs.select(*COLUMNS), labels)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return near_dedup.one_of_each(docs).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    sized = docs.withColumn("_words", mixing.word_count("text"))
    return mixing.mixed_documents(sized, "_words").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and place of each document of the mix."""
    return packing.pack_tokens(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language", language_stage), ("quality", quality_stage), ("near_dedup", dedup_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Language models, alignments and binomial bounds are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each reads what the one before has written, which is then deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
