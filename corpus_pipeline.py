"""From raw documents to a training mixture: five stages, each written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import dartminhash, decontam, linededup, mixing, quality
from palimpsest.llm.common import Scratch, id_text_crc, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It learns from the labels that its query learns from."""
    learned = table(spark, sf_dir, "labels").where(id_text_crc(F.col("doc_id"), 5) != 0)
    model = quality.fit(spark, docs, learned)
    return docs.where(quality.score_column(spark, F.col("text"), model) >= quality.THRESHOLD)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that too many of them repeat."""
    done = linededup.dedup_lines(spark, docs)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least doc_id, once; texts without an id of their own stay too."""
    return dartminhash.one_of_each(spark, docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontam.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected token shares by source, language and topic are the targets, with its probabilities.

    No document is taken twice: a value with too little for its target is taken whole, see ``mixing.targets``.
    """
    return mixing.sample(spark, docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
]

#: The classifier's and the signatures' stages cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        with Scratch.collected() as made:
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        for used in made:  # the stage's own tables; its result is written
            used.drop()
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
