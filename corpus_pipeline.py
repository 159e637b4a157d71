"""From documents to a training mix, one operator per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm.contamination import drop_contaminated
from buildlens.llm.lines import drop_repeated_lines
from buildlens.llm.mixing import mix_sources
from buildlens.llm.queries import TOXIC_FROM, toxicity_model
from buildlens.llm.simhash import keep_one
from buildlens.llm.toxicity import drop_toxic
from buildlens.session import remove, scratch_path, scratch_scope
from buildlens.sources.tables import read_table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain calls toxic go; it learns from the labelled ones among them."""
    model = toxicity_model(docs, read_table(spark, sf_dir, "labels"))
    return drop_toxic(docs, model, TOXIC_FROM)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of five or more documents stay in the last one; n_chars follows the text."""
    shorter = drop_repeated_lines(docs).select(*docs.columns)
    return shorter.withColumn("n_chars", F.char_length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the number of times the mix takes them, for those taken at all."""
    mixed = mix_sources(docs)
    return mixed.filter("copies > 0").select("doc_id", "source", "size", "copies", "taken")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage returns is written and read again by the next one.

    A stage's own scratch goes when its rows are written, these go when the next stage's are. What the last
    stage reads stays, as its result is not written here.
    """
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)


# Models and fingerprints can't be told in SQL; the tests hold the rows against plain Python.
ORACLE_SQL = None
