"""The corpus pipeline: five stages, each one operator of candela.llm over all documents that the stage before has kept.

In every stage null and empty texts are empty, very long texts are used whole, further columns of any name stay, rows without
an id count as rows with an id below all others, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candela.llm.common import table, written
from candela.llm.decontamination import decontaminate
from candela.llm.exact_dedup import exact_dedup
from candela.llm.mixing import mix
from candela.llm.ngram_join import ngram_dedup
from candela.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. The model is fitted on this stage's documents and the labels of sf_dir.

    Rows that repeat stay as often as they are there. Without labels nothing goes; an empty text is scored as all others.
    """
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the one with the largest doc_id stays; of rows that repeat, one. Null and empty texts are equal."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links (five-word shingles, Jaccard similarity of 0.8 or more), the smallest doc_id stays.

    A document without an id stays only where none of its component has one. Documents without words all stay.
    """
    return ngram_dedup(docs, k=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of the five-word shingles of a benchmark item go. Items without words remove nothing."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which for documents without words of a source that has some is decided by their place in the order of size. A null source is one of its own."""
    return mix(docs)


STAGES = [("toxicity", toxicity), ("exact", exact), ("near", near), ("benchmark", benchmark), ("mixing", mixing)]

#: SQL cannot train the first stage's classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
