"""Filter, deduplicate, decontaminate and mix the documents table, stage by stage.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), works on every row
its predecessor kept and returns the columns of documents, but for the last, which returns the mix.
``run`` writes each stage to the shared folder and reads it back, as a scheduler would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.lineage import pin
from shelfwise.llm.decontaminate import without_contaminated
from shelfwise.llm.lines import drop_repeated_lines
from shelfwise.llm.minhash import near_duplicates
from shelfwise.llm.mixing import mix_sources
from shelfwise.llm.registry import label_weights
from shelfwise.llm.tables import small_batches, table
from shelfwise.llm.toxicity import without_toxic

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the last category of the chain flags go, with or without doc_id."""
    small_batches(spark)
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first; documents stay."""
    small_batches(spark)
    short = drop_repeated_lines(docs)
    return short.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: words-of-five shingles, 0.8 or more."""
    small_batches(spark)
    found = near_duplicates(docs, width=5)
    gone = found.where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a passage of the benchmark go, with or without doc_id."""
    small_batches(spark)
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mix_sources(docs, label_weights(spark, sf_dir)).select(
        "doc_id", "source", "size", "source_size", "target", "taken"
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("source_mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
