"""Documents to a training mix: toxic ones, exact copies, near copies and
benchmark passages go, then the sources are mixed to their target weights.

Each stage is a function of (spark, docs, sf_dir); what it returns is written
as Parquet and read again as the docs of the next one, so a lost executor
costs no more than the stage it was in. All stages but the last return the
columns of documents.

Defined results: a row with a null or empty text is clean, one of all such
rows stays as the copy of the empty text, and the mix leaves it out, as it has
no words; a null id sorts after all others; a null source is a source; without
labels the seeds of the lexicon judge; without benchmark items no document is
contaminated; without documents no rows come out. Other columns of documents
pass through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomstrand.llm import decontaminate, exact_dedup, mixing, near_dedup, toxicity
from loomstrand.scratch import Scratch

#: SQL has no automata, learned scores or weighted minhashes; tests hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below its threshold."""
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(spark, docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest doc_id."""
    return exact_dedup.deduplicated(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id."""
    return near_dedup.deduplicated(spark, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.decontaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, one row for each pass, with pass and pass_words."""
    return mixing.mixed(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
