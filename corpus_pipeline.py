"""From raw documents to packed training sequences, in stages.

Every stage takes ``(spark, docs, sf_dir)`` and returns a frame that is written and read again as the
next one's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bandrisk.llm import decontaminate, langid, packing, simhash, substring
from bandrisk.llm.queries import packed_digest
from bandrisk.sources.store import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: those whose text is NULL or has no letters."""
    return langid.drop_undetermined(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.drop_near_duplicates(docs, Scratch(spark))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur more than once are cut from the texts."""
    return substring.drop_repeated(docs)


def drop_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_contaminated(docs, items, Scratch(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packed_digest(packing.pack_documents(docs))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_benchmark_items),
    ("packing", pack),
]

# Trained models, fingerprints and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of ``documents``; each stage is stored before the next one starts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    *stages, (_, last) = STAGES
    for _, stage in stages:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)
