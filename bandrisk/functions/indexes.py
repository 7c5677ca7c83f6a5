"""The five susceptibility indexes carried by the hazard table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class RiskIndex:
    """One index column with the titles of its chart, table and settlement record."""

    key: str
    title: str
    table_title: str
    record_title: str


# Index keys, titles and order.
INDEXES = (
    RiskIndex(
        "lsi_immap",
        "Landslide Indexes (iMMAP 2017)",
        "Population by Landslide Indexes (iMMAP 2017)",
        "Landslide Indexes (iMMAP 2017)",
    ),
    RiskIndex(
        "lsi_ku",
        "Multi-criteria Susceptibility Index",
        "Population by Multi-criteria Landslide Susceptibility Index",
        "Multi-criteria Landslide Susceptibility Index*",
    ),
    RiskIndex(
        "ls_s1_wb",
        "Landslide Susceptibility (S1)",
        "Population by Landslide susceptibility - bedrock landslides in slow evolution (S1)",
        "Landslide susceptibility - bedrock landslides in slow evolution (S1)**",
    ),
    RiskIndex(
        "ls_s2_wb",
        "Landslide Susceptibility (S2)",
        "Population by Landslide susceptibility - bedrock landslides in rapid evolution (S2)",
        "Landslide susceptibility - bedrock landslides in rapid evolution (S2)**",
    ),
    RiskIndex(
        "ls_s3_wb",
        "Landslide Susceptibility (S3)",
        "Population by Landslide susceptibility - cover material in rapid evolution (S3)",
        "Landslide susceptibility - cover material in rapid evolution (S3)**",
    ),
)
INDEX_KEYS = tuple(i.key for i in INDEXES)


def index_table(spark: SparkSession) -> DataFrame:
    """The indexes as a dimension table, ``pos`` giving their order."""
    rows = [(n, i.key, i.title, i.table_title, i.record_title) for n, i in enumerate(INDEXES, start=1)]
    return spark.createDataFrame(
        rows, "pos int, index_key string, title string, table_title string, record_title string"
    )
