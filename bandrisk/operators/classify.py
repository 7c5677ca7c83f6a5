"""Susceptibility class per settlement and index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandrisk.functions.bands import BANDS, NO_BAND_LABEL, band_label
from bandrisk.functions.indexes import INDEX_KEYS, INDEXES
from bandrisk.functions.text import area_text, count_text
from bandrisk.operators.join import settlement_hazard

PROFILE_COLUMNS = (
    "name_en",
    "dist_na_en",
    "prov_na_en",
    "area_sqm",
    "area_population",
    "vuid_population",
    "vuid_buildings",
)
_COUNTS = ("area_sqm", "area_population", "vuid_population", "vuid_buildings")


def class_name(index_key: str) -> str:
    return f"{index_key}_class"


def with_classes(df: DataFrame, indexes: Sequence[str] = INDEX_KEYS) -> DataFrame:
    """Add a ``<index>_class`` label per index."""
    return df.withColumns({class_name(i): band_label(i) for i in indexes})


def susceptibility_class(hazard: DataFrame) -> DataFrame:
    """Labels of every hazard row."""
    return with_classes(hazard.select("vuid", *INDEX_KEYS)).select("vuid", *[class_name(i) for i in INDEX_KEYS])


def susceptibility_matrix(classes: DataFrame) -> DataFrame:
    """A row per settlement and index with an ``X`` under the one label that holds."""
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("index_pos"),
                F.lit(i.key).alias("index_key"),
                F.lit(i.record_title).alias("title"),
                F.col(class_name(i.key)).alias("class"),
            )
            for n, i in enumerate(INDEXES, start=1)
        ]
    )

    def mark(label: str):
        return F.when(F.col("class") == label, F.lit("X")).otherwise(F.lit(""))

    return classes.select("vuid", F.inline(rows)).select(
        "vuid",
        "index_pos",
        "index_key",
        "title",
        mark(NO_BAND_LABEL).alias("no_risk"),
        *[mark(b.label).alias(b.key) for b in BANDS],
    )


def settlement_profile(hazard: DataFrame, settlement: DataFrame) -> DataFrame:
    """The record of every settlement that has a hazard row: attributes, their text and the labels.

    The position stays behind. Unknown numbers read as zero.
    """
    joined = with_classes(settlement_hazard(hazard, settlement, PROFILE_COLUMNS))
    return joined.select(
        "vuid",
        "name_en",
        "dist_na_en",
        "prov_na_en",
        *[F.coalesce(F.col(c), F.lit(0).cast(joined.schema[c].dataType)).alias(c) for c in _COUNTS],
        area_text(F.col("area_sqm")).alias("area_text"),
        count_text(F.col("area_population")).alias("area_population_text"),
        count_text(F.col("vuid_population")).alias("vuid_population_text"),
        count_text(F.col("vuid_buildings")).alias("vuid_buildings_text"),
        *[class_name(i) for i in INDEX_KEYS],
    )


def settlement_documents(profile: DataFrame) -> DataFrame:
    """``vuid, doc``: the record of every settlement as one JSON document, base information and marked matrix.

    A row of the matrix per index, an ``X`` under the one label that holds: five rows, whatever the data.
    """

    def row(index):
        marks = [
            F.when(F.col(class_name(index.key)) == label, F.lit("X")).otherwise(F.lit("")).alias(key)
            for key, label in (("no_risk", NO_BAND_LABEL), *((b.key, b.label) for b in BANDS))
        ]
        return F.struct(F.lit(index.key).alias("key"), F.lit(index.record_title).alias("title"), *marks)

    base = ("name_en", "dist_na_en", "prov_na_en", "area_text", "area_population_text")
    record = F.struct(*base, "vuid_population_text", "vuid_buildings_text", F.array(*map(row, INDEXES)).alias("matrix"))
    return profile.select("vuid", F.to_json(record, {"ignoreNullFields": "false"}).alias("doc"))


def write_settlement_documents(documents: DataFrame, path: str) -> None:
    """Write settlement documents as JSON lines."""
    documents.write.mode("overwrite").json(path)


def settlement_record(profile: DataFrame, vuid) -> DataFrame:
    """The record of one settlement; no row if there is none."""
    return profile.where(F.col("vuid") == F.lit(vuid))
