"""Reading the hazard and settlement tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandrisk.functions.indexes import INDEX_KEYS

HAZARD_COLUMNS = {
    "vuid": None,
    "prov_code": "string",
    "dist_code": "string",
    **{key: "double" for key in INDEX_KEYS},
}
SETTLEMENT_COLUMNS = {
    "vuid": None,
    "name_en": "string",
    "prov_code_1": "string",
    "prov_na_en": "string",
    "dist_code": "string",
    "dist_na_en": "string",
    "vuid_population": "double",
    "area_population": "double",
    "vuid_buildings": "bigint",
    "area_sqm": "double",
    "lon": "double",
    "lat": "double",
}


def conform(df: DataFrame, columns: Mapping[str, str | None], rename: Mapping[str, str] | None = None) -> DataFrame:
    """Select the known columns under their known names and types.

    ``rename`` maps a known name to the column that holds it. A type of None keeps the column's
    own type. Casts to the type a column already has vanish from the plan, so filters still reach
    the scan.
    """
    rename = rename or {}
    return df.select(
        *[
            F.col(rename.get(name, name)).alias(name)
            if type_name is None
            else F.col(rename.get(name, name)).cast(type_name).alias(name)
            for name, type_name in columns.items()
        ]
    )


def read(spark: SparkSession, source: str, format: str | None = None, **options: str) -> DataFrame:
    """A catalog table by name, or files of ``format`` by path."""
    if format is None:
        return spark.table(source)
    return spark.read.format(format).options(**options).load(source)


def read_hazard(
    spark: SparkSession, source: str, format: str | None = None, rename: Mapping[str, str] | None = None, **options: str
) -> DataFrame:
    return conform(read(spark, source, format, **options), HAZARD_COLUMNS, rename)


def read_settlement(
    spark: SparkSession, source: str, format: str | None = None, rename: Mapping[str, str] | None = None, **options: str
) -> DataFrame:
    return conform(read(spark, source, format, **options), SETTLEMENT_COLUMNS, rename)
