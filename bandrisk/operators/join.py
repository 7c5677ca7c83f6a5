"""The join every rollup starts from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from bandrisk.functions.indexes import INDEX_KEYS

SETTLEMENT_COLUMNS = (
    "prov_code_1",
    "prov_na_en",
    "dist_code",
    "dist_na_en",
    "vuid_population",
)


def settlement_hazard(
    hazard: DataFrame,
    settlement: DataFrame,
    columns: Sequence[str] = SETTLEMENT_COLUMNS,
    indexes: Sequence[str] = INDEX_KEYS,
    losses: Observation | None = None,
) -> DataFrame:
    """Inner join of hazard and settlement rows on the settlement id.

    Both tables carry admin codes, and they may disagree: the hazard codes come out as
    ``hazard_prov_code`` and ``hazard_dist_code``, the settlement ones keep their names.

    No join hint: both tables grow with the data. Small ones are broadcast by Spark, large ones
    are sort-merge joined (without a shuffle if both were written bucketed on ``vuid``), and a
    repeated id that makes one partition heavy is split by the adaptive skew join.

    ``losses`` counts what the join leaves out or multiplies, in the pass that uses the result:
    ``matched`` pairs, ``hazard_only`` and ``settlement_only`` rows without a partner, and ``repeated_hazard``
    and ``repeated_settlement``, the pairs that an id makes beyond its first row on that side. Rows
    without an id have no partner. Without one side's filters: the join is a full one then.
    """
    left = hazard.select(
        "vuid",
        F.col("prov_code").alias("hazard_prov_code"),
        F.col("dist_code").alias("hazard_dist_code"),
        *indexes,
    )
    right = settlement.select("vuid", *columns)
    if losses is None:
        return left.join(right, "vuid", "inner")
    # A number within an id costs no shuffle beside the join's own, as both are by the id.
    within = Window.partitionBy("vuid").orderBy(F.lit(1))
    left = left.withColumn("_hazard", F.row_number().over(within))
    right = right.withColumn("_settlement", F.row_number().over(within))
    hazard_row, settlement_row = F.col("_hazard"), F.col("_settlement")
    whole = left.join(right, "vuid", "full")
    matched = hazard_row.isNotNull() & settlement_row.isNotNull()
    counted = whole.observe(
        losses,
        F.count_if(matched).alias("matched"),
        F.count_if(settlement_row.isNull()).alias("hazard_only"),
        F.count_if(hazard_row.isNull()).alias("settlement_only"),
        F.count_if(matched & (hazard_row > 1)).alias("repeated_hazard"),
        F.count_if(matched & (settlement_row > 1)).alias("repeated_settlement"),
    )
    return counted.where(matched).drop("_hazard", "_settlement")
