"""The susceptibility bands: ordered half-open value ranges with a key and a label."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Band:
    """``lower <= value < upper``; ``upper=None`` leaves the range open."""

    key: str
    label: str
    lower: float
    upper: float | None


# Band keys, labels, bounds and order.
BANDS = (
    Band("very_low", "Very Low", 1.0, 2.0),
    Band("low", "Low", 2.0, 4.0),
    Band("moderate", "Moderate", 4.0, 5.0),
    Band("high", "High", 5.0, 7.0),
    Band("very_high", "Very High", 7.0, None),
)
NO_BAND_LABEL = "None"
NO_BAND_TITLE = "No Risk"
NOT_AT_RISK_LABEL = "Not at Risk"

# The lowest band is summed like the others but does not count as being at risk.
AT_RISK_BANDS = tuple(b for b in BANDS if b.key != "very_low")


def band_condition(value: str, band: Band) -> str:
    """SQL condition that the column ``value`` lies in ``band``; NULL for a NULL value."""
    above = f"`{value}` >= {float(band.lower)!r}D"
    return above if band.upper is None else f"{above} AND `{value}` < {float(band.upper)!r}D"


def band_label(value: str, bands: Sequence[Band] = BANDS, default: str = NO_BAND_LABEL) -> Column:
    """Label of the band that holds the column ``value``; ``default`` below all bands, for NULL and for NaN.

    Sums, unlike labels, count NaN as above every bound, hence in the highest band.
    """
    ladder = F.when(F.isnan(value), F.lit(default))
    for band in bands:
        ladder = ladder.when(F.expr(band_condition(value, band)), F.lit(band.label))
    return ladder.otherwise(F.lit(default))


def band_table(spark: SparkSession, bands: Sequence[Band] = BANDS) -> DataFrame:
    """The bands as a dimension table, ``pos`` giving their order."""
    rows = [(i, b.key, b.label, b.lower, b.upper) for i, b in enumerate(bands, start=1)]
    return spark.createDataFrame(rows, "pos int, band_key string, label string, lo double, hi double")
