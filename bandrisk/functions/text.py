"""Text cells of the settlement record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area_text(square_metres: Column) -> Column:
    """``1,234.5 km2``; an unknown area reads as zero."""
    km2 = F.coalesce(square_metres.cast("double"), F.lit(0.0)) / F.lit(1e6)
    return F.concat(F.format_number(km2, 1), F.lit(" km2"))


def count_text(value: Column) -> Column:
    """Whole number with thousands separators; an unknown count reads as zero."""
    return F.format_number(F.round(F.coalesce(value.cast("double"), F.lit(0.0))), 0)
