"""Risk figures as attributes of boundary features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandrisk.functions.bands import AT_RISK_BANDS
from bandrisk.operators.rollup import cell_names, named

FEATURE_CELLS = tuple(cell_names(bands=AT_RISK_BANDS))
# Number of map classes for a single scope and for child units.
CLASSES_OF_SCOPE = 1
CLASSES_OF_CHILDREN = 7


def last_name_wins(children: DataFrame, collation: str | None = None) -> DataFrame:
    """One child row per code: of several names the last in name order, no name coming last of all.

    An aggregate rather than a window: it combines on the map side, so a code with very many names
    is not sorted in one task. Names are ordered by bytes, or first by a ``collation``.
    """
    rest = [c for c in children.columns if c != "code"]
    order = F.struct(F.col("na_en").isNull(), named(collation), F.col("na_en"))
    return (
        children.groupBy("code")
        .agg(F.max_by(F.struct(*rest), order).alias("last"))
        .select("code", "last.*")
        .select(*children.columns)
    )


def with_children(features: DataFrame, children: DataFrame) -> DataFrame:
    """Features with the figures of the child unit that has their code.

    A feature without a child unit keeps its properties as they are, and no number of map classes. No broadcast hint: the child
    side is an aggregate whose true size Spark knows by the time it joins.
    """
    latest = last_name_wins(children).select(
        F.col("code").alias("_code"),
        F.lit(True).alias("_matched"),
        F.col("na_en").alias("_na_en"),
        F.lit(0.0).alias("_value"),
        *[F.col(c).alias(f"_{c}") for c in FEATURE_CELLS],
    )
    joined = features.join(latest, features["code"].eqNullSafe(latest["_code"]), "left")

    def taken(name: str):
        new = F.col(f"_{name}")
        return F.when(F.col("_matched"), new).otherwise(F.col(name)) if name in features.columns else new

    names = ("na_en", "value", *FEATURE_CELLS)
    kept = [c for c in features.columns if c not in names]
    return joined.select(
        *kept,
        *[taken(n).alias(n) for n in names],
        F.when(F.col("_matched"), F.lit(CLASSES_OF_CHILDREN)).alias("set_jenk_divider"),
    )


def with_scope_total(features: DataFrame, total: DataFrame, label: str) -> DataFrame:
    """Features that all carry the label and the figures of the scope itself.

    ``total`` is one row by construction (an aggregate without groups) and enters as a scalar
    subquery, so there is no join.
    """
    figures = total.select(F.struct(*FEATURE_CELLS)).scalar()
    names = ("na_en", "value", *FEATURE_CELLS)
    return features.select(
        *[c for c in features.columns if c not in names],
        F.lit(label).alias("na_en"),
        F.lit(0.0).alias("value"),
        figures.alias("_figures"),
        F.lit(CLASSES_OF_SCOPE).alias("set_jenk_divider"),
    ).select(
        *[c for c in features.columns if c not in names],
        "na_en",
        "value",
        *[F.col("_figures")[c].alias(c) for c in FEATURE_CELLS],
        "set_jenk_divider",
    )
