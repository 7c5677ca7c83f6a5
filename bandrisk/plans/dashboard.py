"""The dashboard of one scope as a set of sections.

Sections are written by jobs of their own, so what they share is computed once and stored first:
the cube if child units are asked for, else the one row of totals. Both are small.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandrisk.operators.boundary import with_children, with_scope_total
from bandrisk.operators.rollup import cell_names, national_total
from bandrisk.plans.panels import bar_series, donut_series, table_rows
from bandrisk.plans.scope import Scope, children_of, scope_cube, scope_total
from bandrisk.sources.store import materialise

SECTIONS = ("baseline", "children", "totals", "features")


def wanted(section: str, includes: Collection[str] = (), excludes: Collection[str] = ()) -> bool:
    """No ``includes`` means every section."""
    return (not includes or section in includes) and section not in excludes


def dashboard(
    hazard: DataFrame,
    settlement: DataFrame,
    scope: Scope,
    pop_total: DataFrame,
    label: str,
    features: DataFrame | None = None,
    includes: Collection[str] = (),
    excludes: Collection[str] = (),
    cube: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Named DataFrames of a scope; what is not asked for is neither planned nor run.

    ``pop_total`` is the baseline population of the scope, one row with that column. A ``cube``
    from an earlier call spares the pass over the big tables.
    """
    cells = cell_names()
    sections: dict[str, DataFrame] = {}
    with_features = features is not None and wanted("features", includes, excludes)
    # A district's features show the district itself, others their child units, listed or not.
    of_district = scope.level == "district"
    if cube is None and (wanted("children", includes, excludes) or with_features and not of_district):
        cube = materialise(scope_cube(hazard, settlement, scope))
    if wanted("baseline", includes, excludes):
        sections["baseline"] = pop_total
    if wanted("children", includes, excludes):
        sections["children"] = children_of(cube, scope)
    total = None
    if wanted("totals", includes, excludes) or with_features and of_district:
        if cube is None:
            total = materialise(scope_total(hazard, settlement, scope))
        else:
            total = national_total(cube)
        total = total.select(F.lit(label).alias("na_en"), *cells)
    if wanted("totals", includes, excludes):
        sections["totals"] = total
        sections["bar"] = bar_series(total, ())
        no_children = total.withColumn("code", F.lit(None).cast("string")).where(F.lit(False))
        sections["table"] = table_rows(total, sections.get("children", no_children))
        if "baseline" in sections:
            known = total.withColumn("pop_total", pop_total.select(F.col("pop_total").cast("double")).scalar())
            sections["donut"] = donut_series(known, ())
    if with_features and of_district:
        sections["features"] = with_scope_total(features, total, label)
    elif with_features:
        sections["features"] = with_children(features, children_of(cube, scope))
    return sections


def quick_overview(
    hazard: DataFrame, settlement: DataFrame, scope: Scope, pop_total: DataFrame, label: str
) -> dict[str, DataFrame]:
    """Charts and total rows only: neither child rows nor features are computed."""
    return dashboard(hazard, settlement, scope, pop_total, label, includes=("baseline", "totals"))
