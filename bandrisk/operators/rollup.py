"""Banded population sums.

A *cell* is the population whose index value lies in one band: one column per index and band,
named ``<index>_<band>``. Every rollup is one conditional-sum aggregation, so the rows are read
once whatever the number of cells, and Spark combines on the map side before it shuffles: what
crosses the network is one row of cells per task and group, however hot a group is.

Sums are kept unrounded ("raw") until the last level, since a total must be the rounded sum and
not the sum of rounded parts. Raw sums are exact: whole numbers by power of two (``functions.exact``),
so raw frames have a row for each group and bin, and results are the same in any order of adding. NaN
and infinite populations make the sums NaN or infinite that they are part of, as they do in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandrisk.functions import exact
from bandrisk.functions.bands import AT_RISK_BANDS, BANDS, Band, band_condition
from bandrisk.functions.indexes import INDEX_KEYS


def cell_name(index_key: str, band: Band) -> str:
    return f"{index_key}_{band.key}"


def cell_names(value_cols: Sequence[str] = INDEX_KEYS, bands: Sequence[Band] = BANDS) -> list[str]:
    """Cell columns in index order, then band order."""
    return [cell_name(v, b) for v in value_cols for b in bands]


def with_parts(df: DataFrame, measure: str = "vuid_population") -> DataFrame:
    """``df`` with the bin and the parts of its measure, which raw sums add up."""
    for columns in exact.split(measure):
        df = df.withColumns({name: F.expr(e) for name, e in columns.items()})
    return df


def cell_conditions(value_cols: Sequence[str] = INDEX_KEYS, bands: Sequence[Band] = BANDS) -> dict[str, str]:
    """Which rows count in each cell, as SQL by name."""
    return {cell_name(v, b): band_condition(v, b) for v in value_cols for b in bands}


def cell_expressions(value_cols: Sequence[str] = INDEX_KEYS, bands: Sequence[Band] = BANDS) -> dict[str, str]:
    """The raw sum of every cell over rows with parts, as SQL by name."""
    return {name: exact.summed(condition) for name, condition in cell_conditions(value_cols, bands).items()}


def raw_cells(
    df: DataFrame,
    by: Sequence[str | Column] = (),
    value_cols: Sequence[str] = INDEX_KEYS,
    measure: str = "vuid_population",
    bands: Sequence[Band] = BANDS,
) -> DataFrame:
    """Raw cells per group and bin; a cell nobody falls into is NULL."""
    sums = cell_expressions(value_cols, bands)
    return with_parts(df, measure).groupBy(*by, exact.BIN).agg(*[F.expr(f"{e} AS `{name}`") for name, e in sums.items()])


def merge_cells(df: DataFrame, by: Sequence[str | Column], cells: Sequence[str]) -> DataFrame:
    """Roll raw cells up to coarser groups."""
    return df.groupBy(*by, exact.BIN).agg(*[F.expr(f"{exact.merged(c)} AS `{c}`") for c in cells])


def finish(raw: DataFrame, by: Sequence[str], sums: Sequence[str], how: str = "{}") -> DataFrame:
    """One row per group from raw sums merged by ``by`` and bin; zero where there is nothing.

    Without ``by`` there is always one row. ``how`` is done to each sum.
    """
    binned = raw.groupBy(*by).agg(F.expr(f"{exact.gathered(list(sums))} AS _bins"))
    found = binned.select(*by, F.expr(f"{exact.joined('_bins', len(sums))} AS _sums"))
    return found.select(*by, *[F.expr(how.format(f"_sums[{n}]")).alias(c) for n, c in enumerate(sums)])


def round_cells(raw: DataFrame, by: Sequence[str], cells: Sequence[str]) -> DataFrame:
    """Finish raw cells: round half away from zero, and zero where there is nothing."""
    return finish(raw, by, cells, "round({})")


def _names(by: Sequence[str | Column], df: DataFrame) -> list[str]:
    return df.select(*by).columns


def banded_sum(
    df: DataFrame,
    by: Sequence[str | Column] = (),
    value_cols: Sequence[str] = INDEX_KEYS,
    measure: str = "vuid_population",
    bands: Sequence[Band] = BANDS,
) -> DataFrame:
    """Finished cells per group. Without ``by`` there is always one row, all zeros if ``df`` is empty."""
    raw = raw_cells(df, by, value_cols, measure, bands)
    return round_cells(raw, _names(by, df) if by else (), cell_names(value_cols, bands))


# The groupings that each product needs, and the one they can all be rolled up from. A key that is
# not asked for is not read, not shuffled and not compared.
LEVEL_KEYS = ("prov_code_1", "dist_code")
PROVINCE_KEYS = ("hazard_prov_code", "prov_na_en")
DISTRICT_KEYS = ("prov_code_1", "hazard_dist_code", "dist_na_en")
CUBE_KEYS = (
    "prov_code_1",
    "dist_code",
    "hazard_prov_code",
    "hazard_dist_code",
    "prov_na_en",
    "dist_na_en",
)


def admin_cube(joined: DataFrame, keys: Sequence[str] = CUBE_KEYS) -> DataFrame:
    """Raw cells by admin keys and bin.

    The one pass over the big tables. Its size follows the number of admin units, not of
    settlements, and every admin total and child table is a further rollup of it.
    """
    return raw_cells(joined, keys)


def national_total(cube: DataFrame) -> DataFrame:
    """The one total row over a whole cube."""
    cells = cell_names()
    return round_cells(merge_cells(cube, (), cells), (), cells)


def level_totals(cube: DataFrame) -> DataFrame:
    """Totals of the country, of every province and of every district, by settlement codes.

    The cube is small, so the grouping sets' row expansion happens after the heavy reduction
    instead of on every settlement. The district level ignores the province. The country is a
    plain aggregate, which gives its row of zeros even for empty tables.
    """
    cells = cell_names()
    country = national_total(cube).select(
        F.lit("country").alias("scope_level"), F.lit(None).cast("string").alias("code"), *cells
    )
    keys = [F.col("prov_code_1"), F.col("dist_code"), F.col(exact.BIN)]
    of_district = F.grouping("dist_code") == 0
    admin = (
        cube.groupingSets([[keys[0], keys[2]], [keys[1], keys[2]]], *keys)
        .agg(
            F.when(of_district, F.lit("district")).otherwise(F.lit("province")).alias("scope_level"),
            F.when(of_district, F.col("dist_code")).otherwise(F.col("prov_code_1")).alias("code"),
            *[F.expr(f"{exact.merged(c)} AS `{c}`") for c in cells],
        )
        .select("scope_level", "code", exact.BIN, *cells)
    )
    return country.unionByName(round_cells(admin, ("scope_level", "code"), cells))


def baseline_totals(settlement: DataFrame, measure: str = "vuid_population") -> DataFrame:
    """Population of the country, every province and every district, with or without a hazard row."""
    keys = ("prov_code_1", "dist_code")
    parts = with_parts(settlement.select(*keys, measure), measure).groupBy(*keys, exact.BIN)
    sums = parts.agg(F.expr(f"{exact.summed()} AS pop_total"))
    total = ["pop_total"]
    country = finish(merge_cells(sums, (), total), (), total).select(
        F.lit("country").alias("scope_level"), F.lit(None).cast("string").alias("code"), "pop_total"
    )
    levels = [
        finish(merge_cells(sums, [F.col(code).alias("code")], total), ("code",), total).select(
            F.lit(level).alias("scope_level"), "code", "pop_total"
        )
        for level, code in (("province", "prov_code_1"), ("district", "dist_code"))
    ]
    return country.unionByName(levels[0]).unionByName(levels[1])


def province_children(cube: DataFrame) -> DataFrame:
    """Cells per province of the country.

    The code is the hazard table's, the name the settlement table's; where they disagree a code
    comes out under several names, on purpose.
    """
    cells = cell_names()
    by = [F.col("hazard_prov_code").alias("code"), F.col("prov_na_en").alias("na_en")]
    return round_cells(merge_cells(cube, by, cells), ("code", "na_en"), cells)


def district_children(cube: DataFrame) -> DataFrame:
    """Cells per district of every province; ``parent_code`` is the settlement's province."""
    cells = cell_names()
    by = [
        F.col("prov_code_1").alias("parent_code"),
        F.col("hazard_dist_code").alias("code"),
        F.col("dist_na_en").alias("na_en"),
    ]
    return round_cells(merge_cells(cube, by, cells), ("parent_code", "code", "na_en"), cells)


def by_name(children: DataFrame, collation: str | None = None) -> DataFrame:
    """Child rows in name order, unnamed ones last; by bytes, or by a ``collation`` such as ``UNICODE``."""
    return children.orderBy(named(collation).asc_nulls_last(), F.col("code").asc_nulls_last(), F.col("na_en").asc_nulls_last())


def named(collation: str | None = None) -> Column:
    """The name to order child rows by. Equal names of a collation are told apart by what follows it in an order."""
    return F.col("na_en") if collation is None else F.collate(F.col("na_en"), collation)


def at_risk(index_key: str, bands: Sequence[Band] = AT_RISK_BANDS) -> Column:
    """Population at risk by one index: its finished cells but the lowest band's."""
    return reduce(lambda a, b: a + b, [F.col(cell_name(index_key, b)) for b in bands])


def long_cells(
    df: DataFrame,
    ids: Sequence[str] = (),
    value_cols: Sequence[str] = INDEX_KEYS,
    bands: Sequence[Band] = BANDS,
    value_name: str = "population",
) -> DataFrame:
    """Cells as rows: ids, index position and key, band position, key and label, value."""
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("index_pos"),
                F.lit(v).alias("index_key"),
                F.lit(j).alias("band_pos"),
                F.lit(b.key).alias("band_key"),
                F.lit(b.label).alias("band_label"),
                F.lit(cell_name(v, b)).alias("cell_key"),
                F.coalesce(F.col(cell_name(v, b)), F.lit(0.0)).alias(value_name),
            )
            for i, v in enumerate(value_cols, start=1)
            for j, b in enumerate(bands, start=1)
        ]
    )
    return df.select(*ids, F.inline(cells))
