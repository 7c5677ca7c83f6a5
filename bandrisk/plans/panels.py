"""Chart series, tables and documents of a scope, or of all scopes at once.

Input totals carry cells and any number of ``ids`` columns naming the scope; there are as many
rows as scopes, so everything here works on small data and adds no pass over the big tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandrisk.functions.bands import AT_RISK_BANDS, NOT_AT_RISK_LABEL
from bandrisk.functions.indexes import INDEXES
from bandrisk.operators.rollup import at_risk, cell_name, cell_names, long_cells
from bandrisk.sources.store import replace_partitions

SCOPE_IDS = ("scope_level", "code")


def with_baseline(totals: DataFrame, baseline: DataFrame) -> DataFrame:
    """Totals with the baseline population of their scope; the country's code is NULL in both."""
    base = baseline.select(
        F.col("scope_level").alias("_level"), F.col("code").alias("_code"), F.col("pop_total").cast("double")
    )
    same = (totals["scope_level"] == base["_level"]) & totals["code"].eqNullSafe(base["_code"])
    return totals.join(base, same, "left").drop("_level", "_code")


def risk_summary(totals: DataFrame, ids: Sequence[str] = SCOPE_IDS) -> DataFrame:
    """``ids``, index, title, population at risk, baseline and the rest, which may be negative."""
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("index_pos"),
                F.lit(i.key).alias("index_key"),
                F.lit(i.title).alias("title"),
                at_risk(i.key).alias("total_atrisk"),
            )
            for n, i in enumerate(INDEXES, start=1)
        ]
    )
    return totals.select(*ids, "pop_total", F.inline(rows)).select(
        *ids,
        "index_pos",
        "index_key",
        "title",
        "total_atrisk",
        F.col("pop_total").alias("total"),
        (F.col("pop_total") - F.col("total_atrisk")).alias("not_at_risk"),
    )


def _titles(kind: str):
    title = {i.key: getattr(i, kind) for i in INDEXES}
    return F.create_map(*[F.lit(part) for pair in title.items() for part in pair])[F.col("index_key")]


def bar_series(totals: DataFrame, ids: Sequence[str] = SCOPE_IDS) -> DataFrame:
    """The at-risk bands per index, low to high."""
    return long_cells(totals, ids, bands=AT_RISK_BANDS).select(
        *ids,
        "index_pos",
        "index_key",
        _titles("title").alias("title"),
        F.col("band_pos").alias("pos"),
        F.col("band_label").alias("label"),
        "population",
    )


def donut_series(totals: DataFrame, ids: Sequence[str] = SCOPE_IDS) -> DataFrame:
    """The at-risk bands per index, and the population not at risk as the last slice."""
    rest = risk_summary(totals, ids).select(
        *ids,
        "index_pos",
        "index_key",
        "title",
        F.lit(len(AT_RISK_BANDS) + 1).alias("pos"),
        F.lit(NOT_AT_RISK_LABEL).alias("label"),
        F.col("not_at_risk").alias("population"),
    )
    return bar_series(totals, ids).unionByName(rest)


def table_rows(total: DataFrame, children: DataFrame, ids: Sequence[str] = ()) -> DataFrame:
    """The total row and the child rows of every index table.

    ``total`` carries ``ids, na_en`` and cells, ``children`` ``ids, code, na_en`` and cells.
    """
    cells = cell_names()
    rows = total.select(
        *ids, F.lit(True).alias("is_total"), F.lit(None).cast("string").alias("child_code"), "na_en", *cells
    ).unionByName(
        children.select(*ids, F.lit(False).alias("is_total"), F.col("code").alias("child_code"), "na_en", *cells)
    )
    tables = F.array(
        *[
            F.struct(
                F.lit(n).alias("index_pos"),
                F.lit(i.key).alias("index_key"),
                F.lit(i.table_title).alias("title"),
                *[F.col(cell_name(i.key, b)).alias(b.key) for b in AT_RISK_BANDS],
            )
            for n, i in enumerate(INDEXES, start=1)
        ]
    )
    band_keys = [b.key for b in AT_RISK_BANDS]
    return rows.select(*ids, "is_total", "child_code", "na_en", F.inline(tables)).select(
        *ids, "index_pos", "index_key", "title", "is_total", "child_code", "na_en", *band_keys
    )


def in_table_order(rows: DataFrame, ids: Sequence[str] = ()) -> DataFrame:
    """Index by index, the total first, then the children by name with unnamed ones last."""
    return rows.orderBy(
        *ids, "index_pos", F.col("is_total").desc(), F.col("na_en").asc_nulls_last(), F.col("child_code")
    )


def scope_names(cube: DataFrame, country: str) -> DataFrame:
    """``scope_level, code, na_en`` of the country, the provinces and the districts of a cube.

    An admin unit known under several names takes the last one.
    """
    spark = cube.sparkSession
    top = spark.range(1).select(
        F.lit("country").alias("scope_level"), F.lit(None).cast("string").alias("code"), F.lit(country).alias("na_en")
    )
    units = [
        cube.groupBy(F.col(code).alias("code"))
        .agg(F.max(name).alias("na_en"))
        .select(F.lit(level).alias("scope_level"), "code", "na_en")
        for level, code, name in (
            ("province", "prov_code_1", "prov_na_en"),
            ("district", "dist_code", "dist_na_en"),
        )
    ]
    return top.unionByName(units[0]).unionByName(units[1])


def scope_children_rows(provinces: DataFrame, districts: DataFrame) -> DataFrame:
    """Child rows of all scopes, under the scope's own level and code."""
    cells = cell_names()
    return provinces.select(
        F.lit("country").alias("scope_level"),
        F.lit(None).cast("string").alias("scope_code"),
        "code",
        "na_en",
        *cells,
    ).unionByName(
        districts.select(
            F.lit("province").alias("scope_level"), F.col("parent_code").alias("scope_code"), "code", "na_en", *cells
        )
    )


def scope_table_rows(levels: DataFrame, names: DataFrame, children: DataFrame) -> DataFrame:
    """Table rows of all scopes: ``levels`` totals under their names, over ``scope_children_rows``."""
    known = names.select(F.col("scope_level").alias("_level"), F.col("code").alias("_code"), "na_en")
    same = (levels["scope_level"] == known["_level"]) & levels["code"].eqNullSafe(known["_code"])
    totals = levels.join(known, same, "left").select(
        "scope_level", F.col("code").alias("scope_code"), "na_en", *cell_names()
    )
    return table_rows(totals, children, ("scope_level", "scope_code"))


# A unit without a name, or a scope without a baseline, keeps the key.
_KEEP_NULLS = {"ignoreNullFields": "false"}


def panel_documents(totals: DataFrame, tables: DataFrame) -> DataFrame:
    """The panels of all scopes as JSON documents, ``doc``, with the columns that place them.

    A chart is one document: its slices or bars are few by nature. A table comes as a document per
    row, because nothing bounds the number of child units and no task should have to hold them all;
    ``position`` orders the rows of a table, the total first, then by name with unnamed ones last.
    Numbers are as they are. ``totals`` carries the baseline.
    """
    n_slices = len(AT_RISK_BANDS) + 1
    bands = [(F.lit(b.label), b) for b in AT_RISK_BANDS]

    def donut(i):
        rest = F.col("pop_total") - at_risk(i.key)
        slices = [
            F.struct(label.alias("label"), F.col(cell_name(i.key, b)).alias("value")) for label, b in bands
        ] + [F.struct(F.lit(NOT_AT_RISK_LABEL).alias("label"), rest.alias("value"))]
        assert len(slices) == n_slices
        return F.to_json(
            F.struct(F.lit(i.key).alias("key"), F.lit(i.title).alias("title"), F.array(*slices).alias("child")),
            _KEEP_NULLS,
        )

    def bar(i):
        return F.to_json(
            F.struct(
                F.lit(i.key).alias("key"),
                F.lit(i.title).alias("title"),
                F.array(*[label for label, _ in bands]).alias("labels"),
                F.array(*[F.col(cell_name(i.key, b)) for _, b in bands]).alias("values"),
            ),
            _KEEP_NULLS,
        )

    charts = F.array(
        *[
            F.struct(
                F.lit(panel).alias("panel"),
                F.lit(n).alias("index_pos"),
                F.lit(i.key).alias("index_key"),
                document(i).alias("doc"),
            )
            for panel, document in (("donut", donut), ("bar", bar))
            for n, i in enumerate(INDEXES, start=1)
        ]
    )
    chart_rows = totals.select("scope_level", F.col("code").alias("scope_code"), F.inline(charts)).select(
        "scope_level",
        "scope_code",
        "panel",
        "index_pos",
        "index_key",
        F.lit(False).alias("is_total"),
        F.lit(None).cast("string").alias("child_code"),
        F.lit(None).cast("int").alias("position"),
        "doc",
    )
    position = F.row_number().over(
        Window.partitionBy("scope_level", "scope_code", "index_pos").orderBy(
            F.col("is_total").desc(), F.col("na_en").asc_nulls_last(), F.col("child_code").asc_nulls_last()
        )
    )
    table = tables.select(
        "scope_level",
        "scope_code",
        F.lit("table").alias("panel"),
        "index_pos",
        "index_key",
        "is_total",
        "child_code",
        position.alias("position"),
        F.to_json(
            F.struct(
                F.col("index_key").alias("key"),
                "title",
                F.col("na_en").alias("name"),
                F.array(*[F.col(b.key) for b in AT_RISK_BANDS]).alias("values"),
            ),
            _KEEP_NULLS,
        ).alias("doc"),
    )
    return chart_rows.unionByName(table)


def area_panel_documents(totals: DataFrame, label: str) -> DataFrame:
    """The panels of drawn areas, from ``aoi_id``, cells and ``pop_total``: an area has no child units."""
    scoped = totals.withColumns({"scope_level": F.lit("area"), "code": F.col("aoi_id").cast("string")})
    named = scoped.withColumns({"scope_code": F.col("code"), "na_en": F.lit(label)})
    ids = ("scope_level", "scope_code")
    return panel_documents(scoped, table_rows(named, named.where(F.lit(False)), ids))


def write_panels(documents: DataFrame, path: str) -> None:
    """Write panel documents as JSON lines, a folder per scope level and panel.

    Folders of levels and panels that ``documents`` has no row of stay as they are, and all do if the job fails.
    """
    replace_partitions(documents.write, ("scope_level", "panel")).json(path)
