"""Boundary features in GeoJSON.

A feature is kept as it was read, as a variant value beside the columns made of it, so that its id,
other members and properties nobody asked for survive until it is written again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandrisk.sources.store import replace_partitions

FEATURE = "feature"
GEOMETRY = "geometry"


def read_features(spark: SparkSession, path: str, properties: str | None = None, collection: bool = False) -> DataFrame:
    """Features of GeoJSON files: properties as columns, ``geometry`` as JSON text, the whole as ``feature``.

    One feature per line, which Spark can split; ``collection=True`` reads FeatureCollection
    documents, each of which is one record, however long. ``properties`` is the DDL schema of the
    properties; without it the files are read once more to find out. What is no JSON, or does not
    fit the schema, fails the query.
    """
    lines = spark.read.text(path, wholetext=collection).where("trim(value) <> ''")
    features = lines.select(F.parse_json("value").alias(FEATURE))
    if collection:
        features = features.selectExpr(f"explode(variant_get({FEATURE}, '$.features', 'array<variant>')) as {FEATURE}")
    if properties is None:
        found = features.selectExpr(f"schema_of_variant_agg(variant_get({FEATURE}, '$.properties', 'variant'))").first()[0]
        record = found.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")
    else:
        record = f"struct<{properties}>"
    return features.selectExpr(
        f"variant_get({FEATURE}, '$.properties', '{record}') as properties",
        f"to_json(variant_get({FEATURE}, '$.geometry', 'variant')) as {GEOMETRY}",
        FEATURE,
    ).select("properties.*", GEOMETRY, FEATURE)


def _names(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def feature_lines(features: DataFrame) -> DataFrame:
    """``value``: a GeoJSON feature per row, from its columns and, if it is there, the ``feature`` it came from.

    Columns replace properties of their names. One that is NULL is written as null, unless the
    feature never had it; what is no column stays as it was.
    """
    names = [c for c in features.columns if c not in (GEOMETRY, FEATURE)]
    new = F.create_map(*[x for c in names for x in (F.lit(c), F.col(f"`{c}`").cast("variant"))])
    if FEATURE in features.columns:
        members = F.expr(f"cast({FEATURE} as map<string, variant>)")
        old = F.coalesce(
            F.expr(f"try_cast(variant_get({FEATURE}, '$.properties', 'variant') as map<string, variant>)"),
            F.expr("cast(map() as map<string, variant>)"),
        )
        new = F.map_filter(new, lambda k, v: v.isNotNull() | F.map_contains_key(old, k))
        kept = F.map_filter(old, lambda k, v: ~F.array_contains(_names(names), k))
        properties = F.map_concat(kept, new)
    else:
        members = F.create_map(F.lit("type"), F.lit("Feature").cast("variant"))
        properties = new
    replaced = {"properties": F.to_variant_object(properties)}
    if GEOMETRY in features.columns:
        replaced[GEOMETRY] = F.parse_json(F.coalesce(F.col(GEOMETRY), F.lit("null")))
    others = F.map_filter(members, lambda k, v: ~F.array_contains(_names(list(replaced)), k))
    whole = F.map_concat(others, F.create_map(*[x for k, v in replaced.items() for x in (F.lit(k), v)]))
    return features.select(F.to_json(F.to_variant_object(whole)).alias("value"))


def write_features(features: DataFrame, path: str, request: str | None = None) -> None:
    """One GeoJSON feature per line.

    With a ``request``, the features go to the folder of that name below ``path`` and replace what it
    had once all are written; those of other requests stay.
    """
    lines = feature_lines(features)
    if request is None:
        lines.write.mode("overwrite").text(path)
    else:
        replace_partitions(lines.withColumn("request", F.lit(request)).write, ("request",)).text(path)
