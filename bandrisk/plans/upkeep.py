"""Totals that are kept up to date: stored cubes to which changes are added.

A cube holds exact sums, so that of a day's new rows can be added to it and that of rows that are gone
be taken off, and the result is the cube of the rows there are now, to the last bit. ``ROWS`` counts the
rows of a group, which ends when none are left. Every change is a folder of its own, named by the caller:
writing it again replaces it, so a job that failed or ran twice counts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandrisk.functions import exact
from bandrisk.operators.rollup import CUBE_KEYS, cell_expressions, cell_names, with_parts
from bandrisk.sources.store import replace_partitions

ROWS = "_rows"
CHANGE = "change"


def counted_cube(joined: DataFrame, keys: Sequence[str] = CUBE_KEYS) -> DataFrame:
    """Raw cells of joined rows by keys and bin, and how many rows there are."""
    sums = [F.expr(f"{e} AS `{name}`") for name, e in cell_expressions().items()]
    rows = F.count(F.lit(1)).cast("long").alias(ROWS)
    return with_parts(joined).groupBy(*keys, exact.BIN).agg(rows, *sums)


def change_of(added: DataFrame | None, removed: DataFrame | None, keys: Sequence[str] = CUBE_KEYS) -> DataFrame:
    """The cube to add for joined rows that came and joined rows that went; a changed row is both."""
    if added is None and removed is None:
        raise ValueError("a change needs rows that came or went")
    parts = []
    if added is not None:
        parts.append(counted_cube(added, keys))
    if removed is not None:
        gone = [(-F.col(c)).cast(exact.TYPE).alias(c) for c in cell_names()]
        parts.append(counted_cube(removed, keys).select(*keys, exact.BIN, (-F.col(ROWS)).alias(ROWS), *gone))
    return parts[0] if len(parts) == 1 else merged(parts[0].unionByName(parts[1]), keys)


def merged(cubes: DataFrame, keys: Sequence[str] = CUBE_KEYS) -> DataFrame:
    """One cube of several. As many rows may have gone from a group as came, so groups of no rows stay."""
    sums = [F.expr(f"{exact.merged(c)} AS `{c}`") for c in cell_names()]
    return cubes.groupBy(*keys, exact.BIN).agg(F.sum(ROWS).alias(ROWS), *sums)


def write_change(cube: DataFrame, path: str, name: str) -> None:
    """Store a cube as the change ``name``, in place of one of that name."""
    replace_partitions(cube.withColumn(CHANGE, F.lit(name)).write, (CHANGE,)).parquet(path)


def current_cube(spark: SparkSession, path: str, keys: Sequence[str] = CUBE_KEYS) -> DataFrame:
    """The cube that all stored changes add up to, as ``rollup.admin_cube`` gives it. The big tables are not read."""
    return merged(spark.read.parquet(path).drop(CHANGE), keys).where(F.col(ROWS) != 0).drop(ROWS)


def compact(spark: SparkSession, path: str, into: str, name: str = "base", keys: Sequence[str] = CUBE_KEYS) -> None:
    """Write all changes below ``path`` as one at another place, which has the rows of a single change then."""
    write_change(merged(spark.read.parquet(path).drop(CHANGE), keys), into, name)
