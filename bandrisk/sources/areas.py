"""Area-of-interest requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST_SCHEMA = "aoi_id bigint, spatialfilter array<string>, flag string, code string"


def read_requests(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Request bodies, one JSON object per line: ``aoi_id``, ``spatialfilter``, ``flag``, ``code``.

    A body that is no such object fails the query, so that none is lost.
    """
    return spark.read.schema(REQUEST_SCHEMA).json(path, multiLine=multiline, mode="FAILFAST")


def request_areas(requests: DataFrame) -> DataFrame:
    """``aoi_id, ord, wkt``: the polygon texts of the requests, one row each.

    A request without texts has no row here; figures of areas are asked for by the requests' ids.
    """
    return requests.select("aoi_id", F.posexplode("spatialfilter").alias("ord", "wkt"))
