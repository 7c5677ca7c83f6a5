"""Stored intermediate results and table layouts."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from bandrisk.functions.geometry import place_key


# Rows of a file and of a row group in a layout by place.
ROWS_IN_FILE = 4_000_000
ROW_GROUP_BYTES = 16 << 20


class Scratch:
    """Intermediate tables on storage that all executors share.

    The folder is the one the session names in ``spark.checkpoint.dir``; a session without one gets
    a folder beside its tables, in the warehouse. Tables are Parquet, so a later reader reads only
    the columns it needs, and they outlive the executors that wrote them. ``close`` removes them
    all; frames read from them must have been used by then. As a context manager it closes itself.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
            local = base.startswith("file:") or "://" not in base
            if local and not spark.conf.get("spark.master", "local").startswith("local"):
                raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        self.folder = f"{base.rstrip('/')}/bandrisk-{uuid.uuid4().hex}"
        self._kept: list[tuple[DataFrame, str]] = []

    def path(self) -> str:
        """A place for one more table."""
        return f"{self.folder}/{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        """Compute ``df`` once and read it back from then on."""
        path = self.path()
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self._kept.append((kept, path))
        return kept

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def drop(self, df: DataFrame) -> None:
        """Remove the files of one kept table."""
        for kept, path in self._kept:
            if kept is df:
                self._delete(path)

    def close(self) -> None:
        self._delete(self.folder)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, store it for as long as the folder lives, and read it back from then on."""
    return Scratch(df.sparkSession).keep(df)


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = "vuid") -> None:
    """Write a table bucketed and sorted on ``key``.

    Two tables written with the same number of buckets join on the key without a shuffle. Rows are
    shuffled to their buckets first, so that every bucket is one file.
    """
    bucketed = df.repartition(buckets, key)
    bucketed.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def write_by_region(df: DataFrame, path: str, keys: Sequence[str] = ("prov_code_1",)) -> None:
    """Write parquet in one folder per region, so that a regional query reads only its folder.

    The rebalance hint lets the adaptive planner split a region with most of the rows by its
    measured size, and merge small ones.
    """
    df.hint("rebalance", *[F.col(key) for key in keys]).write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_by_place(
    df: DataFrame, path: str, tie: str = "vuid", rows_in_file: int = ROWS_IN_FILE, row_group_bytes: int = ROW_GROUP_BYTES
) -> None:
    """Write parquet along a curve that fills the plane, so that files and row groups hold rows of one neighbourhood.

    The box filter of an area request then skips the others by their smallest and largest ``lon`` and
    ``lat``. Rows are dealt by range of place and ``tie``, so a place with very many rows is cut too;
    rows without a place come first.
    """
    files = max(1, -(-df.count() // rows_in_file))
    placed = df.withColumn("_place", F.expr(place_key("lon", "lat")))
    dealt = placed.repartitionByRange(files, "_place", tie).sortWithinPartitions("_place", tie).drop("_place")
    dealt.write.mode("overwrite").option("parquet.block.size", row_group_bytes).parquet(path)


def replace_partitions(writer: DataFrameWriter, keys: Sequence[str]) -> DataFrameWriter:
    """A writer that replaces only the folders (by ``keys``) it has rows for, when all of them are written.

    A failed job leaves every folder as it was.
    """
    return writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys)
