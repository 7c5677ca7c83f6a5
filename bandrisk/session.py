"""Session settings for cluster and local use."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings the jobs count on. The number of shuffle partitions is left to the cluster; the
# adaptive planner merges small ones, splits heavy ones, and spares a join the sort where every
# partition was measured to fit a hash table.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", app_name: str = "bandrisk", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app_name)
    partitions = str(cores) if str(cores).isdigit() else "8"
    settings = RECOMMENDED_CONF | {
        "spark.sql.shuffle.partitions": partitions,
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
