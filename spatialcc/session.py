"""Session settings that the library relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings every session should have; cluster sizes are left to the deployment.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A union that claims its sides' partitioning gives wrong windows where adaptive execution coalesces the sides apart.
    "spark.sql.unionOutputPartitioning": "false",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks."""
    os.environ.setdefault("TZ", "UTC")
    builder = SparkSession.builder.master(f"local[{cores}]").appName("spatialcc")
    conf = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
