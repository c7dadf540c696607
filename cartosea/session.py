"""Session builder for local runs and tests; a cluster brings its own session."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(name: str, cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with UTC time and AQE; only a local run gets a checkpoint folder from here."""
    shared = os.environ.get("CARTOSEA_SHARED") or tempfile.mkdtemp(prefix="cartosea-")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
