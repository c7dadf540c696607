"""DataFrames by way of files in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def staged(df: DataFrame) -> DataFrame:
    """df by way of Parquet in the cluster's shared folder, which cuts the lineage of a loop."""
    spark = df.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("cartosea.shared.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='cartosea-')}"
        spark.conf.set("cartosea.shared.dir", base)
    path = f"{base.rstrip('/')}/loop-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_at = path
    return back


def discard(df: DataFrame) -> None:
    """Delete what staged() wrote, once nothing reads it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(conf).delete(path, True)
