"""What the training-data operators share: the cluster's shared folder, staging, and slices of Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that a Python worker handles at a time.
SLICE_BYTES = 2 << 20


#: Bytes (or letters) of the longest word that workers remember: with the number of words it bounds what they hold.
LONG_WORD = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset a local run gets one of its own; a cluster, whose
    machines share no other folder, is refused."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("cartosea.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = f"file://{tempfile.mkdtemp(prefix='cartosea-')}"
        spark.conf.set("cartosea.shared.dir", found)
    return found if "://" in found or found.startswith("file:") else f"file://{found}"


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder's URI inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Shuffle files of a finished write go with it, instead of when the driver next collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path, before = workspace(spark, name), spark.conf.get(_CLEANUP)
    tune(spark)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_at = path
    return back


def discard(*staged: DataFrame) -> None:
    """Delete what stage() wrote, once nothing reads it any more."""
    for df in staged:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)  # any file system that Spark can use
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_key(text):
    """96 bits of a text's MD5 as binary: one key for exact copies, whatever ids their rows have."""
    return F.unhex(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 24))


def tune(spark: SparkSession) -> None:
    """Arrow batches bounded by rows and by bytes, so that long texts too fit beside an executor's heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def tidy() -> None:
    """Give a worker's freed memory back to the machine; workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # other C libraries have no such call
        pass


def column(df: DataFrame, name: str):
    """df's own column, however odd the names of the others are."""
    return df["`" + name.replace("`", "``") + "`"]


def sliced(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about limit bytes of the text column (one long row may exceed it)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
        cut = np.cumsum(size) // limit
        edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    tidy()


def utf8(col: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return pc.fill_null(col.cast(pa.binary()), b"").to_pylist()
