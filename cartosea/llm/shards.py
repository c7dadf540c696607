"""Shards of rows in order of an id: even in bytes, the same for the same rows however they arrive.

Cut points are quantiles, weighted by bytes, of a sample that a hash of the row's own values picks. They are pairs of
id and hash, so neither an outlying id nor one id with very many rows makes a heavy shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shards at most (beyond them a shard grows with the table), and sampled rows for each: bounds what the driver holds.
SHARDS, SAMPLES = 20_000, 64
_NULL = -(2**63)


def cuts(rows: DataFrame, id: Column, tie: Column, size: Column, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and hashes at which a new shard of about target bytes begins. tie is a hash of all that makes a row."""
    rows = rows.select(F.coalesce(id, F.lit(_NULL)).alias("i"), tie.alias("h"), size.cast("double").alias("s"))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("s"), F.lit(0.0))).first()
    shards = int(min(SHARDS, max(1, -(-total // target))))
    every = max(1, n // (shards * SAMPLES))
    if shards == 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # some shards * SAMPLES rows: a sample that is the same for the same rows
    got = rows.where(F.pmod(F.xxhash64("h", "i"), F.lit(every)) == 0).toPandas().sort_values(["i", "h"])
    filled = got["s"].cumsum().to_numpy()
    if not len(got):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.unique(np.searchsorted(filled, filled[-1] * np.arange(1, shards) / shards))
    picked = got.iloc[at[at < len(got)]].drop_duplicates(["i", "h"])
    return picked["i"].to_numpy(np.int64), picked["h"].to_numpy(np.int64)


def shard_of(found: tuple[np.ndarray, np.ndarray]):
    """A function of columns id and tie: the number of the row's shard. Only these two columns go to Python."""
    ids, ties = found

    @F.pandas_udf("int")
    def number(i: pd.Series, h: pd.Series) -> pd.Series:
        i, h = i.to_numpy(np.int64), h.to_numpy(np.int64)
        out, end = np.searchsorted(ids, i, "left"), np.searchsorted(ids, i, "right")
        for a in np.unique(out[out < end]).tolist():  # ids at which several shards begin
            rows = np.flatnonzero((out == a) & (out < end))
            z = int(end[rows[0]])
            out[rows] = a + np.searchsorted(ties[a:z], h[rows], "right")
        return pd.Series(out.astype(np.int32))

    return lambda id, tie: number(F.coalesce(id, F.lit(_NULL)), tie) if len(ids) else F.lit(0)


def dealt(rows: DataFrame, count: int, order: list) -> DataFrame:
    """Every shard in a task of its own, sorted."""
    return rows.repartitionById(max(1, count), F.col("shard")).sortWithinPartitions("shard", *order)
