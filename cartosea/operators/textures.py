"""Named textures of octave noise for cells."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartosea.operators import lattice


def octaves(textures: dict[str, tuple], seed: int) -> list[tuple[str, int, int, float]]:
    """(texture, lattice, seed, weight) of every octave; textures: name -> (octaves, base, offset of the seed[, gain[,
    lacunarity]])."""
    out = []
    for name, (n, base, step, *more) in textures.items():
        g, lacunarity = [*more, 0.5, 2.0][:2] if len(more) != 1 else [more[0], 2.0]
        total = sum(g**i for i in range(n))
        out += [(name, max(2, int(base / lacunarity**i)), seed + step + 1000 * i, g**i / total) for i in range(n)]
    return out


def textured(cells: DataFrame, textures: dict[str, tuple], seed: int) -> DataFrame:
    """cells with a column of octave noise for each texture, added up where the cell is: no shuffle, a batch of cells at a
    time in arrays. The expression in the engine would be as long as the octaves, each four hashes."""
    asked = octaves(textures, seed)

    @F.pandas_udf(T.StructType([T.StructField(name, T.DoubleType()) for name in textures]))
    def noises(y: pd.Series, x: pd.Series) -> pd.DataFrame:
        y, x = y.to_numpy("int64"), x.to_numpy("int64")
        out = dict.fromkeys(textures, 0.0)
        for name, grid, own, weight in asked:
            out[name] = out[name] + weight * lattice.points_noise(y, x, grid, own)
        return pd.DataFrame(out)

    return cells.withColumn("_t", noises("y", "x")).select(*cells.columns, "_t.*")
