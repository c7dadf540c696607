"""Raster layers as Parquet, partitioned by layer, resolution and tile, beside a table of their geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODATA = -9999.0
#: Side of a stored tile in cells, and web zooms of each resolution.
TILE = 256
ZOOMS = {"25cm": (17, 20), "1m": (14, 17), "10m": (10, 14)}


def write(cells: DataFrame, value: str, path: str, layer: str, resolution: str, gsd: float, west: float, north: float, units: str) -> None:
    """Add a layer: cells tiled and sorted so that row groups hold neighbours; what isn't finite becomes NODATA. Its
    geometry (affine transform to 12 decimals, units, zooms) goes to the table `layers`."""
    v = F.col(value).cast("double")
    good = F.when(F.isnan(v) | v.isNull() | (F.abs(v) == float("inf")), NODATA).otherwise(v)
    tiled = cells.select("y", "x", good.alias("value"), F.floor(F.col("y") / TILE).cast("int").alias("ty"), F.floor(F.col("x") / TILE).cast("int").alias("tx"))
    tagged = tiled.withColumns({"layer": F.lit(layer), "resolution": F.lit(resolution)})
    tagged.repartition("ty", "tx").sortWithinPartitions("ty", "tx", "y", "x").write.mode("append").partitionBy("layer", "resolution", "ty", "tx").parquet(f"{path}/cells")
    lo, hi = ZOOMS.get(resolution, (0, 0))
    about = cells.agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width")).select(
        F.lit(layer).alias("layer"), F.lit(resolution).alias("resolution"), "height", "width", F.lit(units).alias("units"), F.lit(NODATA).alias("nodata"), F.lit(lo).alias("min_zoom"), F.lit(hi).alias("max_zoom"),
        F.struct(*[F.round(F.lit(float(q)), 12).alias(n) for n, q in zip("abcdef", (gsd, 0.0, west, 0.0, -gsd, north))]).alias("transform"),
    )
    about.coalesce(1).write.mode("append").parquet(f"{path}/layers")


def write_layers(long: DataFrame, path: str, resolution: str, gsd: float, west: float, north: float, units: dict[str, str]) -> None:
    """Add many layers (layer, y, x, value) of one resolution in one write, and a row of geometry for each."""
    good = F.when(F.isnan("value") | F.col("value").isNull() | (F.abs("value") == float("inf")), NODATA).otherwise(F.col("value"))
    tiled = long.select("layer", "y", "x", good.alias("value"), F.lit(resolution).alias("resolution"), F.floor(F.col("y") / TILE).cast("int").alias("ty"), F.floor(F.col("x") / TILE).cast("int").alias("tx"))
    tiled.repartition("layer", "ty", "tx").sortWithinPartitions("layer", "ty", "tx", "y", "x").write.mode("append").partitionBy("layer", "resolution", "ty", "tx").parquet(f"{path}/cells")
    lo, hi = ZOOMS.get(resolution, (0, 0))
    stored = long.sparkSession.read.parquet(f"{path}/cells").where(F.col("resolution") == resolution)
    unit = F.element_at(F.create_map(*[F.lit(x) for kv in units.items() for x in kv]), F.col("layer"))
    about = stored.groupBy("layer").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width")).select(
        "layer", F.lit(resolution).alias("resolution"), "height", "width", unit.alias("units"), F.lit(NODATA).alias("nodata"), F.lit(lo).alias("min_zoom"), F.lit(hi).alias("max_zoom"),
        F.struct(*[F.round(F.lit(float(q)), 12).alias(n) for n, q in zip("abcdef", (gsd, 0.0, west, 0.0, -gsd, north))]).alias("transform"),
    )
    about.coalesce(1).write.mode("append").parquet(f"{path}/layers")


#: Overviews: halvings of the base.
LEVELS = (1, 2, 3, 4)


def overviews(cells: DataFrame, value: str, nearest: bool = False, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(level, y, x, value): cells of 2**level base cells a side. Means over what a block has, or for masks the cell at the
    block's middle. One pass: a cell is a row for each level, added up map-side, so what is shuffled shrinks with the
    level; of nearest cells only the chosen ones are kept."""
    each = cells.select("y", "x", F.col(value).alias("value"), F.explode(F.array(*map(F.lit, levels))).alias("level"))
    side = F.expr("shiftleft(1, level)")
    block = [F.floor(F.col(c) / side).cast("int").alias(c) for c in ("y", "x")]
    if nearest:
        middle = (F.col("y") % side == F.floor(side / 2)) & (F.col("x") % side == F.floor(side / 2))
        return each.where(middle).select("level", *block, "value")
    return each.groupBy("level", *block).agg(F.avg("value").alias("value"))


def write_overviews(cells: DataFrame, value: str, path: str, layer: str, resolution: str, nearest: bool = False) -> None:
    """Store a layer's overviews beside it, by level and tile: a read of one level lists that level's folders only."""
    out = overviews(cells, value, nearest).withColumns({"layer": F.lit(layer), "resolution": F.lit(resolution), "ty": F.floor(F.col("y") / TILE).cast("int"), "tx": F.floor(F.col("x") / TILE).cast("int")})
    out.repartition("level", "ty", "tx").sortWithinPartitions("level", "ty", "tx", "y", "x").write.mode("append").partitionBy("layer", "resolution", "level", "ty", "tx").parquet(f"{path}/overviews")


def read_overview(spark: SparkSession, path: str, layer: str, resolution: str, level: int) -> DataFrame:
    """(y, x, value) of one level."""
    return spark.read.parquet(f"{path}/overviews/layer={layer}/resolution={resolution}/level={level}").select("y", "x", "value")


def rescaled(transform: dict[str, float], width: int, height: int, new_width: int, new_height: int) -> dict[str, float]:
    """The affine transform of a layer that is resampled to other numbers of cells: the corner stays, cells grow."""
    kx, ky = width / new_width, height / new_height
    return transform | {"a": transform["a"] * kx, "b": transform["b"] * ky, "d": transform["d"] * kx, "e": transform["e"] * ky}


def read(spark: SparkSession, path: str, layer: str, resolution: str) -> DataFrame:
    """(y, x, value) of a layer; only its folders are listed."""
    cells = spark.read.parquet(f"{path}/cells/layer={layer}/resolution={resolution}")
    return cells.select("y", "x", F.when(F.col("value") != NODATA, F.col("value")).alias("value"))
