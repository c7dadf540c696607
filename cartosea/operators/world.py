"""The base-world job: layers of a terrain at several resolutions, all from one base that is made once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartosea.functions import colour
from cartosea.operators import stencil as st
from cartosea.operators.graph import discard, staged
from cartosea.sources import rasters, runs

#: Layers of a level and their units; rgb has a layer for each band.
LAYERS = {"dem": "m", "visual": "1/65535", "slope": "1", "hillshade": "1", "water": "mask", "flood": "mask", "contours": "mask", "r": "1", "g": "1", "b": "1"}
#: Metres between contours.
INTERVAL = 20.0


def level(base: DataFrame, factor: int, gsd: float) -> DataFrame:
    """(y, x, layers...) of cells factor times as wide as those of base (y, x, z, water, flood, r, g, b): elevations and
    colours averaged, masks by any, and slope, shade, contours and the visual layer made anew from the coarse elevation.
    Cells beyond the last whole block are cropped."""
    cells = base
    if factor > 1:
        means = {c: F.avg(c) for c in ("z", "r", "g", "b")} | {c: F.bool_or(c) for c in ("water", "flood")}
        cells = st.block(base, factor, **means).withColumnsRenamed({"by": "y", "bx": "x"})
    steep = st.gradient(cells, "z", gsd).withColumn("slope", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))).withColumn("visual", F.col("z"))
    ranged = st.stretch_all(steep, ["slope", "visual"])
    mask = lambda c: c.cast("double")
    return ranged.select(
        "y", "x", F.col("z").alias("dem"), F.floor(F.col("visual") * 65535.0).alias("visual"), "slope", st.hillshade(F.col("gy"), F.col("gx")).alias("hillshade"),
        mask(F.col("water")).alias("water"), mask(F.col("flood")).alias("flood"), mask(colour.contour(F.col("z"), INTERVAL)).alias("contours"), "r", "g", "b",
    )


def factors(base_gsd: float, wanted: dict[str, float]) -> dict[str, int]:
    """How many base cells a cell of each resolution is wide; a finer one, or one that isn't a whole multiple, is an error."""
    out = {}
    for name, gsd in wanted.items():
        k = gsd / base_gsd
        if k < 1 or abs(k - round(k)) > 1e-9:
            raise ValueError(f"{name}: {gsd} m is no multiple of the base's {base_gsd} m")
        out[name] = round(k)
    return out


def levels(base: DataFrame, base_gsd: float, wanted: dict[str, float]) -> DataFrame:
    """(resolution, y, x, layers...) of every wanted resolution (name -> metres)."""
    found = factors(base_gsd, wanted)
    return reduce(DataFrame.unionByName, [level(base, k, wanted[name]).withColumn("resolution", F.lit(name)) for name, k in found.items()])


def build(spark: SparkSession, base: DataFrame, base_gsd: float, wanted: dict[str, float], path: str, west: float, north: float, timestamp: str) -> None:
    """Write all layers of all levels to path, their geometry and a manifest. The base is written once and read by every
    level; each level is one write. Levels whose extents don't fit the base's, cropped, are an error, found before the manifest
    is written, so a folder with a manifest is whole."""
    once = staged(base.select("y", "x", "z", "water", "flood", "r", "g", "b"))
    size = st.extent(once).first()
    for name, k in factors(base_gsd, wanted).items():
        made = level(once, k, wanted[name])
        long = made.select("y", "x", F.explode(F.array(*[F.struct(F.lit(c).alias("layer"), F.col(c).cast("double").alias("value")) for c in LAYERS])).alias("l")).select("y", "x", "l.layer", "l.value")
        rasters.write_layers(long, path, name, wanted[name], west, north, LAYERS)
        about = spark.read.parquet(f"{path}/layers").where(F.col("resolution") == name).select("layer", "height", "width").collect()
        want = (size["h"] // k, size["w"] // k)
        if {r["layer"] for r in about} != set(LAYERS) or {(r["height"], r["width"]) for r in about} != {want}:
            raise ValueError(f"{name}: layers of {sorted({(r['height'], r['width']) for r in about})} cells, not {want}")
    discard(once)
    runs.write_metadata(spark, f"{path}/manifest", "base world", timestamp, outputs=sorted(LAYERS), resolutions=wanted, zooms={n: rasters.ZOOMS.get(n, (0, 0)) for n in wanted})
