"""City imagery: roofs, parks and roads over the grid, and a rotated street lattice with heights."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartosea.functions.colour import clip01
from cartosea.functions.noise import hash_lattice
from cartosea.operators import stencil as st
from cartosea.operators.graph import staged
from cartosea.operators.textures import textured

#: Metres between roads, half their width in cells, and how far noise moves them.
ROAD_EVERY, ROAD_HALF, ROAD_SHIFT = 100, 2, 30
# What a surface is (first that holds, SQL over the textures) and its bands; the last one is the rest.
SURFACES = [
    ("water", ("0.15 + 0.05 * deep", "0.20 + 0.06 * deep", "0.30 + 0.08 * deep")),
    ("park > 0.75", ("0.25 + 0.10 * leaf", "0.40 + 0.15 * leaf", "0.22 + 0.08 * leaf")),
    ("road", ("0.38 + 0.04 * asphalt", "0.38 + 0.04 * asphalt", "0.40 + 0.04 * asphalt")),
    ("coarse > 0.75", ("0.60 + 0.12 * fine", "0.42 + 0.08 * fine", "0.35 + 0.06 * fine")),
    ("medium > 0.6 AND medium < 0.8", ("0.55 + 0.10 * fine", "0.50 + 0.08 * fine", "0.42 + 0.06 * fine")),
    ("TRUE", ("0.45 + 0.15 * coarse + 0.08 * fine", "0.45 + 0.15 * coarse + 0.08 * fine", "0.47 + 0.15 * coarse + 0.08 * fine")),
]


def textures(pixel: float = 1.0) -> dict[str, tuple[int, int, int]]:
    """Octaves, size and seed offset of each noise; those in metres follow the pixel."""
    m = lambda metres: max(2, round(metres / pixel))
    return {"coarse": (4, m(120), 10), "medium": (6, m(40), 11), "fine": (8, m(10), 12), "park": (5, m(80), 20), "leaf": (6, m(20), 21), "pattern": (3, 300, 100), "asphalt": (10, m(4), 150), "deep": (8, 40, 200)}


#: The noises that are stretched to 0..1.
STRETCHED = ("coarse", "medium", "fine", "leaf", "pattern", "asphalt", "deep")


def band_of(i: int) -> str:
    """A band's value as SQL."""
    return "CASE " + " ".join(f"WHEN {when} THEN {bands[i]}" for when, bands in SURFACES) + " END"


def _roads(cells: DataFrame, along: str, across: str, size: str, other: str) -> DataFrame:
    """Rows (or columns) under a road: every hundredth, moved by the pattern at the middle of the grid, and its width."""
    line = cells.where((F.col(along) % ROAD_EVERY == 0) & (F.col(across) == F.floor(F.col(other) / 2)))
    middle = line.select(size, (F.col(along) + ((F.col("pattern") - 0.5) * float(ROAD_SHIFT)).cast("int")).alias("c")).where((F.col("c") >= 0) & (F.col("c") < F.col(size)))
    return middle.select(F.explode(F.sequence(F.col("c") - ROAD_HALF, F.col("c") + ROAD_HALF)).alias(along)).distinct()


def city_rgb(cells: DataFrame, seed: int = 42, pixel: float = 1.0) -> DataFrame:
    """cells (y, x, n, water) with r, g, b and road: roofs of three kinds, parks, water, and roads that neither cross. The
    roads' rows and columns are two tables as long as the grid's sides, joined to the cells by y and by x."""
    full = staged(textured(cells, textures(pixel), seed))
    full = st.stretch_all(full, STRETCHED).crossJoin(F.broadcast(st.extent(cells)))
    rows = _roads(full, "y", "x", "h", "w").withColumn("_row", F.lit(True))
    columns = _roads(full, "x", "y", "w", "h").withColumn("_column", F.lit(True))
    lined = full.join(rows, "y", "left").join(columns, "x", "left").withColumn("road", F.coalesce("_row", "_column", F.lit(False)))
    kept = lined.withColumn("road", F.col("road") & ~F.col("water") & (F.col("park") <= 0.75))
    return kept.select(*cells.columns, "road", *[clip01(F.expr(band_of(i)).cast("double")).alias(c) for i, c in enumerate("rgb")])


#: Sides of blocks, width of streets, in metres; noises of the scene: octaves, size, seed offset, gain.
BLOCKS, STREET = (80.0, 104.0), 8.0
SCENE = {"lane": (3, 200, 50, 0.5), "tall": (4, 120, 200, 0.6), "green": (4, 150, 300, 0.5), "roof": (5, 60, 400, 0.5), "stuff": (3, 100, 500, 0.6)}


def city_scene(cells: DataFrame, seed: int = 42) -> DataFrame:
    """(y, x, road, park, height, r, g, b): streets of a lattice turned by the seed's degrees and a few stray ones, blocks of
    flat roofs in eight heights, parks; reflectances without light."""
    a = math.radians(seed % 360)
    full = textured(cells.select("y", "x"), SCENE, seed)
    one, two = F.col("x") * math.cos(a) + F.col("y") * math.sin(a), F.col("y") * math.cos(a) - F.col("x") * math.sin(a)
    street = (F.pmod(one, F.lit(BLOCKS[0])) < STREET) | (F.pmod(two, F.lit(BLOCKS[1])) < STREET)
    stray = (F.col("lane") > 0.85) & (hash_lattice(F.col("x"), F.col("y"), seed + 51) < 0.02)
    full = full.withColumn("road", street | stray)
    full = full.withColumn("park", (F.col("green") > 0.825) & ~F.col("road"))
    height = F.when(F.col("road") | F.col("park"), 0.0).otherwise(5.0 + 30.0 * F.floor(F.col("tall") * 8.0) / 8.0)
    light = 0.50 + 0.20 * F.col("roof")
    warm = F.col("stuff") > 0.7
    of = lambda park, road, hot, cold: clip01(F.when(F.col("park"), park).when(F.col("road"), road).otherwise(light * F.when(warm, hot).otherwise(cold)))
    return full.select("y", "x", "road", "park", height.alias("height"), of(0.22, 0.18, 1.05, 0.98).alias("r"), of(0.38, 0.18, 0.95, 1.00).alias("g"), of(0.20, 0.19, 0.85, 1.02).alias("b"))
