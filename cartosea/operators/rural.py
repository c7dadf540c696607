"""Rural imagery: parcels with hedges and tracks, and a forest's canopy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartosea.functions import noise
from cartosea.functions.colour import clip01
from cartosea.operators import stencil as st
from cartosea.operators.graph import staged
from cartosea.operators.terrain import HEDGE, PARCELS, TRACK
from cartosea.operators.textures import textured

#: Side of a parcel, how far noise moves its borders, and how far slopes do: at rest and for each unit of slope.
PARCEL, MOVED, BENT, STEEPER = 18.0, 35.0, 20.0, 30.0
#: Noises: grass of some metres, its blades, and the moves of parcels.
TEXTURES = {"fine": (6, 6, 50), "micro": (7, 2, 51), "move_x": (1, 40, 11), "move_y": (1, 40, 12)}
# Water of two kinds, how much grain each band has, of blades too, and the muted light of the whole.
WATERS = [(0.20, 0.35, 0.40), (0.14, 0.28, 0.32)]
GRAIN = [(0.03, 0.03, 0.02), (0.03, 0.03, 0.02), (0.02, 0.02, 0.02)]
BLADES, MUTED = (0.02, 0.025, 0.015), 0.88


def parcels(cells: DataFrame, value: str, seed: int) -> DataFrame:
    """cells with gx, gy, the textures and field: the parcel, warped by noise and along slopes."""
    full = textured(st.gradient(cells, value), TEXTURES, seed)
    bend = BENT + F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) * STEEPER
    angle = F.atan2("gy", "gx")
    at = lambda c, f: F.floor((F.col(c) + F.col(f"move_{c}") * MOVED + f(angle) * bend) / PARCEL)
    return full.withColumn("field", (at("x", F.cos) * 10000 + at("y", F.sin)).cast("int"))


def rural_rgb(cells: DataFrame, seed: int = 42) -> DataFrame:
    """(y, x, r, g, b) of cells (y, x, n, water): pasture, dry fields and woodland by parcel, each in three shades, with grain;
    water of two kinds; hedges between parcels; tracks along them and across flat ground."""
    full = staged(parcels(cells.select("y", "x", "n", "water"), "n", seed))
    green, vary = noise.field_attributes(F.col("field"))
    full = full.join(st.boundaries(full, "field"), ["y", "x"]).withColumns({"green": green, "vary": vary})
    flat = (1.0 - F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))) * F.col("vary")
    land = ~F.col("water")
    track = land & ((F.col("edge") & (F.col("vary") > 0.88) & (flat > 0.3)) | ((flat > 0.7) & (F.col("vary") > 0.85)))
    kind = F.when(F.col("green") < 0.50, 0).when(F.col("green") < 0.75, 1).otherwise(2)
    shade = F.pmod(F.floor(F.col("vary") * 3.0).cast("int"), F.lit(3))

    def band(i):
        base = F.element_at(F.array(*[F.lit(PARCELS[k][s][i]) for k in range(3) for s in range(3)]), (kind * 3 + shade + 1).cast("int"))
        grain = F.element_at(F.array(*[F.lit(g[i]) for g in GRAIN]), kind + 1)
        wet = F.when(F.col("vary") > 0.5, WATERS[0][i]).otherwise(WATERS[1][i]) + 0.04 * F.col("fine")
        ground = F.when(track, TRACK[i]).when(F.col("edge") & land, HEDGE[i]).when(F.col("water"), wet).otherwise(base + grain * F.col("fine"))
        return clip01((ground + F.when(land, BLADES[i] * F.col("micro")).otherwise(0.0)) * MUTED)

    return full.select("y", "x", *[band(i).alias(c) for i, c in enumerate("rgb")])


#: Noises of the canopy: octaves, size, seed offset, gain, lacunarity; the share of it that is a clearing.
CANOPY, CLEARING = {"large": (4, 128, 100, 0.6, 2.0), "medium": (3, 48, 101, 0.5, 2.2)}, 0.35


def forest_scene(cells: DataFrame, seed: int = 42) -> DataFrame:
    """(y, x, canopy, r, g, b): height of the trees in metres, 0 in clearings, and reflectances."""
    full = textured(cells.select("y", "x"), CANOPY, seed)
    dense = 0.7 * F.col("large") + 0.3 * F.col("medium")
    full = full.withColumn("c", F.when(dense > CLEARING, dense).otherwise(0.0))
    bands = [clip01(a + b * F.col("c")) for a, b in ((0.18, 0.15), (0.35, 0.35), (0.15, 0.10))]
    return full.select("y", "x", (F.col("c") * (8.0 + 6.0 * (2.0 * F.col("medium") - 1.0))).alias("canopy"), *[v.alias(c) for v, c in zip(bands, "rgb")])
