"""Terrain recipes, parcels and palettes over world coordinates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartosea.functions import noise
from cartosea.functions.colour import clip01
from cartosea.operators import stencil as st
from cartosea.operators.graph import staged
from cartosea.operators.textures import textured

@dataclass(frozen=True)
class Relief:
    """How a biome's elevation is made: textures, those of them that fold to ridges in pairs, the field over both as SQL,
    strength and seed offset of the warp, and lowest elevation and range in metres."""

    textures: dict[str, tuple[int, int, int]]
    field: str
    warp: tuple[int, int] | None
    low: float
    span: float
    ridges: tuple[str, ...] = ()
    stretched_first: bool = False


def ridge_textures(name: str, octaves: int, base: int, step: int) -> dict[str, tuple[int, int, int]]:
    """The two noises whose folds make a ridge texture."""
    return {f"{name}_a": (octaves, base, step), f"{name}_b": (4, max(8, base // 2), step + 99)}


def ridge_of(name: str) -> str:
    """Their fold as SQL, before it is stretched to 0..1."""
    return f"0.6 * (1.0 - abs(2.0 * {name}_a - 1.0)) + 0.4 * (1.0 - abs(2.0 * {name}_b - 1.0))"


def reliefs(pixel: float = 1.0) -> dict[str, Relief]:
    """Fixed values of each biome; a mountain's textures have sizes in metres."""
    m = lambda metres: max(2, int(metres / pixel))
    two = lambda a, b: {"base": a, "detail": b}
    return {
        "mountain": Relief(ridge_textures("macro", 5, m(800), 0) | ridge_textures("meso", 5, m(250), 1) | {"micro": (3, m(60), 2)}, "220.0 * macro + 90.0 * meso + 20.0 * micro", (16, 3), 80.0, 470.0, ("macro", "meso"), True),
        "desert": Relief({"base": (6, 256, 0)} | ridge_textures("plate", 3, 512, 9), "0.52 * base + 0.32 * plate + 0.16 * dune", (10, 3), 50.0, 300.0, ("plate",)),
        "city": Relief({"base": (6, 256, 0), "wide": (2, 64, 22), "tall": (2, 64, 23)}, "power(base, 1.15)", None, 0.0, 120.0),
        "farm": Relief(two((5, 512, 0), (4, 128, 1)), "power(0.75 * base + 0.25 * detail, 0.85)", (8, 2), 20.0, 160.0),
        "coast": Relief(two((6, 384, 0), (5, 96, 1)), "power(0.70 * base + 0.30 * detail, 0.90)", (10, 2), 0.0, 100.0),
        "island": Relief(two((6, 192, 0), (5, 48, 1)), "0.60 * base + 0.40 * detail", (12, 2), 0.0, 280.0),
        "forest": Relief(two((7, 256, 0), (6, 64, 1)), "0.66 * base + 0.34 * detail", (14, 2), 40.0, 280.0),
    }


def warp_textures(step: int) -> dict[str, tuple[int, int, int]]:
    """The noises that bend a field along x and y."""
    return {"bend_x": (4, 96, step + 1), "bend_y": (4, 96, step + 2)}


def warped(cells: DataFrame, value: str, strength: int) -> DataFrame:
    """(y, x, v): value taken from where bend_x and bend_y point."""
    return st.gather(cells, value, (F.col("bend_y") - 0.5) * float(strength), (F.col("bend_x") - 0.5) * float(strength))


#: The city's basin as SQL over its textures and the grid's size h, w; its warp; where it is deep enough to count.
BASIN = "1.0 - (power((x - floor(w * 0.52)) / greatest(0.18 * least(w, h) * (1.0 + 0.2 * wide), 0.001), 2.0) + power((y - floor(h * 0.48)) / greatest(0.15 * least(w, h) * (1.0 + 0.2 * tall), 0.001), 2.0))"
BASIN_WARP, BASIN_DEPTH = (14, 24), 0.4


def make_dem(cells: DataFrame, biome: str, seed: int = 42, pixel: float = 1.0) -> DataFrame:
    """(y, x, z_m): a biome's elevation in metres over the cells (y, x): textures, ridges and dunes stretched to 0..1,
    their sum, warp, stretch to the band; a city has a basin."""
    r = reliefs(pixel)[biome]
    bends = warp_textures((r.warp or BASIN_WARP)[1])
    # written once: every range over the grid reads it again
    full = staged(textured(cells.select("y", "x"), r.textures | bends, seed))
    for name in r.ridges:
        full = st.stretch(full, F.expr(ridge_of(name)), name)
    if biome == "desert":
        full = st.stretch(full, noise.dune(F.col("x"), F.col("y"), 24, 25.0, seed + 5), "dune")
    full = full.withColumn("v", F.expr(r.field).cast("double"))
    if r.stretched_first:
        full = st.stretch(full, F.col("v"), "v", eps=1e-6)
    if r.warp:
        full = warped(full, "v", r.warp[0])
    if biome == "city":
        deep = st.stretch(full.crossJoin(F.broadcast(st.extent(cells))), F.expr(BASIN).cast("double"), "basin").drop("h", "w")
        bent = warped(deep, "basin", BASIN_WARP[0]).withColumnRenamed("v", "basin")
        full = full.join(bent, ["y", "x"]).withColumn("v", F.when(F.col("basin") > BASIN_DEPTH, F.col("v") * 0.25 + 0.14).otherwise(F.col("v")))
    if not r.stretched_first:
        full = st.stretch(full, F.col("v"), "v")
    return full.select("y", "x", (r.low + r.span * F.col("v")).alias("z_m"))


# Reflectances of parcels by class (pasture, dry, woodland) and shade, then of water, hedges and tracks.
PARCELS = [
    [(0.35, 0.52, 0.28), (0.32, 0.50, 0.26), (0.28, 0.45, 0.22)],
    [(0.48, 0.54, 0.34), (0.45, 0.50, 0.32), (0.42, 0.48, 0.30)],
    [(0.20, 0.32, 0.18), (0.18, 0.30, 0.16), (0.22, 0.35, 0.20)],
]
WATER, HEDGE, TRACK = (0.12, 0.22, 0.32), (0.15, 0.22, 0.12), (0.72, 0.68, 0.60)


def parcel_colours(cells: DataFrame, field: str, water: str, hedge: str, track: str) -> DataFrame:
    """(y, x, r, g, b): parcels by hashed greenness and shade; tracks over hedges over water over parcels."""
    green, vary = noise.field_attributes(F.col(field))
    kind = F.when(green < 0.50, 0).when(green < 0.75, 1).otherwise(2)
    shade = F.pmod(F.floor(vary * 3.0).cast("int"), F.lit(3))

    def band(i):
        table = F.array(*[F.lit(PARCELS[k][s][i]) for k in range(3) for s in range(3)])
        base = F.element_at(table, (kind * 3 + shade + 1).cast("int"))
        return clip01(F.when(F.col(track), TRACK[i]).when(F.col(hedge), HEDGE[i]).when(F.col(water), WATER[i]).otherwise(base) * 0.88)

    return cells.select("y", "x", *[band(i).alias(c) for i, c in enumerate("rgb")])


def city_blocks(x, y, street: int = 24, block: int = 6):
    """(road, height): a street grid by remainders and heights in steps, by the hash of the block."""
    road = (F.pmod(x, F.lit(street)) < block) | (F.pmod(y, F.lit(street)) < block)
    h = noise.hash_lattice(F.floor(x / street), F.floor(y / street), 77)
    return road, F.when(road, 0.0).otherwise(F.floor(h * 8.0) * 3.0 + 6.0)
