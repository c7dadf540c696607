"""Colours of a biome's ground: textures of lattice noise, and layers painted over each other.

A palette is data: named textures, and layers of a condition with an expression for each band, all over the columns
n (elevation 0..1), moisture (0..1), water and the textures. The topmost layer whose condition holds gives the colour.
The expressions are plain SQL, so another engine can be asked the same question.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartosea.functions import noise
from cartosea.functions.colour import clip01
from cartosea.operators import stencil as st
from cartosea.operators.city import city_rgb
from cartosea.operators.ranks import quantiles
from cartosea.operators.rural import rural_rgb
from cartosea.operators.stages import staged
from cartosea.operators.textures import textured


@dataclass(frozen=True)
class Palette:
    """textures: name -> (octaves, base, offset of the seed). layers: (condition, red, green, blue), bottom first."""

    textures: dict[str, tuple[int, int, int]]
    layers: list[tuple[str, str, str, str]] = field(default_factory=list)
    hazy: bool = True


_LAND = "NOT water"
# Reflectances, weights of textures and bounds of elevation for each kind of ground.
PALETTES = {
    "desert": Palette(
        {"fine": (6, 8, 80), "medium": (4, 32, 81), "ripple": (4, 16, 82), "depth": (4, 32, 60)},
        [
            ("water", "0.07 + 0.024 * depth", "0.46 + 0.048 * depth", "0.80 + 0.072 * depth"),
            (f"n <= 0.65 AND {_LAND}", "0.84 + 0.10 * fine + 0.08 * ripple", "0.77 + 0.08 * fine + 0.064 * ripple", "0.60 + 0.06 * fine + 0.04 * ripple"),
            (f"n > 0.65 AND {_LAND}", "0.57 + 0.12 * medium", "0.52 + 0.108 * medium", "0.48 + 0.096 * medium"),
            (f"moisture > 0.40 AND {_LAND}", "0.54 + 0.15 * fine", "0.63 + 0.18 * fine", "0.44 + 0.12 * fine"),
            ("n >= 0.10 AND n < 0.14", "0.88 + 0.08 * fine", "0.81 + 0.06 * fine", "0.64 + 0.05 * fine"),
            (f"dune > 0.76 AND n <= 0.65 AND {_LAND}", "0.90 + 0.06 * fine", "0.84 + 0.06 * fine", "0.66 + 0.06 * fine"),
        ],
    ),
    "coast": Palette(
        {"fine": (6, 8, 90), "medium": (4, 32, 91), "wave": (6, 24, 92)},
        [
            (_LAND, "0.16 + 0.28 * green + 0.12 * fine + 0.096 * medium", "0.30 + 0.55 * green + 0.15 * fine + 0.12 * medium", "0.18 + 0.25 * green + 0.105 * fine + 0.084 * medium"),
            ("water", "0.08 + 0.036 * wave", "0.50 + 0.06 * wave", "0.85 + 0.084 * wave"),
            ("n >= 0.08 AND n < 0.18", "0.88 + 0.10 * fine", "0.82 + 0.08 * fine", "0.65 + 0.06 * fine"),
            ("n > 0.70 AND n <= 0.85", "0.58 + 0.10 * medium", "0.56 + 0.10 * medium", "0.54 + 0.10 * medium"),
            ("n > 0.85", "0.94 + 0.04 * fine", "0.95 + 0.04 * fine", "0.97 + 0.04 * fine"),
        ],
    ),
    "island": Palette(
        {"fine": (6, 8, 100), "medium": (4, 32, 101), "wave": (6, 20, 102)},
        [
            (_LAND, "0.12 + 0.32 * green + 0.108 * fine + 0.09 * medium", "0.28 + 0.60 * green + 0.18 * fine + 0.15 * medium", "0.10 + 0.22 * green + 0.09 * fine + 0.075 * medium"),
            ("water", "0.10 + 0.042 * wave", "0.48 + 0.07 * wave", "0.82 + 0.098 * wave"),
            ("n >= 0.10 AND n < 0.16", "0.90 + 0.08 * fine", "0.85 + 0.064 * fine", "0.70 + 0.048 * fine"),
            ("n > 0.72 AND n <= 0.88", "0.60 + 0.10 * medium", "0.58 + 0.10 * medium", "0.56 + 0.10 * medium"),
            ("n > 0.88", "0.94 + 0.04 * fine", "0.95 + 0.04 * fine", "0.97 + 0.04 * fine"),
        ],
    ),
    "mountain": Palette(
        {"ridge": (8, 18, 70), "grass": (5, 60, 100), "wood": (6, 45, 101), "coarse": (6, 32, 71), "medium": (8, 12, 72), "fine": (10, 4, 73)},
        [
            ("true", *[f"(CASE WHEN forest THEN {a} + {b} * tex ELSE {c} + {d} * tex END) + {g} * grazed + (CASE WHEN n > 0.35 AND n < 0.65 THEN {p} ELSE 0.0 END) + streak + (CASE WHEN road THEN {t} ELSE 0.0 END)" for a, b, c, d, g, p, t in ((0.12, 0.03, 0.28, 0.08, 0.12, -0.04, 0.08), (0.18, 0.04, 0.26, 0.08, 0.10, 0.06, 0.06), (0.10, 0.02, 0.19, 0.05, 0.06, 0.0, 0.04))]),
            ("water", "0.10", "0.20", "0.32"),
        ],
    ),
    "water": Palette(
        {"depth": (4, 128, 0)},
        [("true", "LEAST(GREATEST(0.08 + 0.15 * depth - 0.5 * wave, 0.05), 0.15)", "LEAST(GREATEST(0.42 + 0.12 * depth - 0.3 * wave, 0.35), 0.55)", "LEAST(GREATEST(0.75 + 0.075 * depth + 0.2 * wave, 0.65), 0.88)")],
        hazy=False,
    ),
}
#: Weights of moisture and of low ground, and the bounds of low ground, in the greenness of coasts and islands.
GREEN = {"coast": (0.70, 0.30, 0.30, 0.60), "island": (0.75, 0.25, 0.35, 0.55)}
#: What haze over high ground adds to each band.
HAZE = (0.12, 0.15, 0.25)


def case_of(palette: Palette, band: int) -> str:
    """The colour of a band as one SQL expression, topmost layer first."""
    return "CASE " + " ".join(f"WHEN {layer[0]} THEN {layer[1 + band]}" for layer in reversed(palette.layers)) + " ELSE 0.0 END"


def green_of(biome: str) -> str:
    """Greenness as SQL."""
    a, b, low, span = GREEN[biome]
    return f"LEAST(GREATEST({a} * moisture + {b} * (1.0 - LEAST(GREATEST((n - {low}) / {span}, 0.0), 1.0)), 0.0), 1.0)"


def _surveyed(cells: DataFrame, river: str, value: str) -> DataFrame:
    """cells with _wet (rivers blurred six times) and the gradient and Laplacian of value: one shuffle for all of them."""
    return st.blurs(cells.withColumn("_wet", F.col(river)), {"_wet": 6}, [c for c in cells.columns if c not in ("y", "x")], value)


def _moist(surveyed: DataFrame) -> DataFrame:
    """Moisture from what _surveyed() tells, which is read twice."""
    windy = st.stretch(surveyed, F.greatest(-F.col("gx"), F.lit(0.0)), "_wind")
    return windy.withColumn("moisture", clip01(0.6 * F.col("_wet") + 0.4 * F.col("_wind"))).drop("_wet", "_wind")


def moisture(cells: DataFrame, river: str = "river", value: str = "n") -> DataFrame:
    """cells with moisture: rivers blurred six times, and the stretched windward slope."""
    return _moist(staged(_surveyed(cells, river, value))).drop("gx", "gy", "lap")


def _mountain(cells: DataFrame) -> DataFrame:
    """Extra columns of mountains: streaks along slopes, grazed patches, woods and tracks in sharp valleys."""
    (sharp,) = quantiles(cells, "lap", [0.85])
    angle = F.atan2("gy", "gx")
    along = F.col("x") * F.cos(angle) + F.col("y") * F.sin(angle)
    wide = cells.select(
        "y", "x", "n", "water",
        ((F.col("grass") > 0.2) & (F.col("n") > 0.4) & (F.col("n") < 0.7)).alias("grazed"),
        (F.sin(along / 8.0 + F.col("ridge") * 4.0) * 0.04).alias("streak"),
        (0.4 * F.col("coarse") + 0.35 * F.col("medium") + 0.25 * F.col("fine")).alias("tex"),
        ((F.col("wood") > 0.1) & (F.col("moisture") > 0.4)).alias("forest"),
        ((F.col("lap") > sharp) & (F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) < 0.15)).alias("road"),
    )
    return st.blurs(wide, {"grazed": 2}, ["n", "water", "streak", "tex", "forest", "road"])


def build_rgb(cells: DataFrame, biome: str, seed: int = 42) -> DataFrame:
    """(y, x, r, g, b) of cells (y, x, n, river, water): moisture, the biome's palette, then haze over high ground. A city has
    roofs, parks and roads instead; forest and farm have parcels, and no haze."""
    if biome in ("forest", "farm"):
        return rural_rgb(cells, seed)
    high = F.least(F.greatest((F.col("n") - 0.70) * 0.4, F.lit(0.0)), F.lit(0.06))
    if biome == "city":
        return city_rgb(cells.select("y", "x", "n", "water"), seed).select("y", "x", *[clip01(F.col(c) + high * h).alias(c) for c, h in zip("rgb", HAZE)])
    palette = PALETTES[biome]
    # written once: ranges over the grid and blurs read it again
    full = staged(textured(cells if biome == "water" else _surveyed(cells, "river", "n"), palette.textures, seed))
    if biome != "water":
        full = _moist(full)
    if biome == "desert":
        full = st.stretch(full, noise.dune(F.col("x"), F.col("y"), 22, 25.0, seed), "dune")
    elif biome == "mountain":
        full = _mountain(full)
    elif biome == "water":
        full = full.withColumn("wave", 0.03 * (F.sin(F.col("x") / 20.0 + float(seed)) * 0.5 + 0.5))
    else:
        full = full.withColumn("green", F.expr(green_of(biome)))
    bands = [clip01(F.expr(case_of(palette, i)).cast("double")) for i in range(3)]
    return full.select("y", "x", *[(clip01(v + high * h) if palette.hazy else v).alias(c) for c, v, h in zip("rgb", bands, HAZE)])
