"""Sensor simulation on tiles: NumPy kernels behind applyInPandas, with halos so that tiles meet without seams."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartosea.functions import colour, noise
from cartosea.operators import lattice
from cartosea.operators import stencil as st


@dataclass(frozen=True)
class Sensor:
    """Settings of the chain, by its order."""

    supersample: int = 2
    octaves: int = 6
    gain: float = 0.5
    lacunarity: float = 2.0
    texture_base: float = 64.0
    sun_azimuth: float = 315.0
    sun_altitude: float = 45.0
    relief_strength: float = 0.4
    edge_step: float = 0.05
    edge_sigma: float = 2.0
    optics_sigma: float = 1.0
    warp: float = 0.6
    warp_base: int = 96
    noise_sigma: float = 0.005
    gamma: float = 1.05
    saturation: float = 0.90
    green_bias: float = 1.05
    smooth_size: int = 5
    smooth_colour: float = 24.0
    smooth_space: float = 5.0
    smooth_mix: float = 0.05
    sharpen: float = 0.15
    seed: int = 42
    tile: int = 512
    halo: int = 32


@dataclass(frozen=True)
class Frame:
    """Where an array of cells lies: its rows and columns in the world, and the extent (rows, columns) of the world."""

    y: np.ndarray
    x: np.ndarray
    height: int
    width: int

    def enlarged(self, k: int) -> "Frame":
        """The frame with k x k cells for each."""
        fine = lambda v: (v[:, None] * k + np.arange(k)[None, :]).ravel()
        return Frame(fine(self.y), fine(self.x), self.height * k, self.width * k)


def gaussian(a: np.ndarray, sigma_x: float, sigma_y: float, radius: int | None = None, border: str = "symmetric") -> np.ndarray:
    """Separable Gaussian blur of an image, four deviations wide unless a radius is given, mirrored at its border."""
    for axis, s in ((0, sigma_y), (1, sigma_x)):
        n = radius or max(1, (int(8 * s + 1 + 0.5) | 1) // 2)
        w = np.exp(-0.5 * (np.arange(-n, n + 1) / max(s, 1e-6)) ** 2)
        w /= w.sum()
        p = _padded(a, n if axis == 0 else 0, n if axis == 1 else 0, border)
        a = sum(w[k] * np.take(p, np.arange(k, k + a.shape[axis]), axis) for k in range(2 * n + 1))
    return a


def _padded(a: np.ndarray, ny: int, nx: int, border: str) -> np.ndarray:
    """a with a mirrored border; an image of one row or column can only repeat it."""
    for axis, n in ((0, ny), (1, nx)):
        mode = border if a.shape[axis] > 1 else "edge"
        a = np.pad(a, [(n, n) if i == axis else (0, 0) for i in range(a.ndim)], mode=mode) if n else a
    return a


def bilateral(a: np.ndarray, size: int, sigma_colour: float, sigma_space: float) -> np.ndarray:
    """Mean of near pixels of near colours, in bytes: colours differ by the sum over bands, places by a disc."""
    n = size // 2
    u = np.floor(np.clip(a, 0, 1) * 255)
    p = _padded(u, n, n, "reflect")
    total, weight = np.zeros_like(u), np.zeros(u.shape[:2] + (1,))
    for dy in range(-n, n + 1):
        for dx in range(-n, n + 1):
            if dy * dy + dx * dx <= n * n:
                q = p[n + dy : n + dy + u.shape[0], n + dx : n + dx + u.shape[1]]
                w = np.exp(-(np.abs(q - u).sum(2, keepdims=True) ** 2) / (2 * sigma_colour**2)) * np.exp(-(dy * dy + dx * dx) / (2 * sigma_space**2))
                total, weight = total + w * q, weight + w
    return np.rint(total / weight) / 255


def textured(a: np.ndarray, at: Frame, s: Sensor, water: np.ndarray | None = None) -> np.ndarray:
    """Brightness by fine noise, and on land each band by noise of its own scale."""
    fine = lattice.fbm(at.y, at.x, s.octaves, s.texture_base, s.seed, s.gain, s.lacunarity)
    medium = lattice.fbm(at.y, at.x, max(1, s.octaves - 2), s.texture_base * 1.5, s.seed + 1, s.gain, s.lacunarity)
    coarse = lattice.fbm(at.y, at.x, max(1, s.octaves - 4), s.texture_base * 2.5, s.seed + 2, s.gain, s.lacunarity)
    land = 1.0 - water if water is not None else 1.0
    hue = [1.0 + (low + (1.0 - low) * n - 1.0) * land for low, n in ((0.90, medium), (0.88, fine), (0.92, coarse))]
    return np.clip(a * (0.85 + 0.15 * fine)[..., None] * np.stack(hue, 2), 0, 1)


def rippled(a: np.ndarray, at: Frame, s: Sensor, water: np.ndarray) -> np.ndarray:
    """Water with ripples longer one way than the other, and glints toward the sun."""
    ripples = 0.7 * lattice.fbm(at.y, at.x, 4, 32.0, s.seed + 100, 0.6, 2.5) + 0.3 * lattice.fbm(at.y, at.x, 4, 48.0, s.seed + 101, 0.6, 2.5)
    az = np.deg2rad(s.sun_azimuth)
    toward = ((at.x[None, :] * np.cos(az) + at.y[:, None] * np.sin(az)) / np.hypot(at.width, at.height) + 1.0) / 2.0
    glint = (lattice.fbm(at.y, at.x, 3, 64.0, s.seed + 102, 0.4, 3.0) * toward) ** 4
    w = water[..., None]
    a = a * (1 - w) + a * (0.94 + 0.06 * ripples)[..., None] * w
    return np.clip(a + glint[..., None] * np.array([0.2, 0.3, 0.5]) * w * 0.08, 0, 1)


def hillshade(dem: np.ndarray, azimuth: float, altitude: float) -> np.ndarray:
    """Illumination of a surface by the sun, 0..1."""
    gy, gx = (np.gradient(dem, axis=i) if dem.shape[i] > 1 else np.zeros_like(dem) for i in (0, 1))
    az, alt = np.deg2rad(azimuth), np.deg2rad(altitude)
    slope = np.arctan(np.hypot(gx, gy))
    return np.clip(np.sin(alt) * np.cos(slope) + np.cos(alt) * np.sin(slope) * np.cos(az - np.arctan2(-gx, gy)), 0, 1)


def shaded(a: np.ndarray, dem: np.ndarray, s: Sensor) -> np.ndarray:
    """Bands lit by the relief."""
    light = 1.0 - s.relief_strength + s.relief_strength * hillshade(dem, s.sun_azimuth, s.sun_altitude)
    return np.clip(a * light[..., None], 0, 1)


#: Rows of a 5 x 5 ellipse: how far each reaches to either side.
ELLIPSE = (0, 2, 2, 2, 0)


def edges(a: np.ndarray, step: float) -> np.ndarray:
    """Whether any band's Sobel gradient exceeds step within an ellipse of 5 x 5 around a cell."""
    p = _padded(a, 1, 1, "reflect")
    c = lambda dy, dx: p[1 + dy : 1 + dy + a.shape[0], 1 + dx : 1 + dx + a.shape[1]]
    gx = c(-1, 1) + 2 * c(0, 1) + c(1, 1) - c(-1, -1) - 2 * c(0, -1) - c(1, -1)
    gy = c(1, -1) + 2 * c(1, 0) + c(1, 1) - c(-1, -1) - 2 * c(-1, 0) - c(-1, 1)
    hard = np.pad(np.hypot(gx, gy).max(2) > step, 2)
    out = np.zeros(a.shape[:2], bool)
    for dy, reach in zip(range(-2, 3), ELLIPSE):
        for dx in range(-reach, reach + 1):
            out |= hard[2 + dy : 2 + dy + a.shape[0], 2 + dx : 2 + dx + a.shape[1]]
    return out


def edge_mask(a: np.ndarray, s: Sensor) -> np.ndarray:
    """Edges with a soft border, 0..1."""
    return gaussian(edges(a, s.edge_step).astype(float), s.edge_sigma, s.edge_sigma, 3, "reflect")


def softened(a: np.ndarray, s: Sensor) -> np.ndarray:
    """Colours smoothed where the edge mask is."""
    m = edge_mask(a, s)[..., None]
    return np.clip(a * (1 - m) + bilateral(a, 7, 30.0, 7.0) * m, 0, 1)


def hazed(a: np.ndarray, at: Frame, s: Sensor) -> np.ndarray:
    """Haze of slowly changing strength toward its colour, then lifted blacks."""
    much = (0.03 + 0.02 * lattice.fbm(at.y, at.x, 3, 256.0, s.seed + 5000, 0.6, 2.0))[..., None]
    return np.clip((a * (1 - much) + np.array([0.75, 0.80, 0.85]) * much) * 0.97 + 0.03, 0, 1)


def half_shifted(a: np.ndarray) -> np.ndarray:
    """Means with the cells before, half a pixel on."""
    p = np.concatenate([a[:1], a])
    p = np.concatenate([p[:, :1], p], 1)
    return (p[:-1, :-1] + p[:-1, 1:] + p[1:, :-1] + p[1:, 1:]) / 4


def warped(a: np.ndarray, at: Frame, s: Sensor) -> np.ndarray:
    """Cells gathered from fractional places that noise displaces, by the four around each; mirrored at the world's border."""
    moves = [(2.0 * lattice.fbm(at.y, at.x, 4, s.warp_base, s.seed + step) - 1.0) * s.warp for step in (222, 111)]
    py, px = at.y[:, None] + moves[0], at.x[None, :] + moves[1]
    iy, ix = np.floor(py), np.floor(px)
    ty, tx = (py - iy)[..., None], (px - ix)[..., None]

    def index(v, first, size, count):
        v = np.where(v < 0, -v - 1, np.where(v >= size, 2 * size - 1 - v, v)) - first
        return np.clip(v, 0, count - 1).astype(int)  # only places beyond the halo are held back

    c = lambda dy, dx: a[index(iy + dy, at.y[0], at.height, len(at.y)), index(ix + dx, at.x[0], at.width, len(at.x))]
    return (c(0, 0) * (1 - tx) + c(0, 1) * tx) * (1 - ty) + (c(1, 0) * (1 - tx) + c(1, 1) * tx) * ty


def unsharp(a: np.ndarray, amount: float, sigma: float = 0.8) -> np.ndarray:
    """a with its fine detail raised."""
    return np.clip(a + amount * (a - gaussian(a, sigma, sigma)), 0, 1)


def enlarge(a: np.ndarray, k: int) -> np.ndarray:
    """k times as large, by cubic interpolation."""
    for axis in (0, 1):
        n = a.shape[axis]
        at = (np.arange(n * k) + 0.5) / k - 0.5
        base = np.floor(at).astype(int)
        t = (at - base).reshape([-1 if i == axis else 1 for i in range(a.ndim)])
        c = lambda d: np.take(a, np.clip(base + d, 0, n - 1), axis)
        w = [((-0.75 * (t + 1) + 3.75) * (t + 1) - 6) * (t + 1) + 3, (1.25 * t - 2.25) * t * t + 1, (1.25 * (1 - t) - 2.25) * (1 - t) ** 2 + 1]
        a = w[0] * c(-1) + w[1] * c(0) + w[2] * c(1) + (1 - w[0] - w[1] - w[2]) * c(2)
    return a


def shrink(a: np.ndarray, k: int) -> np.ndarray:
    """Means of k x k blocks."""
    h, w = a.shape[0] // k, a.shape[1] // k
    return a[: h * k, : w * k].reshape(h, k, w, k, -1).mean((1, 3))


def place_noise(y: np.ndarray, x: np.ndarray, bands: int, seed: int) -> np.ndarray:
    """Standard normal noise of places in the world: the same for a place in whichever tile it is seen."""

    def mixed(v):
        v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return v ^ (v >> np.uint64(31))

    with np.errstate(over="ignore"):
        base = mixed((y.astype(np.uint64)[:, None] << np.uint64(32)) + x.astype(np.uint64)[None, :] + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        unit = [(mixed(base + np.uint64(i + 1)) >> np.uint64(11)).astype(float) / (1 << 53) for i in range(2 * bands)]
    return np.stack([np.sqrt(-2 * np.log(unit[2 * i] + 1e-300)) * np.cos(2 * np.pi * unit[2 * i + 1]) for i in range(bands)], 2)


def toned(a: np.ndarray, s: Sensor) -> np.ndarray:
    """Tone curve, desaturation, bias to green and yellow."""
    a = np.clip(a, 0, 1) ** s.gamma
    a = a * s.saturation + a.mean(2, keepdims=True) * (1 - s.saturation)
    return np.clip(a * np.array([s.green_bias - 0.05, s.green_bias, 1.0]), 0, 1)


def sense(tile: np.ndarray, s: Sensor, at: Frame, dem: np.ndarray | None = None, water: np.ndarray | None = None) -> np.ndarray:
    """An array of cells through the chain: enlarge, texture, relief, edges, optics, haze, half-pixel shift, warp, shrink,
    noise, tone, smoothing, sharpening."""
    k = s.supersample
    fine = at.enlarged(k)
    a = enlarge(tile, k) if k > 1 else tile
    wet = np.repeat(np.repeat(water, k, 0), k, 1) if water is not None else None
    a = textured(a, fine, s, wet)
    a = rippled(a, fine, s, wet) if wet is not None else a
    a = shaded(a, enlarge(dem, k) if k > 1 else dem, s) if dem is not None else a
    a = softened(a, s)
    a = gaussian(a, s.optics_sigma, 0.7 * s.optics_sigma)
    a = hazed(a, fine, s)
    a = half_shifted(a)
    a = warped(a, fine, s) if k > 1 and s.warp > 0 else a
    a = shrink(a, k) if k > 1 else a
    a = np.clip(a + s.noise_sigma * place_noise(at.y, at.x, a.shape[2], s.seed), 0, 1)
    a = toned(a, s)
    a = np.clip(a * (1 - s.smooth_mix) + bilateral(a, s.smooth_size, s.smooth_colour, s.smooth_space) * s.smooth_mix, 0, 1) if s.smooth_mix > 0 else a
    return unsharp(a, s.sharpen) if s.sharpen > 0 else a


def on_tiles(cells: DataFrame, kernel, out: list[str], halo: int, size: int = 256) -> DataFrame:
    """(y, x, out...): kernel(columns, frame) over square tiles of cells (y, x, doubles...), each with a halo of its
    neighbours' cells, of which it keeps only its own. columns has an array for each column of cells; cells that are
    missing are 0. A task holds one tile, and none grows with the grid."""
    names = [c for c in cells.columns if c not in ("y", "x")]
    ends = cells.agg(F.max("y").alias("_my"), F.max("x").alias("_mx"))
    at = lambda v: F.floor(v / size).cast("int")
    spread = lambda c, last: F.explode(F.sequence(F.greatest(at(F.col(c) - halo), F.lit(0)), F.least(at(F.col(c) + halo), at(F.col(last)))))
    tiled = cells.crossJoin(F.broadcast(ends)).withColumn("_ty", spread("y", "_my")).withColumn("_tx", spread("x", "_mx"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[(pdf.y // size == pdf._ty) & (pdf.x // size == pdf._tx)]
        if not len(own):
            return pd.DataFrame({c: [] for c in ("y", "x", *out)})
        y, x = np.arange(pdf.y.min(), pdf.y.max() + 1), np.arange(pdf.x.min(), pdf.x.max() + 1)
        arrays = {}
        for c in names:
            arrays[c] = np.zeros((len(y), len(x)))
            arrays[c][pdf.y - y[0], pdf.x - x[0]] = pdf[c]
        got = kernel(arrays, Frame(y, x, int(pdf._my.iloc[0]) + 1, int(pdf._mx.iloc[0]) + 1))
        return pd.DataFrame({"y": own.y, "x": own.x} | {c: g[own.y - y[0], own.x - x[0]] for c, g in zip(out, got)})

    return tiled.groupBy("_ty", "_tx").applyInPandas(run, "y int, x int, " + ", ".join(f"{c} double" for c in out))


def bands(kernel):
    """A kernel for on_tiles from one that takes the bands as one array, and the other columns by name."""

    def run(arrays, frame):
        a = kernel(np.stack([arrays[c] for c in "rgb"], 2), frame, {c: v for c, v in arrays.items() if c not in "rgb"})
        return [a[..., i] for i in range(3)]

    return run


def sense_tiles(cells: DataFrame, sensor: Sensor = Sensor()) -> DataFrame:
    """(y, x, r, g, b) through the sensor; cells may have z (elevation) and water (0..1) beside the bands."""
    kernel = bands(lambda a, at, more: sense(a, sensor, at, more.get("z"), more.get("water")))
    return on_tiles(cells, kernel, list("rgb"), sensor.halo, sensor.tile)


def degrade(cells: DataFrame, fine: float, coarse: float, tile: int = 256) -> DataFrame:
    """(y, x, r, g, b) as a sensor of a coarser ground resolution sees them: a Gaussian of 0.45 pixels (10 at most), area
    means on a grid whose ratio needn't be whole, and less saturation from 10 m on. A finer resolution changes nothing."""
    scale = coarse / fine
    if scale <= 1.0:
        return cells.select("y", "x", *"rgb")
    size = st.extent(cells).first()
    if size["h"] is None:
        return cells.select("y", "x", *"rgb")
    sigma = min(10.0, 0.45 * scale)
    halo = (int(8 * sigma + 1.5) | 1) // 2
    soft = on_tiles(cells.select("y", "x", *"rgb"), bands(lambda a, at, more: gaussian(a, sigma, sigma)), list("rgb"), halo, max(tile, 4 * halo))
    out = st.area_resize(soft, list("rgb"), *(max(1, round(size[n] / scale)) for n in "hw")).withColumnsRenamed({"ty": "y", "tx": "x"})
    if coarse < 10.0:
        return out
    grey = (F.col("r") + F.col("g") + F.col("b")) / 3.0
    tone = lambda c: F.least(F.pow(F.greatest(F.col(c) * 0.88 + grey * 0.12, F.lit(0.0)), F.lit(1.04)), F.lit(1.0))
    return out.select("y", "x", *[tone(c).alias(c) for c in "rgb"])


#: Heat of a hull's middle and of the sea, noise of the heat and of a frame, blur, greatest turn in degrees and shift in pixels.
HOT, COOL, HEAT_NOISE, FRAME_NOISE, SPREAD, TURN, SHIFT = 0.9, 0.2, 0.05, 0.03, 1.5, 0.5, 2.0


def normal(a, b, seed: int):
    """Standard normal noise of a lattice point."""
    one, two = noise.hash_lattice(a, b, seed), noise.hash_lattice(a, b, seed + 1)
    return F.sqrt(-2.0 * F.log(F.greatest(one, F.lit(1e-7)))) * F.cos(two * (2.0 * math.pi))


def thermal_base(spark: SparkSession, size: int = 64, kind: str = "generic", seed: int = 42) -> DataFrame:
    """(y, x, t): heat of a silhouette of size x size: warmer toward its middle, noisy and slightly spread."""
    cells = spark.range(size * size).select(F.floor(F.col("id") / size).cast("int").alias("y"), (F.col("id") % size).cast("int").alias("x"))
    mid = size // 2
    far = F.sqrt(F.pow(F.col("y") - mid, 2) + F.pow(F.col("x") - mid, 2)) / (math.hypot(mid, mid) + 1e-6)
    body = F.when(colour.vessel_mask(F.col("y"), F.col("x"), size, size, kind), HOT * (1.0 - 0.5 * far)).otherwise(COOL)
    rough = colour.clip01(body + HEAT_NOISE * normal(F.col("x"), F.col("y"), seed))
    return on_tiles(cells.select("y", "x", rough.alias("t")), lambda a, at: [gaussian(a["t"][..., None], SPREAD, SPREAD)[..., 0]], ["t"], 7, 64)


def thermal_frames(frames: DataFrame, base: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """(frame, y, x, r, g, b) for each number in frames: the base turned a little, moved by whole pixels and refilled with the
    sea's heat, noisy, in thermal colours. Every pixel gathers the four places around its own in the base, which is one
    image (size x size) and goes to all tasks; frames are as many as the table has."""
    f = F.col("frame")
    drift = lambda n, most: (2.0 * noise.hash_lattice(f, F.lit(n), seed) - 1.0) * most
    moves = frames.select("frame", F.radians(drift(1, TURN)).alias("turn"), F.bround(drift(2, SHIFT)).cast("int").alias("tx"), F.bround(drift(3, SHIFT)).cast("int").alias("ty"))
    pixels = moves.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    y, x, mid = F.col("y") - F.col("ty"), F.col("x") - F.col("tx"), (size - 1) / 2.0
    inside = (y >= 0) & (y < size) & (x >= 0) & (x < size)
    sx = (x - mid) * F.cos("turn") - (y - mid) * F.sin("turn") + mid
    sy = (x - mid) * F.sin("turn") + (y - mid) * F.cos("turn") + mid
    asked = pixels.select("frame", "y", "x", inside.alias("inside"), sx.alias("sx"), sy.alias("sy"))
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    weight = lambda c, side: F.when(F.col(f"c.{side}") == 1, F.col(c) - F.floor(c)).otherwise(1.0 - (F.col(c) - F.floor(c)))
    four = asked.withColumn("c", corner).select("frame", "y", "x", "inside", (F.floor("sy").cast("int") + F.col("c.a")).alias("by"), (F.floor("sx").cast("int") + F.col("c.b")).alias("bx"), (weight("sy", "a") * weight("sx", "b")).alias("w"))
    got = four.join(F.broadcast(base.select(F.col("y").alias("by"), F.col("x").alias("bx"), "t")), ["by", "bx"], "left")
    heat = got.groupBy("frame", "y", "x").agg(F.first("inside").alias("inside"), F.sum(F.col("w") * F.coalesce("t", F.lit(COOL))).alias("t"))
    seen = colour.clip01(F.when(F.col("inside"), F.col("t")).otherwise(COOL) + FRAME_NOISE * normal(f * (size * size) + F.col("y") * size + F.col("x"), F.lit(7), seed))
    r, g, b = colour.thermal(F.col("seen"))
    return heat.withColumn("seen", seen).select("frame", "y", "x", r.alias("r"), g.alias("g"), b.alias("b"))
