"""Deterministic lattice noise as column expressions: the same value for a world place in any tile."""

from __future__ import annotations

from pyspark.sql import functions as F

_A, _B, _C = 73856093, 19349663, 83492791
_M1, _M2 = 0x85EBCA6B, 0xC2B2AE35


def _long(v):
    return v.cast("bigint") if hasattr(v, "cast") else F.lit(int(v)).cast("bigint")


def hash_lattice(x, y, seed):
    """Hash of a lattice point to 0..1; products are split so that nothing leaves 64 bits."""
    and_ = lambda a, m: a.bitwiseAND(F.lit(m).cast("bigint"))
    h = (_long(x) * _A).bitwiseXOR(_long(y) * _B).bitwiseXOR(_long(seed) * F.lit(_C).cast("bigint"))
    h = and_(h.bitwiseXOR(F.shiftright(h, 16)), (1 << 53) - 1)
    lo, hi = and_(h, (1 << 26) - 1), F.shiftright(h, 26)
    h = and_(lo * F.lit(_M1).cast("bigint") + and_(hi * F.lit(_M1).cast("bigint"), (1 << 27) - 1) * (1 << 26), (1 << 53) - 1)
    h = and_(h.bitwiseXOR(F.shiftright(h, 13)), (1 << 40) - 1)
    lo, hi = and_(h, (1 << 20) - 1), F.shiftright(h, 20)
    h = and_(lo * F.lit(_M2).cast("bigint") + and_(hi * F.lit(_M2).cast("bigint"), (1 << 20) - 1) * (1 << 20), (1 << 40) - 1)
    h = and_(h.bitwiseXOR(F.shiftright(h, 16)), 0xFFFFFF)
    return h / float(0xFFFFFF)


def value_noise(x, y, grid, seed):
    """Smooth bilinear noise over a lattice of `grid` units; grid and seed may be columns."""
    grid = grid.cast("double") if hasattr(grid, "cast") else float(grid)
    gx, gy = x / grid, y / grid
    x0, y0 = F.floor(gx), F.floor(gy)
    ease = lambda t: t * t * (3.0 - 2.0 * t)
    sx, sy = ease(gx - x0), ease(gy - y0)
    n = lambda dx, dy: hash_lattice(x0 + dx, y0 + dy, seed)
    top, bottom = n(0, 0) * (1.0 - sx) + n(1, 0) * sx, n(0, 1) * (1.0 - sx) + n(1, 1) * sx
    return top * (1.0 - sy) + bottom * sy


def fbm(x, y, octaves: int, base: int, gain: float = 0.5, lacunarity: float = 2.0, seed: int = 0):
    """Octaves of value noise, weighted and normalised to 0..1."""
    total, weight, amp, freq = F.lit(0.0), 0.0, 1.0, 1.0
    for i in range(octaves):
        total = total + amp * value_noise(x, y, max(2, int(base / freq)), seed + 1000 * i)
        weight, amp, freq = weight + amp, amp * gain, freq * lacunarity
    return total / weight


def fbm_signed(x, y, octaves: int, base: int, gain: float = 0.5, lacunarity: float = 2.0, seed: int = 0):
    """fbm in -1..1."""
    return 2.0 * fbm(x, y, octaves, base, gain, lacunarity, seed) - 1.0


def offset_seed(seed: int, origin_x: float, origin_y: float) -> int:
    """The seed of a tile's noise, from its origin."""
    return seed + int(origin_x * 1000 + origin_y)


def ridge(x, y, octaves: int, base: int, seed: int = 0):
    """Ridged noise before its range is stretched."""
    fold = lambda n: 1.0 - F.abs(2.0 * n - 1.0)
    return 0.6 * fold(fbm(x, y, octaves, base, seed=seed)) + 0.4 * fold(fbm(x, y, 4, max(8, base // 2), seed=seed + 99))


def dune(x, y, scale: int, degrees: float, seed: int):
    """Cosine ridges with a noisy phase, 0..1."""
    import math

    th = math.radians(degrees)
    return (F.cos((x * math.cos(th) + y * math.sin(th)) / (scale * 0.6) + value_noise(x, y, max(2, scale), seed) * 3.14159) + 1.0) * 0.5


def field_attributes(field_id):
    """Two fractions of three digits from a parcel's id."""
    h = F.pmod(field_id.cast("bigint") * F.lit(2654435761).cast("bigint"), F.lit(1 << 31).cast("bigint"))
    return (h % 1000) / 1000.0, (F.floor(h / 1000) % 1000) / 1000.0


def hash_sql(x: str, y: str, seed: int | str) -> str:
    """hash_lattice as DuckDB text."""
    h0 = f"xor(xor(CAST({x} AS BIGINT)*{_A}, CAST({y} AS BIGINT)*{_B}), CAST({seed} AS BIGINT)*{_C})"
    h1 = f"(xor({h0}, ({h0}) >> 16) & {(1 << 53) - 1})"
    h2 = f"((({h1} & {(1 << 26) - 1}) * {_M1} + ((({h1} >> 26) * {_M1}) & {(1 << 27) - 1}) * {1 << 26}) & {(1 << 53) - 1})"
    h3 = f"(xor({h2}, {h2} >> 13) & {(1 << 40) - 1})"
    h4 = f"((({h3} & {(1 << 20) - 1}) * {_M2} + ((({h3} >> 20) * {_M2}) & {(1 << 20) - 1}) * {1 << 20}) & {(1 << 40) - 1})"
    return f"((xor({h4}, {h4} >> 16) & 16777215) / 16777215e0)"
