"""Lattice noise over arrays of world places: the values of cartosea.functions.noise, for kernels inside tasks."""

from __future__ import annotations

import numpy as np

from cartosea.functions.noise import _A, _B, _C, _M1, _M2


def hashed(x: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    """Hash of lattice points to 0..1; products are split so that nothing leaves 64 bits."""
    h = (x * _A) ^ (y * _B) ^ (seed * _C)
    h = (h ^ (h >> 16)) & ((1 << 53) - 1)
    h = ((h & ((1 << 26) - 1)) * _M1 + ((((h >> 26) * _M1) & ((1 << 27) - 1)) << 26)) & ((1 << 53) - 1)
    h = (h ^ (h >> 13)) & ((1 << 40) - 1)
    h = ((h & ((1 << 20) - 1)) * _M2 + ((((h >> 20) * _M2) & ((1 << 20) - 1)) << 20)) & ((1 << 40) - 1)
    return ((h ^ (h >> 16)) & 0xFFFFFF) / float(0xFFFFFF)


def value_noise(y: np.ndarray, x: np.ndarray, grid: int, seed: int) -> np.ndarray:
    """Smooth bilinear noise over the rows y and columns x; only the lattice points that they need are hashed."""
    gy, gx = y / float(grid), x / float(grid)
    iy, ix = np.floor(gy).astype(np.int64), np.floor(gx).astype(np.int64)
    ease = lambda t: t * t * (3.0 - 2.0 * t)
    sy, sx = ease(gy - iy)[:, None], ease(gx - ix)[None, :]
    y0, x0 = iy.min(), ix.min()
    points = hashed(np.arange(x0, ix.max() + 2)[None, :], np.arange(y0, iy.max() + 2)[:, None], seed)
    at = lambda dx, dy: points[np.ix_(iy - y0 + dy, ix - x0 + dx)]
    top, bottom = at(0, 0) * (1.0 - sx) + at(1, 0) * sx, at(0, 1) * (1.0 - sx) + at(1, 1) * sx
    return top * (1.0 - sy) + bottom * sy


def points_noise(y: np.ndarray, x: np.ndarray, grid: int, seed: int) -> np.ndarray:
    """value_noise of places (y, x) one by one; where they lie close to each other, each lattice point is hashed once."""
    gy, gx = y / float(grid), x / float(grid)
    iy, ix = np.floor(gy).astype(np.int64), np.floor(gx).astype(np.int64)
    ease = lambda t: t * t * (3.0 - 2.0 * t)
    sy, sx = ease(gy - iy), ease(gx - ix)
    y0, x0, y1, x1 = (int(v) for v in (iy.min(), ix.min(), iy.max(), ix.max())) if len(iy) else (0, 0, 0, 0)
    wide = x1 - x0 + 2
    if wide * (y1 - y0 + 2) <= 2 * len(iy):
        points = hashed(np.arange(x0, x1 + 2)[None, :], np.arange(y0, y1 + 2)[:, None], seed).ravel()
        at = (iy - y0) * wide + (ix - x0)
        n = lambda dx, dy: points.take(at + (dy * wide + dx))
    else:
        n = lambda dx, dy: hashed(ix + dx, iy + dy, seed)
    return (n(0, 0) * (1.0 - sx) + n(1, 0) * sx) * (1.0 - sy) + (n(0, 1) * (1.0 - sx) + n(1, 1) * sx) * sy


def fbm(y: np.ndarray, x: np.ndarray, octaves: int, base: float, seed: int, gain: float = 0.5, lacunarity: float = 2.0) -> np.ndarray:
    """Octaves of value noise, weighted and normalised to 0..1."""
    total, weight, amp, freq = 0.0, 0.0, 1.0, 1.0
    for i in range(octaves):
        total = total + amp * value_noise(y, x, max(2, int(base / freq)), seed + 1000 * i)
        weight, amp, freq = weight + amp, amp * gain, freq * lacunarity
    return total / weight
