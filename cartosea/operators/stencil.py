"""Neighbourhood operators over cells (y, x, ...): square tiles with a halo, and scatter-gather.

Border policies are those of each operator: blur and Laplacian wrap around, gradients are one-sided at edges. Operators
that look at nearby cells deal the grid to tiles, each with copies of the cells around it (the halo); windows then run
along a tile's rows and columns only, so one shuffle serves all of them, tasks are as many as tiles, and none grows with
the grid.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a tile's side.
TILE = 256


def folded(k: int) -> list[float]:
    """Weights of k rounds of a 3-mean along one axis, times 3**k; one round or none changes nothing."""
    w = [1.0]
    for _ in range(k if k > 1 else 0):
        w = [sum(w[max(0, i - 2) : i + 1]) for i in range(len(w) + 2)]
    return w


def tiles(cells: DataFrame, halo: int, size: int = TILE) -> DataFrame:
    """cells by tile (_ty, _tx), with copies of those within halo of a tile that isn't theirs (_own tells)."""
    at = lambda v: F.floor(v / float(size)).cast("int")
    spread = lambda c: F.explode(F.sequence(at(F.col(c) - halo), at(F.col(c) + halo)))
    dealt = cells.withColumn("_ty", spread("y")).withColumn("_tx", spread("x"))
    return dealt.withColumn("_own", (F.col("_ty") == at(F.col("y"))) & (F.col("_tx") == at(F.col("x")))).repartition("_ty", "_tx")


def _column():
    return Window.partitionBy("_ty", "_tx", "x").orderBy("y")


def _row():
    return Window.partitionBy("_ty", "_tx", "y").orderBy("x")


def own(dealt: DataFrame, *drop: str) -> DataFrame:
    """The cells that are their tile's own."""
    return dealt.where("_own").drop("_ty", "_tx", "_own", "_inner", *drop)


def extent(cells: DataFrame) -> DataFrame:
    """One row (h, w)."""
    return cells.agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def wrapped(cells: DataFrame, halo: int, size: int = TILE) -> DataFrame:
    """Tiles of a grid that goes on at its other side: cells near a side stand beyond the opposite one too. _own marks each
    cell where it belongs, once; _inner tells cells within the grid from those beyond it."""
    sized = cells.crossJoin(F.broadcast(extent(cells)))

    def copies(c, n):
        turns = F.ceil(F.lit(float(halo)) / F.col(n)).cast("int")
        return F.explode(F.filter(F.transform(F.sequence(-turns, turns), lambda m: F.col(c) + m * F.col(n)), lambda v: (v >= -halo) & (v < F.col(n) + halo)))

    around = sized.withColumn("_y", copies("y", "h")).withColumn("_x", copies("x", "w"))
    inner = (F.col("_y") == F.col("y")) & (F.col("_x") == F.col("x"))
    dealt = tiles(around.withColumn("_inner", inner).drop("y", "x", "h", "w").withColumnsRenamed({"_y": "y", "_x": "x"}), halo, size)
    return dealt.withColumn("_own", F.col("_own") & F.col("_inner"))


def blurs(cells: DataFrame, rounds: dict[str, int], carried=(), sloped: str | None = None) -> DataFrame:
    """(y, x, values...): each value after so many rounds of a 3-mean along both axes, wrapping around; one round changes
    nothing. Weighted sums along windows of one tile: one shuffle for all values and both axes. Carried columns come along
    as they are, and sloped adds what gradient() and laplacian() tell of that one of them: gy, gx, lap (of the neighbours
    that there are, where cells are missing)."""
    plain = cells.select("y", "x", *[F.col(c).cast("double").alias(c) for c in rounds], *carried)
    weights = {c: folded(k) for c, k in rounds.items() if k > 1}
    if not weights and not sloped:
        return plain

    def along(c, w):
        half = len(weights[c]) // 2
        out = F.col(c) * weights[c][half]
        for d in range(1, half + 1):
            out = out + weights[c][half + d] * (F.lag(c, d).over(w) + F.lead(c, d).over(w))
        return out / sum(weights[c])

    def slope(w):
        """One-sided at edges, where the next cell is one of the other side."""
        before, after = (F.when(f("_inner").over(w), f(sloped).over(w)) for f in (F.lag, F.lead))
        return _slope(before, after, F.col(sloped))

    def steps(axis, w):
        near = {f"_g{axis}{n}": F.coalesce(_beside(w, d, sloped, axis), F.lit(0.0)) for n, d in (("p", 1), ("m", -1))}
        return near | {f"g{axis}": slope(w)}

    # beyond the halo there is nothing: sums there are null, and so are not a tile's own
    dealt = wrapped(plain, max([len(v) // 2 for v in weights.values()] + [int(bool(sloped))]))
    for axis, w in (("y", _column()), ("x", _row())):
        dealt = dealt.withColumns({c: along(c, w) for c in weights} | (steps(axis, w) if sloped else {}))
    if sloped:
        near = [F.col(c) for c in ("_gyp", "_gym", "_gxp", "_gxm")]
        dealt = dealt.withColumn("lap", F.abs(near[0] + near[1] + near[2] + near[3] - 4.0 * F.col(sloped)))
    return own(dealt, "_gyp", "_gym", "_gxp", "_gxm")


def blur(cells: DataFrame, value: str, k: int = 3) -> DataFrame:
    """(y, x, v): value after k rounds of a 3-mean; see blurs()."""
    return blurs(cells.select("y", "x", F.col(value).alias("v")), {"v": k})


def relief_of(cells: DataFrame, value: str) -> DataFrame:
    """cells with gy and gx (one-sided at edges) and lap (the absolute Laplacian, wrapping around) from one pass over tiles."""
    size = extent(cells)
    dealt = wrapped(cells, 1).crossJoin(F.broadcast(size))
    around_ = {c: (F.lag(value).over(w), F.lead(value).over(w)) for c, w in (("y", _column()), ("x", _row()))}

    def along(c, n):
        before, after, here = *around_[c], F.col(value)
        first, last = F.col(c) == 0, F.col(c) == F.col(n) - 1
        step = F.when(first & last, None).when(first | last, 1.0).otherwise(2.0)
        return F.coalesce((F.when(last, here).otherwise(after) - F.when(first, here).otherwise(before)) / step, F.lit(0.0))

    lap = F.abs(around_["y"][1] + around_["y"][0] + around_["x"][1] + around_["x"][0] - 4.0 * F.col(value))
    return own(dealt.withColumns({"gy": along("y", "h"), "gx": along("x", "w"), "lap": lap}), "h", "w")


def _slope(before, after, here):
    """Central difference of two neighbours, one-sided where one is null."""
    step = F.when(before.isNotNull() & after.isNotNull(), 2.0).when(before.isNotNull() | after.isNotNull(), 1.0)
    return F.coalesce((F.coalesce(after, here) - F.coalesce(before, here)) / step, F.lit(0.0))


def gradient(cells: DataFrame, value: str = "z", pixel: float = 1.0) -> DataFrame:
    """cells with gy and gx: central differences, one-sided at edges."""

    def along(w):
        return _slope(F.lag(value).over(w), F.lead(value).over(w), F.col(value)) / pixel

    return own(tiles(cells, 1).withColumn("gy", along(_column())).withColumn("gx", along(_row())))


def hillshade(gy, gx, azimuth: float = 315.0, altitude: float = 45.0):
    """Illumination of a surface by the sun, 0..1, from gradients."""
    az, alt = math.radians(azimuth), math.radians(altitude)
    s = F.atan(F.sqrt(gx * gx + gy * gy))
    h = math.sin(alt) * F.cos(s) + math.cos(alt) * F.sin(s) * F.cos(az - F.atan2(-gx, gy))
    return F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))


def stretch(cells: DataFrame, value, name: str, eps: float = 0.0) -> DataFrame:
    """cells with name: value between its minimum and maximum over the grid (0 if they hardly differ)."""
    named = cells.withColumn("_v", F.when(F.isnan(value) | value.isNull() | (F.abs(value) == float("inf")), 0.0).otherwise(value))
    ends = named.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    out = (F.col("_v") - F.col("_lo")) / (span + eps) if eps else F.when(span < 1e-9, 0.0).otherwise((F.col("_v") - F.col("_lo")) / F.nullif(span, F.lit(0.0)))
    return named.crossJoin(F.broadcast(ends)).withColumn(name, out).drop("_v", "_lo", "_hi")


def unit_mask(cells: DataFrame, value: str, name: str) -> DataFrame:
    """cells with name: value, divided by its maximum over the grid where that exceeds 1."""
    top = cells.agg(F.max(value).alias("_top"))
    return cells.crossJoin(F.broadcast(top)).withColumn(name, F.when(F.col("_top") > 1.0, F.col(value) / F.col("_top")).otherwise(F.col(value))).drop("_top")


def stretch_all(cells: DataFrame, names) -> DataFrame:
    """cells with each of the named columns between its minimum and maximum over the grid (0 if they hardly differ): one
    aggregate for all of them."""
    ends = cells.agg(*[f(c).alias(f"_{k}_{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max))])
    unit = lambda c: F.when(F.col(f"_hi_{c}") - F.col(f"_lo_{c}") < 1e-9, 0.0).otherwise((F.col(c) - F.col(f"_lo_{c}")) / F.nullif(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(0.0)))
    return cells.crossJoin(F.broadcast(ends)).withColumns({c: unit(c) for c in names}).drop(*ends.columns)


def laplacian(cells: DataFrame, value: str = "z") -> DataFrame:
    """(y, x, lap): absolute sum of the four neighbours less four times the cell, wrapping around."""
    near = [f("v").over(w) for w in (_column(), _row()) for f in (F.lead, F.lag)]
    dealt = wrapped(cells.select("y", "x", F.col(value).alias("v")), 1)
    return own(dealt.withColumn("lap", F.abs(near[0] + near[1] + near[2] + near[3] - 4.0 * F.col("v"))), "v")


def neighbours(cells: DataFrame, offsets: list[tuple[int, int]], value: str) -> DataFrame:
    """(y, x, k, v): what stands at each offset of each cell; k is the offset's index; nothing beyond edges."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(offsets)]))
    sent = cells.select("y", "x", F.col(value).alias("v"), steps.alias("s"))
    return sent.select((F.col("y") - F.col("s.a")).alias("y"), (F.col("x") - F.col("s.b")).alias("x"), F.col("s.k").alias("k"), "v")


CROSS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]


def morph(dealt: DataFrame, mask: str, grow: bool) -> DataFrame:
    """Tiles with mask dilated (grow) or eroded by a cross; what is outside the grid never decides."""
    best = F.greatest if grow else F.least  # both pass over nulls
    near = [f(mask).over(w) for w in (_column(), _row()) for f in (F.lag, F.lead)]
    return dealt.withColumn(mask, best(F.col(mask), *near))


def open_close(cells: DataFrame, mask: str) -> DataFrame:
    """(y, x, m): opening, then closing; every round spends one cell of the halo."""
    out = tiles(cells.select("y", "x", F.col(mask).alias("m")), 4)
    for grow in (False, True, True, False):
        out = morph(out, "m", grow)
    return own(out)


def _beside(w, step: int, value: str, axis: str):
    """The value one cell before (-1) or after (1) along a window; null where no cell is."""
    f = F.lag if step < 0 else F.lead
    return F.when(f(axis).over(w) == F.col(axis) + step, f(value).over(w))


def around(cells: DataFrame, value: str) -> DataFrame:
    """cells with the values of their eight neighbours, null where there is none: n_<dy>_<dx> with m for -1, 0 and p for 1.
    Tiles with a halo of one cell: one shuffle."""
    dealt = tiles(cells, 1)
    for name, step in (("m", -1), ("p", 1)):
        dealt = dealt.withColumn(f"n_0_{name}", _beside(_row(), step, value, "x"))
    dealt = dealt.withColumn("n_0_0", F.col(value))
    for name, step in (("m", -1), ("p", 1)):
        dealt = dealt.withColumns({f"n_{name}_{dx}": _beside(_column(), step, f"n_0_{dx}", "y") for dx in "m0p"})
    return own(dealt, "n_0_0")


def boundaries(cells: DataFrame, field: str) -> DataFrame:
    """(y, x, edge): whether a cell's field differs from that to its south, east, south-east or south-west."""
    differs = [F.coalesce(F.col(f"n_{n}") != F.col(field), F.lit(False)) for n in ("p_0", "0_p", "p_p", "p_m")]
    return around(cells.select("y", "x", field), field).select("y", "x", (differs[0] | differs[1] | differs[2] | differs[3]).alias("edge"))


def sobel(cells: DataFrame, value: str) -> DataFrame:
    """(y, x, mag): Sobel gradient magnitude; the border mirrors the cells inside it."""
    full = around(cells.select("y", "x", F.col(value).cast("double").alias("v")), "v")
    here = F.col("v")

    def at(dy, dx):
        """A neighbour, or across the border its mirror image; along an only row or column the cell itself."""
        name = lambda a, b: "n_" + {-1: "m", 0: "0", 1: "p"}[a] + "_" + {-1: "m", 0: "0", 1: "p"}[b]
        tries = dict.fromkeys([(dy, dx), (-dy, dx), (dy, -dx), (-dy, -dx)]) if dy and dx else dict.fromkeys([(dy, dx), (-dy, -dx)])
        return F.coalesce(*[F.col(name(*p)) for p in tries], *([F.col(name(dy, 0)), F.col(name(-dy, 0)), F.col(name(0, dx)), F.col(name(0, -dx))] if dy and dx else []), here)

    gx = at(-1, 1) + 2.0 * at(0, 1) + at(1, 1) - at(-1, -1) - 2.0 * at(0, -1) - at(1, -1)
    gy = at(1, -1) + 2.0 * at(1, 0) + at(1, 1) - at(-1, -1) - 2.0 * at(-1, 0) - at(-1, 1)
    return full.withColumns({"gx": gx, "gy": gy}).select("y", "x", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("mag"))


def half_shift(cells: DataFrame, value: str) -> DataFrame:
    """(y, x, v): mean of a cell and those before it in both directions, mirrored at the border."""
    before = lambda c, w: F.coalesce(F.lag(c).over(w), F.col(c))
    pairs = tiles(cells.select("y", "x", F.col(value).alias("_v")), 1).withColumn("_s", F.col("_v") + before("_v", _row()))
    return own(pairs.withColumn("v", (F.col("_s") + before("_s", _column())) / 4.0), "_v", "_s")


def gather(cells: DataFrame, value: str, dy, dx) -> DataFrame:
    """(y, x, v): the value at (y + dy, x + dx), rounded and held inside the grid."""
    sized = cells.crossJoin(F.broadcast(extent(cells)))
    inside = lambda v, n: F.least(F.greatest(F.bround(v).cast("int"), F.lit(0)), n - 1)
    asks = sized.select("y", "x", inside(F.col("y") + dy, F.col("h")).alias("sy"), inside(F.col("x") + dx, F.col("w")).alias("sx"))
    return asks.join(cells.select(F.col("y").alias("sy"), F.col("x").alias("sx"), F.col(value).alias("v")), ["sy", "sx"]).select("y", "x", "v")


def block(cells: DataFrame, factor: int, **aggs) -> DataFrame:
    """Aggregates of factor x factor blocks; cells beyond the last whole block are cropped."""
    sized = cells.crossJoin(F.broadcast(extent(cells)))
    whole = sized.where((F.col("y") < F.floor(F.col("h") / factor) * factor) & (F.col("x") < F.floor(F.col("w") / factor) * factor))
    return whole.groupBy(F.floor(F.col("y") / factor).cast("int").alias("by"), F.floor(F.col("x") / factor).cast("int").alias("bx")).agg(*[v.alias(k) for k, v in aggs.items()])


def area_resize(cells: DataFrame, value: str | list[str], height: int, width: int) -> DataFrame:
    """(ty, tx, v), or (ty, tx, values...) for a list: area-weighted means on a grid of any size; each cell goes to the
    targets that it overlaps."""
    sized = cells.crossJoin(F.broadcast(extent(cells)))
    ry, rx = F.lit(float(height)) / F.col("h"), F.lit(float(width)) / F.col("w")

    def targets(at, ratio):
        return F.sequence(F.floor(F.col(at) * ratio).cast("int"), (F.ceil((F.col(at) + 1) * ratio - 1e-9) - 1).cast("int"))

    def overlap(at, target, ratio):
        return F.least((F.col(at) + 1) * ratio, F.col(target) + 1.0) - F.greatest(F.col(at) * ratio, F.col(target) + 0.0)

    spread = sized.withColumn("ty", F.explode(targets("y", ry))).withColumn("tx", F.explode(targets("x", rx)))
    area = spread.withColumn("_a", overlap("y", "ty", ry) * overlap("x", "tx", rx)).where("_a > 1e-12")
    names = {value: "v"} if isinstance(value, str) else {v: v for v in value}
    return area.groupBy("ty", "tx").agg(*[(F.sum(F.col("_a") * F.col(v)) / F.sum("_a")).alias(n) for v, n in names.items()])


def nearest_resize(cells: DataFrame, value: str, height: int, width: int) -> DataFrame:
    """(ty, tx, v): the nearest cell of each target cell."""
    spark = cells.sparkSession
    target = spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("ty"), (F.col("id") % width).cast("int").alias("tx"))
    asks = target.crossJoin(F.broadcast(extent(cells))).select("ty", "tx", F.floor(F.col("ty") * F.col("h") / float(height)).cast("int").alias("y"), F.floor(F.col("tx") * F.col("w") / float(width)).cast("int").alias("x"))
    return asks.join(cells.select("y", "x", F.col(value).alias("v")), ["y", "x"]).select("ty", "tx", "v")
