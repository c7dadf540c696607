"""Queries of the sensor chain, step by step at the cells' own resolution, and whole."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cartosea.functions import noise
from cartosea.operators import imaging
from cartosea.plans import raster
from cartosea.plans.raster import _fbm_sql, _refl, relief
from cartosea.sources import tables as t

r6 = lambda c: F.round(c, 6)
#: Settings that the steps are queried with, and their tiles' sides and halos.
SENSOR = imaging.Sensor(supersample=1)
TILE = 64


def _cells(spark, sf):
    """Patches of colour with water where prices are low, and a relief."""
    water = t.grid(spark, sf).select("y", "x", (F.col("z") < 100000).cast("double").alias("water"))
    return t.patches(spark, sf).join(water, ["y", "x"]).join(relief(spark, sf).select("y", "x", (F.col("z") / 10.0).alias("z")), ["y", "x"])


def _step(name, doc, kernel, halo):
    def query(spark, sf):
        out = imaging.on_tiles(_cells(spark, sf), imaging.bands(kernel), list("rgb"), halo, TILE)
        return out.select("y", "x", *[r6(c).alias(c) for c in "rgb"])

    query.__name__, query.__doc__ = name, doc
    return query


STEPS = [
    _step("eo_texture", "Brightness and hue by noise of three scales; hue on land only.", lambda a, at, m: imaging.textured(a, at, SENSOR, m["water"]), 0),
    _step("eo_water", "Ripples and glints on water.", lambda a, at, m: imaging.rippled(a, at, SENSOR, m["water"]), 0),
    _step("eo_relief", "Bands lit by the relief.", lambda a, at, m: imaging.shaded(a, m["z"], SENSOR), 1),
    _step("eo_soft_edges", "Bilateral smoothing along edges.", lambda a, at, m: imaging.softened(a, SENSOR), 8),
    _step("eo_optics", "Blur of the optics, wider along rows.", lambda a, at, m: imaging.gaussian(a, SENSOR.optics_sigma, 0.7 * SENSOR.optics_sigma), 4),
    _step("eo_haze", "Haze of noisy strength, and lifted blacks.", lambda a, at, m: imaging.hazed(a, at, SENSOR), 0),
    _step("eo_warp", "Cells gathered from fractional places that noise displaces.", lambda a, at, m: imaging.warped(a, at, SENSOR), 2),
    _step("eo_bilateral", "Smoothing of the finished image, in its share.", lambda a, at, m: a * 0.88 + imaging.bilateral(a, SENSOR.smooth_size, SENSOR.smooth_colour, SENSOR.smooth_space) * 0.12, 2),
    _step("eo_sharpen", "Detail raised after the tone curve.", lambda a, at, m: imaging.unsharp(a, SENSOR.sharpen), 4),
]


def eo_edges(spark, sf):
    """Edges between colours, widened by an ellipse and softened."""
    cells = _cells(spark, sf).select("y", "x", *"rgb")
    kernel = lambda arrays, at: [imaging.edge_mask(imaging.np.stack([arrays[c] for c in "rgb"], 2), SENSOR)]
    return imaging.on_tiles(cells, kernel, ["edge"], 6, TILE).select("y", "x", r6("edge").alias("edge"))


def eo_tiles(spark, sf):
    """Colours, relief and water through the whole chain."""
    return imaging.sense_tiles(_cells(spark, sf)).select("y", "x", *[r6(c).alias(c) for c in "rgb"])


def degraded_rgb(spark, sf):
    """Colours of 4 m seen at 10.8 m: blurred, averaged over 2.7 cells, less saturated."""
    return imaging.degrade(t.patches(spark, sf), 4.0, 10.8, TILE).select("y", "x", *[r6(c).alias(c) for c in "rgb"])


def flir_frames(spark, sf):
    """A thermal frame for each nation."""
    frames = t.read(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("frame"))
    return imaging.thermal_frames(frames, imaging.thermal_base(spark), 64).select("frame", "y", "x", *[F.round(c, 5).alias(c) for c in "rgb"])


QUERIES = {f.__name__: f for f in (*STEPS, eo_edges, eo_tiles, degraded_rgb, flir_frames)}

_r = lambda v, n=6: f"(round({v}, {n}) + 0e0)"
_clip = lambda v: f"least(greatest({v},0e0),1e0)"
_lit = lambda v: f"CAST({v!r} AS DOUBLE)"
_HEAD = f"{t.ctes('grid', 'patches')}, {raster._HW}, wt AS (SELECT y, x, CAST(z<100000 AS DOUBLE) AS water FROM grid), c AS (SELECT p.*, water FROM patches p JOIN wt ON wt.y=p.y AND wt.x=p.x)"
_out = lambda of, source: f"SELECT y, x, {', '.join(_r(of(i, b)) + f' AS {b}' for i, b in enumerate('rgb'))} FROM {source}"


def _gauss_sql(source, columns, name, sigma_x, sigma_y, radius=None, mirror=0):
    """Two passes of weights; mirror 1 doesn't repeat the border's own cell."""
    out, before = [], source
    for axis, size, sigma in (("y", "h", sigma_y), ("x", "w", sigma_x)):
        n = radius or max(1, (int(8 * sigma + 1.5) | 1) // 2)
        w = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-n, n + 1)]
        values = ",".join(f"({d},{_lit(v / sum(w))})" for d, v in zip(range(-n, n + 1), w))
        other = "x" if axis == "y" else "y"
        place = f"(CASE WHEN {axis}+d<0 THEN -({axis}+d)-1+{mirror} WHEN {axis}+d>={size} THEN 2*{size}-1-{mirror}-({axis}+d) ELSE {axis}+d END)"
        out.append(f"{name}{axis}w(d,wgt) AS (VALUES {values})")
        out.append(f"{name}{axis}p AS (SELECT {axis}, d, wgt, {place} AS src FROM (SELECT DISTINCT {axis} FROM {before}), s, {name}{axis}w)")
        sums = ", ".join(f"sum(b.{c}*wgt) AS {c}" for c in columns)
        out.append(f"{name}{axis} AS (SELECT p.{axis}, b.{other}, {sums} FROM {name}{axis}p p JOIN {before} b ON b.{axis}=p.src GROUP BY 1,2)")
        before = f"{name}{axis}"
    return ", ".join(out), before


def _texture_sql():
    s = SENSOR
    noise = [_fbm_sql(n, b, seed, s.gain, s.lacunarity) for n, b, seed in ((s.octaves, s.texture_base, s.seed), (s.octaves - 2, s.texture_base * 1.5, s.seed + 1), (s.octaves - 4, s.texture_base * 2.5, s.seed + 2))]
    hue = [("9e-1", "1e-1", "mn"), ("88e-2", "12e-2", "fn"), ("92e-2", "8e-2", "cn")]
    return f"{_HEAD}, q AS (SELECT *, {noise[0]} AS fn, {noise[1]} AS mn, {noise[2]} AS cn FROM c) " + _out(lambda i, b: _clip(f"{b}*(85e-2+15e-2*fn)*(1e0+({hue[i][0]}+{hue[i][1]}*{hue[i][2]}-1e0)*(1e0-water))"), "q")


def _water_sql():
    s = SENSOR
    ripple = f"7e-1*{_fbm_sql(4, 32, s.seed + 100, 0.6, 2.5)}+3e-1*{_fbm_sql(4, 48, s.seed + 101, 0.6, 2.5)}"
    toward = "((x*cos(radians(315e0))+y*sin(radians(315e0)))/sqrt(w*w+h*h)+1e0)/2e0"
    return f"{_HEAD}, q AS (SELECT c.*, {ripple} AS rp, pow({_fbm_sql(3, 64, s.seed + 102, 0.4, 3.0)}*{toward},4) AS sp FROM c, s) " + _out(lambda i, b: _clip(f"{b}*(1e0-water)+{b}*(94e-2+6e-2*rp)*water+sp*{('2e-1', '3e-1', '5e-1')[i]}*water*8e-2"), "q")


def _relief_sql():
    z10 = raster._RELIEF.split(", nn AS")[0]
    light = "6e-1+4e-1*least(greatest(sin(radians(45e0))*cos(atan(sqrt(gx*gx+gy*gy)))+cos(radians(45e0))*sin(atan(sqrt(gx*gx+gy*gy)))*cos(radians(315e0)-atan2(-gx,gy)),0e0),1e0)"
    return f"{_HEAD}, {z10}, zz AS (SELECT y, x, z/1e1 AS z FROM rl), {raster._grad_sql('zz', 'z')}, q AS (SELECT c.*, {light} AS lt FROM c JOIN gr ON gr.y=c.y AND gr.x=c.x) " + _out(lambda i, b: _clip(f"{b}*lt"), "q")


def _edge_ctes():
    offsets = "o(da,db,u,v) AS (VALUES (-1,-1,-1e0,-1e0),(-1,0,0e0,-2e0),(-1,1,1e0,-1e0),(0,-1,-2e0,0e0),(0,1,2e0,0e0),(1,-1,-1e0,1e0),(1,0,0e0,2e0),(1,1,1e0,1e0))"
    sums = ", ".join(f"sqrt(pow(sum(n.{b}*u),2)+pow(sum(n.{b}*v),2)) AS g{b}" for b in "rgb")
    ellipse = ",".join(f"({dy},{dx})" for dy, reach in zip(range(-2, 3), imaging.ELLIPSE) for dx in range(-reach, reach + 1))
    hard = f"{offsets}, q0 AS (SELECT y, x, {_refl('(y+da)', 'h')} AS ny, {_refl('(x+db)', 'w')} AS nx, u, v FROM c, s, o), sb AS (SELECT q0.y, q0.x, {sums} FROM q0 JOIN c n ON n.y=q0.ny AND n.x=q0.nx GROUP BY 1,2), hd AS (SELECT y, x FROM sb WHERE greatest(gr,gg,gb)>5e-2)"
    wide = f"el(da,db) AS (VALUES {ellipse}), sp AS (SELECT DISTINCT y+da AS y, x+db AS x FROM hd, el), ed AS (SELECT c.y, c.x, CAST(sp.y IS NOT NULL AS DOUBLE) AS e FROM c LEFT JOIN sp ON sp.y=c.y AND sp.x=c.x)"
    blur, last = _gauss_sql("ed", ["e"], "em", SENSOR.edge_sigma, SENSOR.edge_sigma, 3, 1)
    return f"{hard}, {wide}, {blur}", last


def _bilateral_ctes(size, colour, space):
    n = size // 2
    disc = ",".join(f"({i},{j},{_lit(math.exp(-(i * i + j * j) / (2 * space**2)))})" for i in range(-n, n + 1) for j in range(-n, n + 1) if i * i + j * j <= n * n)
    u8 = ", ".join(f"floor({_clip(b)}*255e0) AS {b}" for b in "rgb")
    near = f"u8 AS (SELECT y, x, {u8} FROM c), di(i,j,sw) AS (VALUES {disc}), nb AS (SELECT u.y, u.x, u.r, u.g, u.b, sw, {_refl('(u.y+i)', 'h')} AS ny, {_refl('(u.x+j)', 'w')} AS nx FROM u8 u, s, di)"
    each = "bw AS (SELECT nb.y, nb.x, m.r, m.g, m.b, exp(-pow(abs(m.r-nb.r)+abs(m.g-nb.g)+abs(m.b-nb.b),2)/%s)*sw AS wgt FROM nb JOIN u8 m ON m.y=nb.ny AND m.x=nb.nx)" % _lit(2.0 * colour**2)
    return f"{near}, {each}, bf AS (SELECT y, x, {', '.join(f'round_even(sum({b}*wgt)/sum(wgt),0)/255e0 AS {b}' for b in 'rgb')} FROM bw GROUP BY 1,2)"


def _soft_sql():
    edge, last = _edge_ctes()
    return f"{_HEAD}, {edge}, {_bilateral_ctes(7, 30.0, 7.0)}, q AS (SELECT c.y, c.x, {', '.join(f'c.{b}*(1e0-e)+bf.{b}*e AS {b}' for b in 'rgb')} FROM c JOIN {last} m ON m.y=c.y AND m.x=c.x JOIN bf ON bf.y=c.y AND bf.x=c.x) " + _out(lambda i, b: _clip(b), "q")


def _optics_sql():
    blur, last = _gauss_sql("c", list("rgb"), "ob", SENSOR.optics_sigma, 0.7 * SENSOR.optics_sigma)
    return f"{_HEAD}, {blur} " + _out(lambda i, b: b, last)


def _sharpen_sql():
    blur, last = _gauss_sql("c", list("rgb"), "ub", 0.8, 0.8)
    return f"{_HEAD}, {blur}, q AS (SELECT c.y, c.x, {', '.join(f'c.{b}+{_lit(SENSOR.sharpen)}*(c.{b}-m.{b}) AS {b}' for b in 'rgb')} FROM c JOIN {last} m ON m.y=c.y AND m.x=c.x) " + _out(lambda i, b: _clip(b), "q")


def _haze_sql():
    return f"{_HEAD}, q AS (SELECT *, 3e-2+2e-2*{_fbm_sql(3, 256, SENSOR.seed + 5000, 0.6, 2.0)} AS k FROM c) " + _out(lambda i, b: _clip(f"({b}*(1e0-k)+{('75e-2', '8e-1', '85e-2')[i]}*k)*97e-2+3e-2"), "q")


def _warp_sql():
    move = [f"(2e0*{_fbm_sql(4, SENSOR.warp_base, SENSOR.seed + k)}-1e0)*{_lit(SENSOR.warp)}" for k in (222, 111)]
    at = lambda v, n: f"(CASE WHEN {v}<0 THEN -({v})-1 WHEN {v}>={n} THEN 2*{n}-1-({v}) ELSE {v} END)"
    corner = f"p AS (SELECT y, x, y+{move[0]} AS py, x+{move[1]} AS px FROM c), f AS (SELECT y, x, floor(py) AS iy, floor(px) AS ix, py-floor(py) AS ty, px-floor(px) AS tx FROM p), k4(da,db) AS (VALUES (0,0),(0,1),(1,0),(1,1)), n AS (SELECT y, x, {at('(iy+da)', 'h')} AS sy, {at('(ix+db)', 'w')} AS sx, (CASE da WHEN 1 THEN ty ELSE 1e0-ty END)*(CASE db WHEN 1 THEN tx ELSE 1e0-tx END) AS wgt FROM f, s, k4)"
    return f"{_HEAD}, {corner}, q AS (SELECT n.y, n.x, {', '.join(f'sum(m.{b}*wgt) AS {b}' for b in 'rgb')} FROM n JOIN c m ON m.y=n.sy AND m.x=n.sx GROUP BY 1,2) " + _out(lambda i, b: b, "q")


def _degraded_sql():
    blur, last = _gauss_sql("patches", list("rgb"), "db", 0.45 * 2.7, 0.45 * 2.7)
    over = lambda a, n, k: f"(least(({a}+1)*{n}/{k}, {'ty' if a == 'y' else 'tx'}+1)-greatest({a}*{n}/{k}, {'ty' if a == 'y' else 'tx'}))"
    a, b = over("y", "nh", "h"), over("x", "nw", "w")
    size = "z AS (SELECT h, w, greatest(1,round_even(h/27e-1,0)) AS nh, greatest(1,round_even(w/27e-1,0)) AS nw FROM s)"
    spread = f"q1 AS (SELECT m.*, z.*, unnest(range(CAST(floor(y*nh/h) AS INT), CAST(ceil((y+1)*nh/h-1e-9) AS INT))) AS ty FROM {last} m, z), q2 AS (SELECT *, unnest(range(CAST(floor(x*nw/w) AS INT), CAST(ceil((x+1)*nw/w-1e-9) AS INT))) AS tx FROM q1)"
    area = f"{spread}, o AS (SELECT *, {a}*{b} AS ar FROM q2), p AS (SELECT CAST(ty AS INT) AS y, CAST(tx AS INT) AS x, {', '.join(f'sum(ar*{c})/sum(ar) AS {c}' for c in 'rgb')} FROM o WHERE ar>1e-12 GROUP BY 1,2)"
    return f"{_HEAD}, {blur}, {size}, {area} " + _out(lambda i, c: f"least(pow(greatest({c}*88e-2+(r+g+b)/3e0*12e-2,0e0),104e-2),1e0)", "p")


def _frames_sql(size=64, seed=42):
    normal = lambda a, b, k: f"(sqrt(-2e0*ln(greatest({noise.hash_sql(a, b, k)},1e-7)))*cos({noise.hash_sql(a, b, k + 1)}*{_lit(2 * math.pi)}))"
    length, beam, mid = size * 0.45, size * 0.22, size // 2
    sh, sw = beam * 0.4, length * 0.6
    top = mid - beam / 2 - sh / 2
    mask = f"(pow((x-{mid})/{_lit(length / 2)},2)+pow((y-{mid})/{_lit(beam / 2)},2)<=1e0 OR (x>={_lit(mid - sw / 2)} AND x<={_lit(mid + sw / 2)} AND y>={_lit(top - sh / 2)} AND y<={_lit(top + sh / 2)}))"
    far = f"sqrt(pow(y-{mid},2)+pow(x-{mid},2))/{_lit(math.hypot(mid, mid) + 1e-6)}"
    cells = f"px AS (SELECT CAST(a.range AS INT) AS y, CAST(b.range AS INT) AS x FROM range({size}) a, range({size}) b), s AS (SELECT {size} AS h, {size} AS w), c AS (SELECT y, x, {_clip(f'(CASE WHEN {mask} THEN 9e-1*(1e0-5e-1*({far})) ELSE 2e-1 END)+5e-2*' + normal('x', 'y', seed))} AS t FROM px)"
    blur, last = _gauss_sql("c", ["t"], "tb", 1.5, 1.5)
    drift = lambda n, most: f"((2e0*{noise.hash_sql('f', str(n), seed)}-1e0)*{_lit(most)})"
    moves = f"mv AS (SELECT CAST(n_nationkey AS INT) AS f FROM nation), m2 AS (SELECT f, radians({drift(1, 0.5)}) AS turn, CAST(round_even({drift(2, 2.0)},0) AS INT) AS mx, CAST(round_even({drift(3, 2.0)},0) AS INT) AS my FROM mv)"
    m = _lit((size - 1) / 2)
    at = f"q AS (SELECT f, px.y, px.x, px.y-my>=0 AND px.y-my<{size} AND px.x-mx>=0 AND px.x-mx<{size} AS ins, (px.x-mx-{m})*cos(turn)-(px.y-my-{m})*sin(turn)+{m} AS sx, (px.x-mx-{m})*sin(turn)+(px.y-my-{m})*cos(turn)+{m} AS sy FROM m2, px), k4(da,db) AS (VALUES (0,0),(0,1),(1,0),(1,1)), w AS (SELECT f, y, x, ins, CAST(floor(sy) AS INT)+da AS by_, CAST(floor(sx) AS INT)+db AS bx, (CASE da WHEN 1 THEN sy-floor(sy) ELSE 1e0-(sy-floor(sy)) END)*(CASE db WHEN 1 THEN sx-floor(sx) ELSE 1e0-(sx-floor(sx)) END) AS wgt FROM q, k4)"
    heat = f"ht AS (SELECT f, w.y, w.x, bool_and(ins) AS ins, sum(wgt*coalesce(t,2e-1)) AS t FROM w LEFT JOIN {last} b ON b.y=w.by_ AND b.x=w.bx GROUP BY 1,2,3), sn AS (SELECT f, y, x, {_clip('(CASE WHEN ins THEN t ELSE 2e-1 END)+3e-2*' + normal(f'(f*{size * size}+y*{size}+x)', '7', seed))} AS t FROM ht)"
    ramp = [("t/3e-1*2e-1", "(t-3e-1)/3e-1*3e-1", "3e-1+(t-6e-1)/4e-1*7e-1"), ("t/3e-1*3e-1", "5e-1+(t-3e-1)/3e-1*3e-1", "8e-1+(t-6e-1)/4e-1*2e-1"), ("t/3e-1*8e-1", "8e-1-(t-3e-1)/3e-1*3e-1", "5e-1-(t-6e-1)/4e-1*5e-1")]
    colours = ", ".join(f"{_r(_clip(f'CASE WHEN t<=3e-1 THEN {a} WHEN t<=6e-1 THEN {b} ELSE {c} END'), 5)} AS {band}" for (a, b, c), band in zip(ramp, "rgb"))
    return f"WITH {cells}, {blur}, {moves}, {at}, {heat} SELECT f AS frame, y, x, {colours} FROM sn"


SQL = {
    "degraded_rgb": _degraded_sql(),
    "flir_frames": _frames_sql(),
    "eo_texture": _texture_sql(),
    "eo_water": _water_sql(),
    "eo_relief": _relief_sql(),
    "eo_edges": f"{_HEAD}, {_edge_ctes()[0]} SELECT y, x, {_r('e')} AS edge FROM {_edge_ctes()[1]}",
    "eo_soft_edges": _soft_sql(),
    "eo_optics": _optics_sql(),
    "eo_haze": _haze_sql(),
    "eo_warp": _warp_sql(),
    "eo_bilateral": f"{_HEAD}, {_bilateral_ctes(SENSOR.smooth_size, SENSOR.smooth_colour, SENSOR.smooth_space)}, q AS (SELECT c.y, c.x, {', '.join(f'c.{b}*88e-2+bf.{b}*12e-2 AS {b}' for b in 'rgb')} FROM c JOIN bf ON bf.y=c.y AND bf.x=c.x) " + _out(lambda i, b: b, "q"),
    "eo_sharpen": _sharpen_sql(),
}
