"""Queries over the grid: aggregates, stencils, noise and hydrology masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartosea.functions import colour, noise
from cartosea.operators import palettes
from cartosea.operators import stencil as st
from cartosea.operators.graph import staged
from cartosea.operators.ranks import quantiles
from cartosea.operators.textures import textured
from cartosea.sources import tables as t

r6 = lambda c: F.round(c, 6)


def _grid(spark, sf):
    return t.grid(spark, sf)


def _norm(spark, sf):
    """The grid with z in 0..1."""
    return st.stretch(_grid(spark, sf), F.col("z"), "n")


def relief(spark, sf):
    """(y, x, z): hills of four octaves over the grid's cells, roughened by their prices, so that water gathers."""
    hills = textured(_grid(spark, sf), {"hills": (4, 48, 0)}, 5)
    return hills.select("y", "x", (600.0 * F.col("hills") + F.col("z") / 1000000.0).alias("z"))


def minmax_norm(spark, sf):
    """Range of z stretched to 0..1, with and without the small divisor guard."""
    g = st.stretch(st.stretch(_grid(spark, sf), F.col("z"), "a"), F.col("z"), "b", eps=1e-6)
    return g.select("y", "x", r6("a").alias("a"), r6("b").alias("b"), (F.col("a") * 65535).cast("int").alias("visual"))


def quantile_mask(spark, sf):
    """Cells at or above the exact 98.5 % quantile."""
    g = _grid(spark, sf)
    (thr,) = quantiles(g, "z", [0.985])
    return g.select("y", "x", (F.col("z") >= thr).alias("top"), r6(F.lit(thr).cast("double")).alias("thr"))


def block_mean(spark, sf):
    """Means of 5 x 5 blocks."""
    return st.block(_grid(spark, sf), 5, mean=r6(F.avg("z")))


def block_any(spark, sf):
    """Whether a 5 x 5 block has a cell of a high price; the pyramid's rule for masks."""
    return st.block(_grid(spark, sf), 5, hit=F.bool_or(F.col("z") > 490000), share=r6(F.avg((F.col("z") > 400000).cast("double"))))


def area_resize(spark, sf):
    """Area resampling to 7 x 30."""
    return st.area_resize(_grid(spark, sf), "z", 7, 30).select("ty", "tx", F.round("v", 4).alias("v"))


def nearest_resize(spark, sf):
    """Nearest resampling of a mask to 40 x 37."""
    g = _grid(spark, sf).select("y", "x", (F.col("z") > 200000).alias("m"))
    return st.nearest_resize(g, "m", 40, 37).select("ty", "tx", F.col("v").alias("m"))


def water_share(spark, sf):
    """Cells and share of the mask."""
    return _grid(spark, sf).agg(F.sum((F.col("z") < 100000).cast("bigint")).alias("cells"), r6(F.avg((F.col("z") < 100000).cast("double"))).alias("share"))


def gradient(spark, sf):
    """Gradients at 10 m pixels."""
    return st.gradient(_grid(spark, sf), "z", 10.0).select("y", "x", r6("gy").alias("gy"), r6("gx").alias("gx"))


def slope(spark, sf):
    """Slope stretched to 0..1."""
    g = st.gradient(_grid(spark, sf), "z", 10.0)
    return st.stretch(g, F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")), "s").select("y", "x", r6("s").alias("slope"))


def hillshade(spark, sf):
    """Hillshade from the north-west at 45 degrees."""
    return st.gradient(_grid(spark, sf), "z", 100000.0).select("y", "x", r6(st.hillshade(F.col("gy"), F.col("gx"))).alias("shade"))


def laplacian(spark, sf):
    """Absolute Laplacian, wrapping around."""
    return st.laplacian(_grid(spark, sf)).select("y", "x", F.round("lap", 4).alias("lap"))


def blur_k2(spark, sf):
    """Two rounds of 3-means of a mask."""
    g = _grid(spark, sf).select("y", "x", (F.col("z") > 300000).cast("double").alias("m"))
    return st.blur(g, "m", 2).select("y", "x", r6("v").alias("v"), (F.col("v") > 0.3).alias("m"))


def blur_k3(spark, sf):
    """Three rounds of 3-means."""
    return st.blur(_grid(spark, sf), "z", 3).select("y", "x", F.round("v", 4).alias("v"))


def field_edges(spark, sf):
    """Boundaries between parcels of 7 cells' width."""
    g = _grid(spark, sf).select("y", "x", (F.floor((F.col("y") + F.col("x") / 3.0) / 7) * 10000 + F.floor(F.col("x") / 7)).cast("int").alias("f"))
    return st.boundaries(g, "f")


def field_edges_soft(spark, sf):
    """Those boundaries blurred twice and cut at a quarter."""
    e = field_edges(spark, sf).select("y", "x", F.col("edge").cast("double").alias("e"))
    return st.blur(e, "e", 2).select("y", "x", r6("v").alias("v"), (F.col("v") > 0.25).alias("edge"))


def map_water_soft(spark, sf):
    """Water on map tiles, blurred twice and cut at 0.3."""
    w = t.colours(spark, sf).select("y", "x", colour.is_map_water(F.col("r"), F.col("g"), F.col("b")).cast("double").alias("w"))
    return st.blur(w, "w", 2).select("y", "x", r6("v").alias("v"), (F.col("v") > 0.3).alias("water"))


def fbm_signed(spark, sf):
    """Three octaves of value noise in -1..1."""
    return _grid(spark, sf).select("y", "x", r6(noise.fbm_signed(F.col("x"), F.col("y"), 3, 48, seed=9)).alias("n"))


def unit_masks(spark, sf):
    """A mask of bytes divided by its maximum, and one that doesn't exceed 1 as it is."""
    g = _grid(spark, sf).select("y", "x", F.floor(F.col("z") / 2000.0).cast("double").alias("bytes"), (F.col("z") > 250000).cast("double").alias("flags"))
    return st.unit_mask(st.unit_mask(g, "bytes", "a"), "flags", "b").select("y", "x", r6("a").alias("a"), "b")


def sobel_edges(spark, sf):
    """Sobel magnitude of z."""
    return st.sobel(_grid(spark, sf), "z").select("y", "x", F.round("mag", 3).alias("mag"))


def open_close(spark, sf):
    """A mask opened and closed by a cross."""
    g = _grid(spark, sf).select("y", "x", (F.col("z") > 150000).alias("m"))
    return st.open_close(g, "m")


def half_pixel(spark, sf):
    """Half-pixel shift."""
    return st.half_shift(_grid(spark, sf), "z").select("y", "x", F.round("v", 4).alias("v"))


def domain_warp(spark, sf):
    """z gathered through a warp of strength 8."""
    n = noise.value_noise(F.col("x"), F.col("y"), 16, 42)
    return st.gather(_grid(spark, sf), "z", (n - 0.5) * 8.0, (n - 0.5) * 8.0).select("y", "x", F.col("v").alias("z"))


def noise_hash(spark, sf):
    """Lattice hash of the cells, around the origin."""
    return _grid(spark, sf).select("y", "x", r6(noise.hash_lattice(F.col("x") - 50, F.col("y") - 50, 42)).alias("h"))


def value_noise(spark, sf):
    """Value noise of a lattice of 12 cells."""
    return _grid(spark, sf).select("y", "x", r6(noise.value_noise(F.col("x"), F.col("y"), 12, 7)).alias("n"))


def fbm(spark, sf):
    """Three octaves of value noise."""
    return _grid(spark, sf).select("y", "x", r6(noise.fbm(F.col("x"), F.col("y"), 3, 32, seed=5)).alias("n"))


def fbm_offset(spark, sf):
    """Four octaves of another fall and spread, seeded by a tile's origin at (3, 5)."""
    return _grid(spark, sf).select("y", "x", r6(noise.fbm(F.col("x"), F.col("y"), 4, 32, gain=0.6, lacunarity=2.5, seed=noise.offset_seed(142, 3, 5))).alias("n"))


def contours_relative(spark, sf):
    """Contours of the relief stretched to a thousand metres, 8 m at 1 m pixels, of a constant width."""
    m = F.pmod(F.col("n") * 1000.0, F.lit(8.0))
    return _norm(spark, sf).select("y", "x", ((m < 1.2) | (m > 8.0 - 1.2)).alias("line"))


def ridged(spark, sf):
    """Ridged noise stretched to 0..1."""
    g = _grid(spark, sf).withColumn("v", noise.ridge(F.col("x"), F.col("y"), 2, 24, 3))
    return st.stretch(g, F.col("v"), "n").select("y", "x", F.round("n", 5).alias("n"))


def dunes(spark, sf):
    """Dunes stretched to 0..1."""
    g = _grid(spark, sf).withColumn("v", noise.dune(F.col("x"), F.col("y"), 24, 25.0, 5))
    return st.stretch(g, F.col("v"), "n").select("y", "x", F.round("n", 5).alias("n"))


def field_attributes(spark, sf):
    """Hashed attributes of the parts taken as parcels."""
    a, b = noise.field_attributes(F.col("p_partkey"))
    return t.read(spark, sf, "part").select("p_partkey", r6(a).alias("greenness"), r6(b).alias("variation"))


def rivers_fast(spark, sf):
    """River and flood cells of a relief by a curvature score, smoothed."""
    g = st.relief_of(st.stretch(relief(spark, sf), F.col("z"), "n").select("y", "x", "n"), "n")
    score = (1.0 - F.col("n")) * 0.7 + F.col("lap") * 0.6 - F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) * 0.4
    s = staged(st.stretch(g, score, "s", eps=1e-6).select("y", "x", "n", F.round("s", 9).alias("s")))
    high, low = quantiles(s, "s", [0.995, 0.985])
    masks = s.select("y", "x", (F.col("s") >= high).cast("double").alias("river"), ((F.col("s") > low) & (F.col("n") < 0.55)).cast("double").alias("flood"))
    soft = st.blurs(masks, {"river": 2, "flood": 3})
    return soft.select("y", "x", (F.col("river") > 0.30).alias("river"), (F.col("flood") > 0.25).alias("flood"), r6("river").alias("river_level"), r6("flood").alias("flood_level"))


def moisture(spark, sf):
    """Wetness: rivers blurred six times and the stretched windward slope."""
    n = _norm(spark, sf).select("y", "x", "n", (F.col("n") < 0.2).alias("river"))
    return palettes.moisture(n).select("y", "x", r6("moisture").alias("moisture"), ((F.col("n") < 0.15) | (F.col("moisture") > 0.4)).alias("water"))


QUERIES = {
    f.__name__: f
    for f in (minmax_norm, quantile_mask, block_mean, block_any, area_resize, nearest_resize, water_share, gradient, slope, hillshade, laplacian, blur_k2, blur_k3, field_edges, field_edges_soft, map_water_soft, fbm_signed, unit_masks, sobel_edges, open_close, half_pixel, domain_warp, noise_hash, value_noise, fbm, fbm_offset, contours_relative, ridged, dunes, field_attributes, rivers_fast, moisture)
}

_G = t.ctes("grid")
_r = lambda v, n=6: f"(round({v}, {n}) + 0e0)"
_HW = "s AS (SELECT max(y)+1 AS h, max(x)+1 AS w FROM grid)"
_NORM = "nn AS (SELECT y, x, (z-min(z) OVER ())/(max(z) OVER ()-min(z) OVER ()) AS n FROM grid)"


def _grad_sql(source, v, name="gr", px="1e0"):
    def one(o, p):
        w = f"OVER (PARTITION BY {p} ORDER BY {o})"
        return f"coalesce((coalesce(lead({v}) {w},{v})-coalesce(lag({v}) {w},{v}))/(CASE WHEN lag({v}) {w} IS NOT NULL AND lead({v}) {w} IS NOT NULL THEN 2e0 WHEN lag({v}) {w} IS NOT NULL OR lead({v}) {w} IS NOT NULL THEN 1e0 END),0e0)/{px}"

    return f"{name} AS (SELECT *, {one('y', 'x')} AS gy, {one('x', 'y')} AS gx FROM {source})"


def _blur_sql(source, v, k, name="bl"):
    w = st.folded(k)
    half, tot = len(w) // 2, sum(w)
    vals = ",".join(f"({d},{x!r}e0)" for d, x in zip(range(-half, half + 1), w))
    return f"{name}w(d,wgt) AS (VALUES {vals}), {name}1 AS (SELECT ((y+d)%h+h)%h AS y, x, sum({v}*wgt)/{tot!r}e0 AS v FROM {source}, {name}w, s GROUP BY 1,2), {name} AS (SELECT y, ((x+d)%w+w)%w AS x, sum(v*wgt)/{tot!r}e0 AS v FROM {name}1, {name}w, s GROUP BY 1,2)"


def _lap_sql(source, v, name="lp"):
    return f"st5(da,db,wgt) AS (VALUES (1,0,1e0),(-1,0,1e0),(0,1,1e0),(0,-1,1e0),(0,0,-4e0)), {name} AS (SELECT CAST((y+da+h)%h AS INT) AS y, CAST((x+db+w)%w AS INT) AS x, abs(sum({v}*wgt)) AS lap FROM {source}, s, st5 GROUP BY 1,2)"


def _vn_sql(x, y, grid, seed):
    gx, gy = f"({x}/CAST({grid} AS DOUBLE))", f"({y}/CAST({grid} AS DOUBLE))"
    fx, fy = f"({gx}-floor({gx}))", f"({gy}-floor({gy}))"
    e = lambda q: f"({q}*{q}*(3e0-2e0*{q}))"
    n = lambda a, b: noise.hash_sql(f"(CAST(floor({gx}) AS BIGINT)+{a})", f"(CAST(floor({gy}) AS BIGINT)+{b})", seed)
    return f"(({n(0, 0)}*(1e0-{e(fx)})+{n(1, 0)}*{e(fx)})*(1e0-{e(fy)})+({n(0, 1)}*(1e0-{e(fx)})+{n(1, 1)}*{e(fx)})*{e(fy)})"


def _fbm_sql(octaves, base, seed, gain=0.5, lacunarity=2.0):
    amp, freq, tot, parts = 1.0, 1.0, 0.0, []
    for i in range(octaves):
        parts.append(f"{amp!r}e0*{_vn_sql('x', 'y', max(2, int(base / freq)), seed + 1000 * i)}")
        tot, amp, freq = tot + amp, amp * gain, freq * lacunarity
    return f"(({'+'.join(parts)})/{tot!r}e0)"


_RELIEF = f"rl AS (SELECT y, x, 6e2*{_fbm_sql(4, 48, 5)}+z/1e6 AS z FROM grid), nn AS (SELECT y, x, (z-min(z) OVER ())/(max(z) OVER ()-min(z) OVER ()) AS n FROM rl)"
_STR = "SELECT y, x, (round(CASE WHEN max(v) OVER ()-min(v) OVER ()<1e-9 THEN 0e0 ELSE (v-min(v) OVER ())/(max(v) OVER ()-min(v) OVER ()) END, 5)+0e0) AS n FROM q"
_cross = "SELECT g.y, g.x, {agg}(n.m) AS m FROM {src} g JOIN (SELECT CAST(y+da AS INT) AS y, CAST(x+db AS INT) AS x, m FROM {src}, c5) n ON n.y=g.y AND n.x=g.x GROUP BY 1,2"
_refl = lambda v, n: f"(CASE WHEN {v}<0 THEN -({v}) WHEN {v}>={n} THEN 2*{n}-2-({v}) ELSE {v} END)"
SQL = {
    "minmax_norm": f"{_G}, m AS (SELECT min(z) AS lo, max(z) AS hi FROM grid) SELECT y, x, {_r('(z-lo)/(hi-lo)')} AS a, {_r('(z-lo)/(hi-lo+1e-6)')} AS b, CAST(trunc((z-lo)/(hi-lo)*65535) AS INT) AS visual FROM grid, m",
    "quantile_mask": f"{_G}, m AS (SELECT quantile_cont(z, 0.985) AS thr FROM grid) SELECT y, x, z>=thr AS top, {_r('thr')} AS thr FROM grid, m",
    "block_mean": f"{_G}, {_HW} SELECT CAST(y//5 AS INT) AS by, CAST(x//5 AS INT) AS bx, {_r('avg(z)')} AS mean FROM grid, s WHERE y<h//5*5 AND x<w//5*5 GROUP BY 1,2",
    "block_any": f"{_G}, {_HW} SELECT CAST(y//5 AS INT) AS by, CAST(x//5 AS INT) AS bx, bool_or(z>490000) AS hit, {_r('avg(CAST(z>400000 AS DOUBLE))')} AS share FROM grid, s WHERE y<h//5*5 AND x<w//5*5 GROUP BY 1,2",
    "area_resize": f"{_G}, {_HW}, ty AS (SELECT CAST(range AS INT) AS ty FROM range(7)), tx AS (SELECT CAST(range AS INT) AS tx FROM range(30)), o AS (SELECT ty, tx, z, (least((y+1)*7e0/h, ty+1)-greatest(y*7e0/h, ty))*(least((x+1)*30e0/w, tx+1)-greatest(x*30e0/w, tx)) AS a FROM grid, s, ty, tx WHERE least((y+1)*7e0/h, ty+1)-greatest(y*7e0/h, ty)>1e-12 AND least((x+1)*30e0/w, tx+1)-greatest(x*30e0/w, tx)>1e-12) SELECT ty, tx, {_r('sum(a*z)/sum(a)', 4)} AS v FROM o GROUP BY 1,2",
    "nearest_resize": f"{_G}, {_HW}, q AS (SELECT CAST(a.range AS INT) AS ty, CAST(b.range AS INT) AS tx FROM range(40) a, range(37) b) SELECT ty, tx, z>200000 AS m FROM q, s, grid WHERE y=CAST(floor(ty*h/40e0) AS INT) AND x=CAST(floor(tx*w/37e0) AS INT)",
    "water_share": f"{_G} SELECT CAST(count(*) FILTER (WHERE z<100000) AS BIGINT) AS cells, {_r('avg(CAST(z<100000 AS DOUBLE))')} AS share FROM grid",
    "gradient": f"{_G}, {_grad_sql('grid', 'z', px='1e1')} SELECT y, x, {_r('gy')} AS gy, {_r('gx')} AS gx FROM gr",
    "slope": f"{_G}, {_grad_sql('grid', 'z', px='1e1')}, q AS (SELECT y, x, sqrt(gx*gx+gy*gy) AS v FROM gr) SELECT y, x, {_r('(v-min(v) OVER ())/(max(v) OVER ()-min(v) OVER ())')} AS slope FROM q",
    "hillshade": f"{_G}, {_grad_sql('grid', 'z', px='1e5')} SELECT y, x, {_r('least(greatest(sin(radians(45e0))*cos(atan(sqrt(gx*gx+gy*gy)))+cos(radians(45e0))*sin(atan(sqrt(gx*gx+gy*gy)))*cos(radians(315e0)-atan2(-gx,gy)),0e0),1e0)')} AS shade FROM gr",
    "laplacian": f"{_G}, {_HW}, {_lap_sql('grid', 'z')} SELECT y, x, {_r('lap', 4)} AS lap FROM lp",
    "blur_k2": f"{_G}, {_HW}, mm AS (SELECT y, x, CAST(z>300000 AS DOUBLE) AS m FROM grid), {_blur_sql('mm', 'm', 2)} SELECT y, x, {_r('v')} AS v, v>3e-1 AS m FROM bl",
    "blur_k3": f"{_G}, {_HW}, {_blur_sql('grid', 'z', 3)} SELECT y, x, {_r('v', 4)} AS v FROM bl",
    "field_edges": f"{_G}, f AS (SELECT y, x, CAST(floor((y+x/3e0)/7)*10000+floor(x/7e0) AS INT) AS f FROM grid) SELECT a.y, a.x, coalesce(a.f<>s.f,FALSE) OR coalesce(a.f<>e.f,FALSE) OR coalesce(a.f<>se.f,FALSE) OR coalesce(a.f<>sw.f,FALSE) AS edge FROM f a LEFT JOIN f s ON s.y=a.y+1 AND s.x=a.x LEFT JOIN f e ON e.y=a.y AND e.x=a.x+1 LEFT JOIN f se ON se.y=a.y+1 AND se.x=a.x+1 LEFT JOIN f sw ON sw.y=a.y+1 AND sw.x=a.x-1",
    "fbm_signed": f"{_G} SELECT y, x, {_r(f'2e0*{_fbm_sql(3, 48, 9)}-1e0')} AS n FROM grid",
    "unit_masks": f"{_G}, q AS (SELECT y, x, floor(z/2e3) AS a, CAST(z>250000 AS DOUBLE) AS b FROM grid) SELECT y, x, {_r('CASE WHEN max(a) OVER ()>1 THEN a/max(a) OVER () ELSE a END')} AS a, CASE WHEN max(b) OVER ()>1 THEN b/max(b) OVER () ELSE b END AS b FROM q",
    "sobel_edges": f"{_G}, {_HW}, o(a,b,u,v) AS (VALUES (-1,-1,-1e0,-1e0),(-1,0,0e0,-2e0),(-1,1,1e0,-1e0),(0,-1,-2e0,0e0),(0,0,0e0,0e0),(0,1,2e0,0e0),(1,-1,-1e0,1e0),(1,0,0e0,2e0),(1,1,1e0,1e0)), q AS (SELECT y, x, {_refl('(y+a)', 'h')} AS ny, {_refl('(x+b)', 'w')} AS nx, u, v FROM grid, s, o), z2 AS (SELECT q.y, q.x, sum(g.z*u) AS gx, sum(g.z*v) AS gy FROM q JOIN grid g ON g.y=q.ny AND g.x=q.nx GROUP BY 1,2) SELECT y, x, {_r('sqrt(gx*gx+gy*gy)', 3)} AS mag FROM z2",
    "open_close": f"{_G}, c5(da,db) AS (VALUES (1,0),(-1,0),(0,1),(0,-1),(0,0)), m0 AS (SELECT y, x, z>150000 AS m FROM grid), " + ", ".join(f"m{i + 1} AS ({_cross.format(agg=a, src=f'm{i}')})" for i, a in enumerate(("bool_and", "bool_or", "bool_or", "bool_and"))) + " SELECT y, x, m FROM m4",
    "half_pixel": f"{_G}, {_HW}, q AS (SELECT g.y, g.x, g.z, greatest(g.x-1,0) AS px, greatest(g.y-1,0) AS py FROM grid g) SELECT q.y, q.x, {_r('(q.z+a.z+b.z+c.z)/4e0', 4)} AS v FROM q JOIN grid a ON a.y=q.y AND a.x=q.px JOIN grid b ON b.y=q.py AND b.x=q.x JOIN grid c ON c.y=q.py AND c.x=q.px",
    "domain_warp": f"{_G}, {_HW}, q AS (SELECT y, x, {_vn_sql('x', 'y', 16, 42)} AS n FROM grid), p AS (SELECT y, x, CAST(least(greatest(round_even(y+(n-5e-1)*8e0,0),0),h-1) AS INT) AS sy, CAST(least(greatest(round_even(x+(n-5e-1)*8e0,0),0),w-1) AS INT) AS sx FROM q, s) SELECT p.y, p.x, g.z FROM p JOIN grid g ON g.y=p.sy AND g.x=p.sx",
    "noise_hash": f"{_G} SELECT y, x, {_r(noise.hash_sql('x-50', 'y-50', 42))} AS h FROM grid",
    "value_noise": f"{_G} SELECT y, x, {_r(_vn_sql('x', 'y', 12, 7))} AS n FROM grid",
    "fbm": f"{_G} SELECT y, x, {_r(_fbm_sql(3, 32, 5))} AS n FROM grid",
    "fbm_offset": f"{_G} SELECT y, x, {_r(_fbm_sql(4, 32, 142 + 3005, 0.6, 2.5))} AS n FROM grid",
    "contours_relative": f"{_G}, {_NORM} SELECT y, x, (n*1e3)%8e0<12e-1 OR (n*1e3)%8e0>8e0-12e-1 AS line FROM nn",
    "ridged": f"{_G}, q AS (SELECT y, x, 6e-1*(1e0-abs(2e0*{_fbm_sql(2, 24, 3)}-1e0))+4e-1*(1e0-abs(2e0*{_fbm_sql(4, 12, 102)}-1e0)) AS v FROM grid) {_STR}",
    "dunes": f"{_G}, q AS (SELECT y, x, (cos((x*cos(radians(25e0))+y*sin(radians(25e0)))/(24*6e-1)+{_vn_sql('x', 'y', 24, 5)}*3.14159e0)+1e0)*5e-1 AS v FROM grid) {_STR}",
    "field_attributes": f"WITH h AS (SELECT p_partkey, (p_partkey*2654435761)%2147483648 AS h FROM part) SELECT p_partkey, {_r('(h%1000)/1000e0')} AS greenness, {_r('((h//1000)%1000)/1000e0')} AS variation FROM h",
    "rivers_fast": f"{_G}, {_HW}, {_RELIEF}, {_grad_sql('nn', 'n')}, {_lap_sql('nn', 'n')}, q AS (SELECT g.y, g.x, n, (1e0-n)*7e-1+lap*6e-1-sqrt(gx*gx+gy*gy)*4e-1 AS v FROM gr g JOIN lp ON lp.y=g.y AND lp.x=g.x), p AS (SELECT y, x, n, round((v-min(v) OVER ())/(max(v) OVER ()-min(v) OVER ()+1e-6),9) AS sc FROM q), th AS (SELECT quantile_cont(sc,0.995) AS hi, quantile_cont(sc,0.985) AS lo FROM p), mk AS (SELECT y, x, CAST(sc>=hi AS DOUBLE) AS a, CAST(sc>lo AND n<55e-2 AS DOUBLE) AS b FROM p, th), {_blur_sql('mk', 'a', 2, 'ba')}, {_blur_sql('mk', 'b', 3, 'bb')} SELECT ba.y, ba.x, ba.v>3e-1 AS river, {_r('ba.v')} AS river_level, bb.v>25e-2 AS flood, {_r('bb.v')} AS flood_level FROM ba JOIN bb ON ba.y=bb.y AND ba.x=bb.x",
    "moisture": f"{_G}, {_HW}, {_NORM}, {_grad_sql('nn', 'n')}, mm AS (SELECT y, x, CAST(n<2e-1 AS DOUBLE) AS m FROM nn), {_blur_sql('mm', 'm', 6)}, u AS (SELECT y, x, n, greatest(-gx,0e0) AS up FROM gr), q AS (SELECT y, x, n, (up-min(up) OVER ())/(max(up) OVER ()-min(up) OVER ()) AS u FROM u), o AS (SELECT q.y, q.x, n, least(greatest(6e-1*v+4e-1*u,0e0),1e0) AS m FROM q JOIN bl ON bl.y=q.y AND bl.x=q.x) SELECT y, x, {_r('m')} AS moisture, n<15e-2 OR m>4e-1 AS water FROM o",
}
_soft = lambda head, source, least, name: f"{head}, {_HW}, mm AS (SELECT y, x, CAST({source[0]} AS DOUBLE) AS m FROM ({source[1]})), {_blur_sql('mm', 'm', 2)} SELECT y, x, {_r('v')} AS v, v>{least} AS {name} FROM bl"
SQL["field_edges_soft"] = _soft(*[(h, ("edge", "SELECT a.y" + q), "25e-2", "edge") for h, q in [SQL["field_edges"].split(" SELECT a.y", 1)]][0])
SQL["map_water_soft"] = _soft(t.ctes("grid", "colours"), ("((b-greatest(r,g)>12e-2) OR (b>4e-1 AND r<3e-1 AND g<4e-1) OR (b>r+2e-1 AND b>g+15e-2)) AND (r+g+b)/3e0<92e-2 AND (r+g+b)/3e0>1e-1", "SELECT * FROM colours"), "3e-1", "water")
