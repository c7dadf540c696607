"""Queries of a run's steps: map tiles, terrain kinds, parcels, pyramid levels, degraded imagery."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartosea.functions import geo, noise
from cartosea.operators import stencil as st
from cartosea.operators import world
from cartosea.operators.graph import staged
from cartosea.plans import raster
from cartosea.sources import rasters
from cartosea.sources import tables as t

r6 = lambda c: F.round(c, 6)
#: Tiles that one request may ask for.
TILE_CAP = 40


def map_tiles(spark, sf):
    """Tiles at zoom 12 of a box of 0.1 to 0.5 degrees around each supplier, in row-major order; too large ones flagged."""
    half = 0.05 + 0.05 * (F.col("id") % 5)
    p = t.points(spark, sf, "supplier", "s_suppkey").withColumn("half", half)
    e = p.select("id", geo.slippy_x(F.col("lon") - F.col("half"), 12).alias("x0"), geo.slippy_x(F.col("lon") + F.col("half"), 12).alias("x1"), geo.slippy_y(F.col("lat") + F.col("half"), 12).alias("y0"), geo.slippy_y(F.col("lat") - F.col("half"), 12).alias("y1"))
    e = e.withColumn("n", (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1))
    each = e.withColumn("ty", F.explode(F.sequence("y0", "y1"))).withColumn("tx", F.explode(F.sequence("x0", "x1")))
    return each.select("id", "tx", "ty", ((F.col("ty") - F.col("y0")) * (F.col("x1") - F.col("x0") + 1) + F.col("tx") - F.col("x0")).alias("seq"), (F.col("n") <= TILE_CAP).alias("allowed"))


def terrain_kind(spark, sf):
    """Water, coast or land by the share of 25 sampled elevations at sea level, for each nation."""
    k = F.col("n_nationkey").cast("bigint")
    s = t.read(spark, sf, "nation").select(k.alias("id"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("i"))
    elev = (F.col("id") * 7919 + F.col("i") * 104729) % 101 - (F.col("id") * 13) % 101
    share = F.avg((elev <= 1).cast("double"))
    return s.groupBy("id").agg(r6(share).alias("share"), F.when(share > 0.90, "water").when(share > 0.30, "coast").otherwise("land").alias("kind"))


def field_ids(spark, sf):
    """Parcels of 18 cells, warped along the slope and by noise."""
    g = st.gradient(t.grid(spark, sf), "z", 100000.0)
    size, bend = 18.0, (20.0 + F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) * 30.0)
    angle = F.atan2("gy", "gx")
    nx, ny = noise.value_noise(F.col("x"), F.col("y"), 40, 11), noise.value_noise(F.col("x"), F.col("y"), 40, 12)
    fx, fy = (F.floor((F.col(c) + n * 35.0 + f(angle) * bend) / size) for c, n, f in (("x", nx, F.cos), ("y", ny, F.sin)))
    return g.select("y", "x", (fx * 10000 + fy).cast("int").alias("field_id"))


def pyramid_levels(spark, sf):
    """The level five times coarser: elevation averaged, mask by any, shade and contours made anew from the coarse
    elevation."""
    g = t.grid(spark, sf)
    b = st.block(g, 5, z=F.avg("z"), water=F.bool_or(F.col("z") < 20000)).select(F.col("by").alias("y"), F.col("bx").alias("x"), "z", "water")
    h = st.gradient(b, "z", 500000.0)
    return h.select("y", "x", F.round("z", 4).alias("z"), "water", r6(st.hillshade(F.col("gy"), F.col("gx"))).alias("shade"))


def overview_levels(spark, sf):
    """Overviews of the grid by 2, 4, 8 and 16: means of prices, nearest cells of a mask."""
    g = t.grid(spark, sf).select("y", "x", "z", (F.col("z") > 250000).cast("double").alias("m"))
    mean, mask = rasters.overviews(g, "z"), rasters.overviews(g, "m", nearest=True)
    return mean.select("level", "y", "x", F.round(F.col("value") + 1e-7, 4).alias("mean")).join(mask.withColumnRenamed("value", "mask"), ["level", "y", "x"], "left")


#: Resolutions of the base-world query, from a base of 1 m.
WANTED = {"1m": 1.0, "5m": 5.0, "10m": 10.0}


def base_world(spark, sf):
    """All layers of three resolutions from one base: a relief, water and flood by price, patches of colour."""
    g = t.grid(spark, sf).select("y", "x", (F.col("z") < 20000).alias("water"), (F.col("z") < 60000).alias("flood"))
    base = staged(raster.relief(spark, sf).join(g, ["y", "x"]).join(t.patches(spark, sf), ["y", "x"]))
    return world.levels(base, 1.0, WANTED).select("resolution", "y", "x", F.round("dem", 4).alias("dem"), *[r6(c).alias(c) for c in ("slope", "hillshade", "r", "g", "b")], "water", "flood", "contours")


QUERIES = {f.__name__: f for f in (map_tiles, terrain_kind, field_ids, pyramid_levels, overview_levels, base_world)}
_X = lambda v: f"CAST(floor(({v}+180e0)/360e0*4096) AS BIGINT)"
_Y = lambda v: f"CAST(floor((1e0-asinh(tan(radians({v})))/pi())/2e0*4096) AS BIGINT)"
_G = t.ctes("grid")
_size = "sqrt(gx*gx+gy*gy)"


def _world_sql():
    shade = f"least(greatest(sin(radians(45e0))*cos(atan({_size}))+cos(radians(45e0))*sin(atan({_size}))*cos(radians(315e0)-atan2(-gx,gy)),0e0),1e0)"
    head = f"{t.ctes('grid', 'patches')}, s AS (SELECT max(y)+1 AS h, max(x)+1 AS w FROM grid), {raster._RELIEF}, base AS (SELECT rl.y, rl.x, rl.z, g.z<20000 AS water, g.z<60000 AS flood, r, p.g, b FROM rl JOIN grid g ON g.y=rl.y AND g.x=rl.x JOIN patches p ON p.y=rl.y AND p.x=rl.x)"
    parts, outs = [], []
    for name, gsd in WANTED.items():
        k = int(gsd)
        parts.append(f"b{k} AS (SELECT CAST(y//{k} AS INT) AS y, CAST(x//{k} AS INT) AS x, avg(z) AS z, bool_or(water) AS water, bool_or(flood) AS flood, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM base, s WHERE y<h//{k}*{k} AND x<w//{k}*{k} GROUP BY 1,2), {raster._grad_sql(f'b{k}', 'z', f'gr{k}', f'{gsd!r}e0')}")
        rounded = ", ".join(f"(round({c},6)+0e0) AS {c}" for c in "rgb")
        outs.append(f"SELECT '{name}' AS resolution, y, x, (round(z,4)+0e0) AS dem, (round(({_size}-min({_size}) OVER ())/(max({_size}) OVER ()-min({_size}) OVER ()),6)+0e0) AS slope, (round({shade},6)+0e0) AS hillshade, {rounded}, CAST(water AS DOUBLE) AS water, CAST(flood AS DOUBLE) AS flood, CAST(z%2e1<6e-1 OR z%2e1>194e-1 AS DOUBLE) AS contours FROM gr{k}")
    return f"{head}, {', '.join(parts)} {' UNION ALL '.join(outs)}"


SQL = {
    "base_world": _world_sql(),
    "map_tiles": f"WITH p AS (SELECT s_suppkey AS id, -122.5e0+2e-1*((s_suppkey*7919)%10007)/10007e0 AS lon, 37.5e0+2e-1*((s_suppkey*104729)%10009)/10009e0 AS lat, 5e-2+5e-2*(s_suppkey%5) AS hf FROM supplier), e AS (SELECT id, {_X('lon-hf')} AS x0, {_X('lon+hf')} AS x1, {_Y('lat+hf')} AS y0, {_Y('lat-hf')} AS y1 FROM p), y AS (SELECT *, unnest(range(y0, y1+1)) AS ty FROM e), x AS (SELECT *, unnest(range(x0, x1+1)) AS tx FROM y) SELECT id, tx, ty, (ty-y0)*(x1-x0+1)+tx-x0 AS seq, (x1-x0+1)*(y1-y0+1)<=40 AS allowed FROM x",
    "terrain_kind": "WITH s AS (SELECT CAST(n_nationkey AS BIGINT) AS id, range AS i FROM nation, range(25)), a AS (SELECT id, avg(CAST((id*7919+i*104729)%101-(id*13)%101<=1 AS DOUBLE)) AS sh FROM s GROUP BY 1) SELECT id, (round(sh,6)+0e0) AS share, CASE WHEN sh>9e-1 THEN 'water' WHEN sh>3e-1 THEN 'coast' ELSE 'land' END AS kind FROM a",
    "field_ids": f"{_G}, {raster._grad_sql('grid', 'z', px='1e5')} SELECT y, x, CAST(floor((x+{raster._vn_sql('x', 'y', 40, 11)}*35e0+cos(atan2(gy,gx))*(20e0+{_size}*30e0))/18e0)*10000+floor((y+{raster._vn_sql('x', 'y', 40, 12)}*35e0+sin(atan2(gy,gx))*(20e0+{_size}*30e0))/18e0) AS INT) AS field_id FROM gr",
    "pyramid_levels": f"{_G}, s AS (SELECT max(y)+1 AS h, max(x)+1 AS w FROM grid), b AS (SELECT CAST(y//5 AS INT) AS y, CAST(x//5 AS INT) AS x, avg(z) AS z, bool_or(z<20000) AS water FROM grid, s WHERE y<h//5*5 AND x<w//5*5 GROUP BY 1,2), {raster._grad_sql('b', 'z', px='5e5')} SELECT y, x, (round(z,4)+0e0) AS z, water, (round(least(greatest(sin(radians(45e0))*cos(atan({_size}))+cos(radians(45e0))*sin(atan({_size}))*cos(radians(315e0)-atan2(-gx,gy)),0e0),1e0),6)+0e0) AS shade FROM gr",
    "overview_levels": f"{_G}, l AS (SELECT unnest([1,2,3,4]) AS level), b AS (SELECT level, CAST(y//(1<<level) AS INT) AS y, CAST(x//(1<<level) AS INT) AS x, avg(z) AS mean FROM grid, l GROUP BY ALL), n AS (SELECT level, CAST(y//(1<<level) AS INT) AS y, CAST(x//(1<<level) AS INT) AS x, CAST(z>250000 AS DOUBLE) AS mask FROM grid, l WHERE y%(1<<level)=(1<<level)//2 AND x%(1<<level)=(1<<level)//2) SELECT b.level, b.y, b.x, (round(mean+1e-7,4)+0e0) AS mean, mask FROM b LEFT JOIN n ON n.level=b.level AND n.y=b.y AND n.x=b.x",
}
