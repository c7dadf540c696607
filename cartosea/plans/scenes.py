"""Queries of terrain recipes, palettes, sensor tiles and thermal frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartosea.functions import colour
from cartosea.operators import city, palettes, rural, terrain
from cartosea.operators import stencil as st
from cartosea.operators.textures import octaves
from cartosea.sources import tables as t

r6 = lambda c: F.round(c, 6)


def _dem(biome):
    def query(spark, sf):
        return terrain.make_dem(t.grid(spark, sf).select("y", "x"), biome).select("y", "x", F.round("z_m", 3).alias("z_m"))

    query.__name__, query.__doc__ = f"dem_{biome}", f"Elevation of a {biome} over the grid."
    return query


def _rgb(biome):
    def query(spark, sf):
        n = st.stretch(t.grid(spark, sf), F.col("z"), "n")
        cells = n.select("y", "x", "n", (F.col("n") < 0.04).alias("river"), (F.col("n") < 0.12).alias("water"))
        return palettes.build_rgb(cells, biome, 42).select("y", "x", *[F.round(c, 5).alias(c) for c in "rgb"])

    query.__name__, query.__doc__ = f"rgb_{biome}", f"Colours of a {biome} over the grid."
    return query


def parcel_rgb(spark, sf):
    """Colours of parcels with water, hedges and tracks by remainders."""
    field = (F.floor(F.col("y") / 7) * 10000 + F.floor(F.col("x") / 7)).cast("int")
    cells = t.grid(spark, sf).select("y", "x", field.alias("f"), (F.col("z") < 50000).alias("w"), (F.col("x") % 7 == 0).alias("h"), (F.col("y") % 21 == 0).alias("tr"))
    return terrain.parcel_colours(cells, "f", "w", "h", "tr").select("y", "x", *[r6(c).alias(c) for c in "rgb"])


def shaded_rgb(spark, sf):
    """Colours lit by the hillshade of the grid."""
    shade = st.gradient(t.grid(spark, sf), "z", 100000.0).select("y", "x", st.hillshade(F.col("gy"), F.col("gx"), 315.0, 60.0).alias("s"))
    return t.colours(spark, sf).join(shade, ["y", "x"]).select("y", "x", *[r6(colour.lit(F.col(c), F.col("s"), F.lit(True))).alias(c) for c in "rgb"])


def city_grid(spark, sf):
    """Streets and heights."""
    road, height = terrain.city_blocks(F.col("x"), F.col("y"))
    return t.grid(spark, sf).select("y", "x", road.alias("road"), height.alias("height"))


def city_scene(spark, sf):
    """Streets turned by 42 degrees, parks, heights and reflectances."""
    return city.city_scene(t.grid(spark, sf)).select("y", "x", "road", "park", F.round("height", 4).alias("height"), *[r6(c).alias(c) for c in "rgb"])


def forest_scene(spark, sf):
    """Canopy and reflectances of a forest."""
    return rural.forest_scene(t.grid(spark, sf)).select("y", "x", F.round("canopy", 4).alias("canopy"), *[r6(c).alias(c) for c in "rgb"])


QUERIES = {f.__name__: f for f in (*map(_dem, terrain.reliefs()), *map(_rgb, (*palettes.PALETTES, "city", "forest", "farm")), parcel_rgb, shaded_rgb, city_grid, city_scene, forest_scene)}


def _parcels_sql():
    from cartosea.functions import noise  # noqa: F401

    case = lambda i: "CASE k*3+s " + " ".join(f"WHEN {k * 3 + s} THEN {terrain.PARCELS[k][s][i]!r}e0" for k in range(3) for s in range(3)) + " END"
    band = lambda i, c: f"(round(least(greatest(CASE WHEN tr THEN {terrain.TRACK[i]!r}e0 WHEN h THEN {terrain.HEDGE[i]!r}e0 WHEN w THEN {terrain.WATER[i]!r}e0 ELSE {case(i)} END*88e-2,0e0),1e0),6)+0e0) AS {c}"
    return (
        f"{t.ctes('grid')}, c AS (SELECT y, x, CAST((y//7)*10000+x//7 AS BIGINT) AS f, z<50000 AS w, x%7=0 AS h, y%21=0 AS tr FROM grid), a AS (SELECT *, ((f*2654435761)%2147483648) AS hh FROM c), "
        f"b AS (SELECT *, CASE WHEN (hh%1000)/1e3<5e-1 THEN 0 WHEN (hh%1000)/1e3<75e-2 THEN 1 ELSE 2 END AS k, CAST(floor(((hh//1000)%1000)/1e3*3e0) AS INT)%3 AS s FROM a) SELECT y, x, {', '.join(band(i, c) for i, c in enumerate('rgb'))} FROM b"
    )


def _city_sql():
    from cartosea.functions.noise import hash_sql

    h = hash_sql("(x//24)", "(y//24)", 77)
    return f"{t.ctes('grid')} SELECT y, x, x%24<6 OR y%24<6 AS road, CASE WHEN x%24<6 OR y%24<6 THEN 0e0 ELSE floor({h}*8e0)*3e0+6e0 END AS height FROM grid"


def _shaded_sql():
    from cartosea.plans.raster import _grad_sql

    s = "least(greatest(sin(radians(60e0))*cos(atan(sqrt(gx*gx+gy*gy)))+cos(radians(60e0))*sin(atan(sqrt(gx*gx+gy*gy)))*cos(radians(315e0)-atan2(-gx,gy)),0e0),1e0)"
    return f"{t.ctes('grid', 'colours')}, {_grad_sql('grid', 'z', px='1e5')} SELECT c.y, c.x, " + ", ".join(f"(round(least(greatest({c}*(82e-2+28e-2*{s}),0e0),1e0),6)+0e0) AS {c}" for c in "rgb") + " FROM colours c JOIN gr ON gr.y=c.y AND gr.x=c.x"


def _textures_sql(textures, source, seed=42):
    from cartosea.plans import raster

    asks = ",".join(f"('{t_}',{g},{s},{w!r}e0)" for t_, g, s, w in octaves(textures, seed))
    each = ", ".join(f"sum(v) FILTER (WHERE t='{name}') AS {name}" for name in textures)
    return f"o(t,g,sd,wt) AS (VALUES {asks}), nz AS (SELECT y, x, t, wt*{raster._vn_sql('x', 'y', 'g', 'sd')} AS v FROM {source}, o), tx AS (SELECT y, x, {each} FROM nz GROUP BY 1,2)"


def _dem_sql(biome):
    from cartosea.plans import raster

    r = terrain.reliefs()[biome]
    unit = lambda v, eps="": f"({v}-min({v}) OVER ())/(max({v}) OVER ()-min({v}) OVER (){eps})"
    bent = lambda source, v, strength, name: f"{name} AS (SELECT p.y, p.x, q.{v} AS v FROM (SELECT y, x, CAST(least(greatest(round_even(y+(bend_y-5e-1)*{strength}e0,0),0),h-1) AS INT) AS sy, CAST(least(greatest(round_even(x+(bend_x-5e-1)*{strength}e0,0),0),w-1) AS INT) AS sx FROM {source}, s) p JOIN {source} q ON q.y=p.sy AND q.x=p.sx)"
    ctes = [raster._HW, _textures_sql(r.textures | terrain.warp_textures((r.warp or terrain.BASIN_WARP)[1]), "grid")]
    raw = ", ".join(f"CAST({terrain.ridge_of(n)} AS DOUBLE) AS {n}_r" for n in r.ridges)
    dune = f", (cos((x*cos(radians(25e0))+y*sin(radians(25e0)))/(24*6e-1)+{raster._vn_sql('x', 'y', 24, 47)}*3.14159e0)+1e0)*5e-1 AS dune_r" if biome == "desert" else ""
    ctes.append(f"l0 AS (SELECT *{', ' * bool(raw)}{raw}{dune} FROM tx)")
    ctes.append("l1 AS (SELECT *" + "".join(f", {unit(f'{n}_r')} AS {n}" for n in (*r.ridges, *(["dune"] if dune else []))) + " FROM l0)")
    ctes.append(f"l2 AS (SELECT *, CAST({r.field} AS DOUBLE) AS v FROM l1)")
    last = "l2"
    if r.stretched_first:
        ctes.append(f"l3 AS (SELECT * EXCLUDE (v), {unit('v', '+1e-6')} AS v FROM l2)")
        last = "l3"
    if r.warp:
        ctes.append(bent(last, "v", r.warp[0], "l4"))
        last = "l4"
    if biome == "city":
        ctes.append(f"b0 AS (SELECT l2.*, CAST({terrain.BASIN} AS DOUBLE) AS br FROM l2, s), b1 AS (SELECT *, {unit('br')} AS basin FROM b0), {bent('b1', 'basin', 14, 'b2')}, l5 AS (SELECT l2.y, l2.x, CASE WHEN b2.v>4e-1 THEN l2.v*25e-2+14e-2 ELSE l2.v END AS v FROM l2 JOIN b2 ON b2.y=l2.y AND b2.x=l2.x)")
        last = "l5"
    value = "v" if r.stretched_first else unit("v")
    return f"{t.ctes('grid')}, {', '.join(ctes)} SELECT y, x, (round({r.low!r}e0+{r.span!r}e0*{value},3)+0e0) AS z_m FROM {last}"


def _rgb_sql(biome):
    from cartosea.plans import raster

    p = palettes.PALETTES[biome]
    ctes = [raster._HW, raster._NORM, "c AS (SELECT y, x, n, n<4e-2 AS river, n<12e-2 AS water, CAST(n<4e-2 AS DOUBLE) AS m FROM nn)", raster._blur_sql("c", "m", 6, "wt6"), raster._grad_sql("nn", "n")]
    ctes.append("mo AS (SELECT c.*, gy, gx, least(greatest(6e-1*v+4e-1*(up-min(up) OVER ())/(max(up) OVER ()-min(up) OVER ()),0e0),1e0) AS moisture FROM c JOIN wt6 ON wt6.y=c.y AND wt6.x=c.x JOIN (SELECT y, x, gy, gx, greatest(-gx,0e0) AS up FROM gr) u ON u.y=c.y AND u.x=c.x)")
    ctes.append(_textures_sql(p.textures, "nn"))
    ctes.append("tm AS (SELECT mo.*, tx.* EXCLUDE (y, x) FROM mo JOIN tx ON tx.y=mo.y AND tx.x=mo.x)")
    source = "tm"
    if biome == "desert":
        phase = raster._vn_sql("x", "y", 22, 42)
        ctes.append(f"d0 AS (SELECT *, (cos((x*cos(radians(25e0))+y*sin(radians(25e0)))/(22*6e-1)+{phase}*3.14159e0)+1e0)*5e-1 AS d FROM {source}), full_ AS (SELECT *, (d-min(d) OVER ())/(max(d) OVER ()-min(d) OVER ()) AS dune FROM d0)")
    elif biome == "mountain":
        ctes += [f"md AS (SELECT y, x, CAST(grass>2e-1 AND n>4e-1 AND n<7e-1 AS DOUBLE) AS m FROM {source})", raster._blur_sql("md", "m", 2, "gz"), raster._lap_sql("nn", "n"), "q85 AS (SELECT quantile_cont(lap, 85e-2) AS sharp FROM lp)"]
        ctes.append(f"full_ AS (SELECT f.*, gz.v AS grazed, sin((f.x*cos(atan2(gy,gx))+f.y*sin(atan2(gy,gx)))/8e0+ridge*4e0)*4e-2 AS streak, 4e-1*coarse+35e-2*medium+25e-2*fine AS tex, wood>1e-1 AND moisture>4e-1 AS forest, lap>sharp AND sqrt(gx*gx+gy*gy)<15e-2 AS road FROM {source} f JOIN gz ON gz.y=f.y AND gz.x=f.x JOIN lp ON lp.y=f.y AND lp.x=f.x, q85)")
    elif biome == "water":
        ctes.append(f"full_ AS (SELECT *, 3e-2*(sin(x/2e1+42e0)*5e-1+5e-1) AS wave FROM {source})")
    else:
        ctes.append(f"full_ AS (SELECT *, {palettes.green_of(biome)} AS green FROM {source})")
    clip = lambda v: f"least(greatest({v},0e0),1e0)"
    bands = [clip(f"CAST({palettes.case_of(p, i)} AS DOUBLE)") for i in range(3)]
    if p.hazy:
        bands = [clip(f"{v}+least(greatest((n-7e-1)*4e-1,0e0),6e-2)*{h!r}e0") for v, h in zip(bands, palettes.HAZE)]
    return f"{t.ctes('grid')}, {', '.join(ctes)} SELECT y, x, {', '.join(f'(round({v},5)+0e0) AS {c}' for c, v in zip('rgb', bands))} FROM full_"


def _city_rgb_sql():
    from cartosea.plans import raster

    names = city.textures()
    unit = ", ".join(f"({c}-min({c}) OVER ())/(max({c}) OVER ()-min({c}) OVER ()) AS {c}" for c in city.STRETCHED)
    lines = [f"l{a} AS (SELECT DISTINCT {a}+d AS {a} FROM (SELECT {a}+CAST(trunc((pattern-5e-1)*3e1) AS INT) AS {a}, {n} AS n FROM tu, s WHERE {a}%100=0 AND {b}={m}//2) q, (SELECT unnest([-2,-1,0,1,2]) AS d) WHERE {a}>=0 AND {a}<n)" for a, b, n, m in (("y", "x", "h", "w"), ("x", "y", "w", "h"))]
    join = "f AS (SELECT tu.*, n, n<12e-2 AS water, (ly.y IS NOT NULL OR lx.x IS NOT NULL) AND n>=12e-2 AND park<=75e-2 AS road FROM tu JOIN nn ON nn.y=tu.y AND nn.x=tu.x LEFT JOIN ly ON ly.y=tu.y LEFT JOIN lx ON lx.x=tu.x)"
    clip = lambda v: f"least(greatest({v},0e0),1e0)"
    bands = ", ".join(f"(round({clip(f'{clip(f'CAST({city.band_of(i)} AS DOUBLE)')}+least(greatest((n-7e-1)*4e-1,0e0),6e-2)*{h!r}e0')},5)+0e0) AS {c}" for i, (c, h) in enumerate(zip("rgb", palettes.HAZE)))
    return f"{t.ctes('grid')}, {raster._HW}, {raster._NORM}, {_textures_sql(names, 'nn')}, tu AS (SELECT y, x, park, {unit} FROM tx), {', '.join(lines)}, {join} SELECT y, x, {bands} FROM f"


def _scene_sql(seed=42):
    from cartosea.functions import noise
    from cartosea.plans import raster

    n = ", ".join(f"{raster._fbm_sql(o, size, seed + s, g)} AS {k}" for k, (o, size, s, g) in city.SCENE.items())
    mod = lambda v, m: f"((({v})%{m}+{m})%{m})"
    one, two = "x*cos(radians(42e0))+y*sin(radians(42e0))", "y*cos(radians(42e0))-x*sin(radians(42e0))"
    road = f"({mod(one, '80e0')}<8e0 OR {mod(two, '104e0')}<8e0 OR (lane>85e-2 AND {noise.hash_sql('x', 'y', seed + 51)}<2e-2))"
    band = lambda p, r, hot, cold, c: f"(round(least(greatest(CASE WHEN park THEN {p} WHEN road THEN {r} ELSE (5e-1+2e-1*roof)*(CASE WHEN stuff>7e-1 THEN {hot} ELSE {cold} END) END,0e0),1e0),6)+0e0) AS {c}"
    return f"{t.ctes('grid')}, q AS (SELECT y, x, {n} FROM grid), r AS (SELECT *, {road} AS road FROM q), p AS (SELECT *, green>825e-3 AND NOT road AS park FROM r) SELECT y, x, road, park, (round(CASE WHEN road OR park THEN 0e0 ELSE 5e0+3e1*floor(tall*8e0)/8e0 END,4)+0e0) AS height, {band('22e-2', '18e-2', '105e-2', '98e-2', 'r')}, {band('38e-2', '18e-2', '95e-2', '1e0', 'g')}, {band('2e-1', '19e-2', '85e-2', '102e-2', 'b')} FROM p"


def _rural_sql():
    from cartosea.plans import raster

    size = "sqrt(gx*gx+gy*gy)"
    at = lambda c, f: f"floor(({c}+move_{c}*35e0+{f}(atan2(gy,gx))*(20e0+{size}*30e0))/18e0)"
    fields = f"t0 AS (SELECT gr.*, tx.* EXCLUDE (y, x) FROM gr JOIN tx ON tx.y=gr.y AND tx.x=gr.x), tm AS (SELECT *, n<12e-2 AS water, CAST({at('x', 'cos')}*10000+{at('y', 'sin')} AS INT) AS f FROM t0)"
    edge = "eg AS (SELECT a.*, coalesce(a.f<>s.f,FALSE) OR coalesce(a.f<>e.f,FALSE) OR coalesce(a.f<>se.f,FALSE) OR coalesce(a.f<>sw.f,FALSE) AS edge FROM tm a LEFT JOIN tm s ON s.y=a.y+1 AND s.x=a.x LEFT JOIN tm e ON e.y=a.y AND e.x=a.x+1 LEFT JOIN tm se ON se.y=a.y+1 AND se.x=a.x+1 LEFT JOIN tm sw ON sw.y=a.y+1 AND sw.x=a.x-1)"
    own = f"h AS (SELECT *, ((CAST(f AS BIGINT)*2654435761)%2147483648+2147483648)%2147483648 AS hh FROM eg), v AS (SELECT *, (hh%1000)/1e3 AS green, ((hh//1000)%1000)/1e3 AS vary FROM h), k AS (SELECT *, CASE WHEN green<5e-1 THEN 0 WHEN green<75e-2 THEN 1 ELSE 2 END AS k, CAST(floor(vary*3e0) AS INT)%3 AS s, NOT water AND ((edge AND vary>88e-2 AND (1e0-{size})*vary>3e-1) OR ((1e0-{size})*vary>7e-1 AND vary>85e-2)) AS track FROM v)"
    lit = lambda v: f"{v!r}e0"

    def band(i, c):
        base = "CASE k*3+s " + " ".join(f"WHEN {k * 3 + s} THEN {lit(terrain.PARCELS[k][s][i])}" for k in range(3) for s in range(3)) + " END"
        grain = "CASE k " + " ".join(f"WHEN {k} THEN {lit(g[i])}" for k, g in enumerate(rural.GRAIN)) + " END"
        wet = f"(CASE WHEN vary>5e-1 THEN {lit(rural.WATERS[0][i])} ELSE {lit(rural.WATERS[1][i])} END)+4e-2*fine"
        ground = f"CASE WHEN track THEN {lit(terrain.TRACK[i])} WHEN edge AND NOT water THEN {lit(terrain.HEDGE[i])} WHEN water THEN {wet} ELSE {base}+({grain})*fine END"
        return f"(round(least(greatest(({ground}+CASE WHEN water THEN 0e0 ELSE {lit(rural.BLADES[i])}*micro END)*88e-2,0e0),1e0),5)+0e0) AS {c}"

    return f"{t.ctes('grid')}, {raster._NORM}, {raster._grad_sql('nn', 'n')}, {_textures_sql(rural.TEXTURES, 'nn')}, {fields}, {edge}, {own} SELECT y, x, {', '.join(band(i, c) for i, c in enumerate('rgb'))} FROM k"


def _forest_sql(seed=42):
    n = ", ".join(f"{_fbm(o, size, seed + s, g, la)} AS {k}" for k, (o, size, s, g, la) in rural.CANOPY.items())
    bands = ", ".join(f"(round(least(greatest({a}+{b}*c,0e0),1e0),6)+0e0) AS {k}" for (a, b), k in zip((("18e-2", "15e-2"), ("35e-2", "35e-2"), ("15e-2", "1e-1")), "rgb"))
    return f"{t.ctes('grid')}, q AS (SELECT y, x, {n} FROM grid), d AS (SELECT *, CASE WHEN 7e-1*large+3e-1*medium>35e-2 THEN 7e-1*large+3e-1*medium ELSE 0e0 END AS c FROM q) SELECT y, x, (round(c*(8e0+6e0*(2e0*medium-1e0)),4)+0e0) AS canopy, {bands} FROM d"


def _fbm(*a):
    from cartosea.plans import raster

    return raster._fbm_sql(*a)


SQL = {"rgb_forest": _rural_sql(), "rgb_farm": _rural_sql(), "forest_scene": _forest_sql(), "rgb_city": _city_rgb_sql(), "city_scene": _scene_sql(), **{f"dem_{b}": _dem_sql(b) for b in terrain.reliefs()}, **{f"rgb_{b}": _rgb_sql(b) for b in palettes.PALETTES}, "parcel_rgb": _parcels_sql(), "city_grid": _city_sql(), "shaded_rgb": _shaded_sql()}
