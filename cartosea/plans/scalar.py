"""Queries of the scalar family."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartosea.functions import colour, geo
from cartosea.sources import tables as t

r6 = lambda c: F.round(c, 6)
_P, _C, _G = t.ctes("points"), t.ctes("colours"), t.ctes("grid")


def slippy_tiles(spark, sf):
    """Tiles of the points at zoom 14, and the tiles' corners."""
    p = t.points(spark, sf).withColumns({"tx": geo.slippy_x(F.col("lon"), 14), "ty": geo.slippy_y(F.col("lat"), 14)})
    return p.select("id", "tx", "ty", r6(geo.slippy_lon(F.col("tx"), 14)).alias("west"), r6(geo.slippy_lat(F.col("ty"), 14)).alias("north"))


def mercator_project(spark, sf):
    """Spherical Mercator at the points' longitudes and latitudes from pole to pole."""
    p = t.points(spark, sf).withColumn("lat", -89.0 + (F.col("id") * 104729) % 179)
    return p.select("id", F.round(geo.mercator_x(F.col("lon")), 3).alias("mx"), F.round(geo.mercator_y(F.col("lat")), 3).alias("my"), (F.abs("lat") <= geo.MERCATOR_LIMIT).alias("safe"))


def utm_zones(spark, sf):
    """UTM zones and metric systems of places all over the world."""
    k = F.col("c_custkey")
    lon, lat = (F.lit(-180.0) + (k * 7919) % 360), (F.lit(-80.0) + (k * 104729) % 160)
    p = t.read(spark, sf, "customer").select(k.alias("id"), lon.alias("lon"), lat.alias("lat"), (lon + (k % 7)).alias("east"))
    return p.select("id", geo.utm_zone(F.col("lon")).alias("zone"), geo.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"), (geo.utm_zone(F.col("lon")) != geo.utm_zone(F.col("east"))).alias("crosses"), geo.metric_crs(F.col("lon"), F.col("lat"), F.col("lon"), F.col("east")).alias("crs"))


def utm_project(spark, sf):
    """UTM coordinates of the points."""
    e, n = geo.utm_easting_northing(F.col("lon"), F.col("lat"))
    return t.points(spark, sf).select("id", F.round(e, 3).alias("easting"), F.round(n, 3).alias("northing"))


def grid_dims(spark, sf):
    """Pixels of an extent in metres at each ground resolution."""
    k = F.col("c_custkey")
    w, h = 100.0 + (k * 7919) % 5003, 100.0 + (k * 104729) % 5009
    res = spark.createDataFrame([("25cm", 0.25), ("1m", 1.0), ("10m", 10.0)], "label string, gsd double")
    return t.read(spark, sf, "customer").select(k.alias("id"), w.alias("w"), h.alias("h")).crossJoin(F.broadcast(res)).select(
        "id", "label", F.ceil(F.col("w") / F.col("gsd")).cast("bigint").alias("cols"), F.ceil(F.col("h") / F.col("gsd")).cast("bigint").alias("rows"),
        ((F.ceil(F.col("w") / F.col("gsd")) <= 12000) & (F.ceil(F.col("h") / F.col("gsd")) <= 12000)).alias("allowed"), geo.grid_px(F.lit(37.5), F.col("gsd")).alias("feature_px"),
    )


def world_dimensions(spark, sf):
    """Extents in metres of square areas around the points, in their UTM zone, and their grids at 25 cm with what is wrong."""
    lo_lat, hi_lat, lo_lon, hi_lon = geo.area_bbox(F.col("lat"), F.col("lon"), (F.col("id") % 5 + 1).cast("double"))
    low, high = geo.utm_easting_northing(lo_lon, lo_lat), geo.utm_easting_northing(hi_lon, hi_lat)
    m = t.points(spark, sf).select("id", *[F.abs(F.round(b, 3) - F.round(a, 3)).alias(n) for a, b, n in zip(low, high, ("w", "h"))])
    cols, rows, error = geo.grid_cells(F.col("w"), F.col("h"), F.lit(0.25))
    return m.select("id", F.round("w", 2).alias("width_m"), F.round("h", 2).alias("height_m"), cols.alias("cols"), rows.alias("rows"), error.alias("error"))


def base_gsd(spark, sf):
    """Finest resolution that each segment of customers asks for."""
    want = F.greatest(F.col("c_custkey") % 3, F.col("c_nationkey") % 3)
    label = F.when(want == 0, "25cm").when(want == 1, "1m").otherwise("10m")
    gsd = F.create_map(*[F.lit(x) for p in (("25cm", 0.25), ("1m", 1.0), ("10m", 10.0)) for x in p])
    return t.read(spark, sf, "customer").groupBy("c_nationkey").agg(F.min(gsd[label]).alias("gsd"))


def km_to_deg(spark, sf):
    """Five kilometres in degrees at each point."""
    return t.points(spark, sf).select("id", r6(geo.km_to_deg(F.lit(5.0), F.col("lat"))).alias("deg"), r6(geo.smoothstep((F.col("lat") - 37.5) * 5)).alias("ease"))


def point_distance(spark, sf):
    """Planar and great-circle lengths of the legs."""
    a = [F.col(c) for c in ("slon", "slat", "elon", "elat")]
    return t.legs(spark, sf).select("route_id", r6(geo.planar(*a)).alias("deg"), r6(geo.haversine_km(*a)).alias("km"))


def area_bbox(spark, sf):
    """Square areas of 1 to 5 km around the points."""
    lo_lat, hi_lat, lo_lon, hi_lon = geo.area_bbox(F.col("lat"), F.col("lon"), (F.col("id") % 5 + 1).cast("double"))
    return t.points(spark, sf).select("id", r6(lo_lat).alias("min_lat"), r6(hi_lat).alias("max_lat"), r6(lo_lon).alias("min_lon"), r6(hi_lon).alias("max_lon"))


def map_water(spark, sf):
    """Cells that look like water on a map tile, before smoothing."""
    return t.colours(spark, sf).select("y", "x", colour.is_map_water(F.col("r"), F.col("g"), F.col("b")).alias("water"))


def lit_rgb(spark, sf):
    """Colours under a shade, vegetated in even rows."""
    shade, veg = (F.col("x") / 100.0), F.col("y") % 2 == 0
    return t.colours(spark, sf).select("y", "x", *[r6(colour.lit(F.col(c), shade, veg)).alias(c) for c in "rgb"])


def isp_colour(spark, sf):
    """Sensor colours of the 1 m configuration."""
    out = colour.isp(*[F.col(c) for c in "rgb"], 1.05, 0.90, 1.05)
    return t.colours(spark, sf).select("y", "x", *[r6(v).alias(c) for v, c in zip(out, "rgb")])


def haze_colour(spark, sf):
    """Hazy colours, with the red band as noise."""
    out = colour.haze(*[F.col(c) for c in "rgb"], F.col("r"))
    return t.colours(spark, sf).select("y", "x", *[r6(v).alias(c) for v, c in zip(out, "rgb")])


def thermal_colours(spark, sf):
    """Thermal colours of the red band, as bytes cut off."""
    out = colour.thermal(F.col("r"))
    return t.colours(spark, sf).select("y", "x", *[r6(v).alias(f"t{c}") for v, c in zip(out, "rgb")])


def vessel_silhouette(spark, sf):
    """Silhouettes of the three kinds of vessel over the grid's first 100 columns, 100 pixels high."""
    g = t.grid(spark, sf).select((F.col("y") % 100).alias("y"), "x").distinct()
    return g.select("y", "x", *[colour.vessel_mask(F.col("y"), F.col("x"), 100, 100, k).alias(k) for k in ("small", "generic", "large")])


def quantised_rgb(spark, sf):
    """Bytes of the bands, rounded and cut off."""
    return t.colours(spark, sf).select("y", "x", *[colour.quantise(F.col(c)).alias(f"q{c}") for c in "rgb"], colour.truncate(F.col("r")).alias("cut"), r6((F.col("r") + F.col("g") + F.col("b")) / 3).alias("grey"))


def contour_lines(spark, sf):
    """Cells near a multiple of 500."""
    return t.grid(spark, sf).select("y", "x", colour.contour(F.col("z"), 500.0).alias("line"))


def vessel_flags(spark, sf):
    """Vessel type, suspicion and display name by route type."""
    kind = F.when(F.col("s_suppkey") % 3 == 0, "ferry").when(F.col("s_suppkey") % 3 == 1, "tss").otherwise("irregular")
    s = t.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), kind.alias("type"))
    return s.select(
        F.format_string("route_%03d", (F.col("k") + 1).cast("int")).alias("id"), "type",
        F.when(F.col("type") == "ferry", "ferry").when(F.col("type") == "tss", "cargo").otherwise("unknown").alias("vessel_type"),
        (F.col("type") == "irregular").alias("suspicious"),
        F.concat(F.initcap("type"), F.lit(" "), F.char((65 + F.col("k") % 26).cast("int")), (F.col("k") + 1).cast("string")).alias("name"),
    )


def rounded_measures(spark, sf):
    """Prices to one decimal, and clamped to a band."""
    p = F.col("p_retailprice")
    return t.read(spark, sf, "part").select("p_partkey", F.round(p, 1).alias("r1"), F.least(F.greatest(p, F.lit(920.0)), F.lit(980.0)).alias("clamped"), F.when(p > 950, p).otherwise(0.0).alias("masked"))


#: gsd up to, octaves, base scale, hillshade, optics sigma, saturation, gamma, green bias, warp, mix, sharpen
EO_BANDS = [
    (0.5, 7, 80, 0.4, 0.4, 0.95, 1.10, 1.05, 0.0, 0.05, 0.0),
    (2.0, 6, 160, 0.4, 1.0, 0.90, 1.05, 1.05, 0.0, 0.05, 0.0),
    (1e9, 5, 64, 0.5, 0.8, 0.85, 1.15, 1.08, 0.6, 0.12, 0.15),
]


def eo_config(spark, sf):
    """Sensor configuration and supersampling by ground resolution and image size."""
    p = t.read(spark, sf, "part").select("p_partkey", (F.col("p_size") / 5.0).alias("gsd"), ((F.col("p_partkey") * 7919) % 2000000).alias("px"))
    pick = lambda i: F.when(F.col("gsd") <= 0.5, F.lit(EO_BANDS[0][i])).when(F.col("gsd") <= 2, F.lit(EO_BANDS[1][i])).otherwise(F.lit(EO_BANDS[2][i]))
    ss = F.when(F.col("px") >= 1_000_000, 1).when(F.col("px") >= 300_000, 2).otherwise(4)
    ss = F.when(F.col("gsd") >= 10, 1).when((F.col("gsd") <= 2) & (F.col("px") < 600_000), F.greatest(ss, F.lit(2))).otherwise(ss)
    return p.select("p_partkey", "gsd", pick(1).alias("octaves"), pick(2).alias("base_scale"), pick(6).alias("gamma"), pick(8).alias("warp_px"), ss.alias("supersample"))


QUERIES = {f.__name__: f for f in (slippy_tiles, mercator_project, utm_zones, utm_project, grid_dims, world_dimensions, base_gsd, km_to_deg, point_distance, area_bbox, map_water, lit_rgb, isp_colour, haze_colour, thermal_colours, vessel_silhouette, quantised_rgb, contour_lines, vessel_flags, rounded_measures, eo_config)}
_clip = lambda v: f"least(greatest({v}, 0e0), 1e0)"
_r = lambda v, n=6: f"(round({v}, {n}) + 0e0)"
_world = "SELECT c_custkey AS id, -180e0+(c_custkey*7919)%360 AS lon, -80e0+(c_custkey*104729)%160 AS lat, -180e0+(c_custkey*7919)%360+(c_custkey%7) AS east FROM customer"
_zone = lambda c: f"(CAST(trunc(({c}+180e0)/6e0) AS INT)+1)"
_mix = lambda c: f"(pow({c},1.05e0)*9e-1 + (pow(r,1.05e0)+pow(g,1.05e0)+pow(b,1.05e0))/3e0*(1e0-9e-1))"
_N = (1 / 298.257223563) / (2 - 1 / 298.257223563)
_AL = (_N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3, 13 / 48 * _N**2 - 3 / 5 * _N**3, 61 / 240 * _N**3)
_K = repr(0.9996 * 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)) + "e0"
_CC = repr(2 * _N**0.5 / (1 + _N)) + "e0"


def _thermal_sql(a, b, d):
    return _r(_clip(f"CASE WHEN r<=3e-1 THEN {a} WHEN r<=6e-1 THEN {b} ELSE {d} END"))


def _vessel_sql(k):
    length, beam = 100 * colour.HULL[k][0], 100 * colour.HULL[k][1]
    sh, sw = beam * 0.4, length * 0.6
    top = 50 - beam / 2 - sh / 2
    f = lambda v: f"CAST({v!r} AS DOUBLE)"
    return f"(pow((x-50)/{f(length / 2)},2)+pow((y-50)/{f(beam / 2)},2)<=1e0 OR (x>={f(50 - sw / 2)} AND x<={f(50 + sw / 2)} AND y>={f(top - sh / 2)} AND y<={f(top + sh / 2)})) AS {k}"


SQL = {
    "slippy_tiles": f"{_P}, s AS (SELECT id, CAST(floor((lon+180e0)/360e0*16384) AS BIGINT) AS tx, CAST(floor((1e0-asinh(tan(radians(lat)))/pi())/2e0*16384) AS BIGINT) AS ty FROM points) SELECT id, tx, ty, {_r('tx/16384e0*360e0-180e0')} AS west, {_r('degrees(atan(sinh(pi()*(1e0-2e0*ty/16384e0))))')} AS north FROM s",
    "mercator_project": f"{_P}, p AS (SELECT id, lon, -89e0+(id*104729)%179 AS lat FROM points) SELECT id, {_r('6378137e0*radians(lon)', 3)} AS mx, {_r('6378137e0*ln(tan(pi()/4+radians(lat)/2))', 3)} AS my, abs(lat)<=85.0511e0 AS safe FROM p",
    "utm_zones": f"WITH w AS ({_world}) SELECT id, {_zone('lon')} AS zone, 'EPSG:'||CAST(CASE WHEN lat>=0 THEN 32600 ELSE 32700 END+{_zone('lon')} AS VARCHAR) AS epsg, {_zone('lon')}<>{_zone('east')} AS crosses, CASE WHEN {_zone('lon')}<>{_zone('east')} THEN 'EPSG:3857' ELSE 'EPSG:'||CAST(CASE WHEN lat>=0 THEN 32600 ELSE 32700 END+{_zone('lon')} AS VARCHAR) END AS crs FROM w",
    "utm_project": f"{_P}, a AS (SELECT id, lat, sinh(atanh(sin(radians(lat)))-{_CC}*atanh({_CC}*sin(radians(lat)))) AS t, radians(lon-({_zone('lon')}*6-183)) AS dl FROM points), b AS (SELECT id, lat, atan2(t, cos(dl)) AS xi, atanh(sin(dl)/sqrt(1+t*t)) AS eta FROM a) SELECT id, "
    + _r(f"5e5+{_K}*(eta+" + "+".join(f"({a!r})*cos({2 * j}*xi)*sinh({2 * j}*eta)" for j, a in enumerate(_AL, 1)) + ")", 3)
    + " AS easting, "
    + _r(f"{_K}*(xi+" + "+".join(f"({a!r})*sin({2 * j}*xi)*cosh({2 * j}*eta)" for j, a in enumerate(_AL, 1)) + ")", 3)
    + " AS northing FROM b",
    "grid_dims": "WITH c AS (SELECT c_custkey AS id, 1e2+(c_custkey*7919)%5003 AS w, 1e2+(c_custkey*104729)%5009 AS h FROM customer), r(label,gsd) AS (VALUES ('25cm',25e-2),('1m',1e0),('10m',1e1)) SELECT id, label, CAST(ceil(w/gsd) AS BIGINT) AS cols, CAST(ceil(h/gsd) AS BIGINT) AS rows, ceil(w/gsd)<=12000 AND ceil(h/gsd)<=12000 AS allowed, CAST(greatest(2, round_even(375e-1/gsd,0)) AS INT) AS feature_px FROM c, r",
    "base_gsd": "SELECT c_nationkey, min(CASE greatest(c_custkey%3, c_nationkey%3) WHEN 0 THEN 25e-2 WHEN 1 THEN 1e0 ELSE 1e1 END) AS gsd FROM customer GROUP BY 1",
    "km_to_deg": f"{_P} SELECT id, {_r('(5e0/111e0+5e0/(111e0*cos(radians(lat))))/2e0')} AS deg, {_r('((lat-37.5e0)*5)*((lat-37.5e0)*5)*(3e0-2e0*((lat-37.5e0)*5))')} AS ease FROM points",
    "point_distance": f"{t.ctes('legs')} SELECT route_id, {_r('sqrt(pow(elon-slon,2)+pow(elat-slat,2))')} AS deg, {_r('2*6371e0*asin(sqrt(pow(sin(radians(elat-slat)/2),2)+cos(radians(slat))*cos(radians(elat))*pow(sin(radians(elon-slon)/2),2)))')} AS km FROM legs",
    "area_bbox": f"{_P}, a AS (SELECT *, CAST(id%5+1 AS DOUBLE) AS k FROM points) SELECT id, {_r('lat-k/111e0/2e0')} AS min_lat, {_r('lat+k/111e0/2e0')} AS max_lat, {_r('lon-k/(111e0*8e-1)/2e0')} AS min_lon, {_r('lon+k/(111e0*8e-1)/2e0')} AS max_lon FROM a",
    "map_water": f"{_C} SELECT y, x, ((b-greatest(r,g)>12e-2) OR (b>4e-1 AND r<3e-1 AND g<4e-1) OR (b>r+2e-1 AND b>g+15e-2)) AND (r+g+b)/3e0<92e-2 AND (r+g+b)/3e0>1e-1 AS water FROM colours",
    "lit_rgb": f"{_C} SELECT y, x, " + ", ".join(_r(_clip(f"{c}*CASE WHEN y%2=0 THEN 82e-2+28e-2*(x/1e2) ELSE 62e-2+5e-1*(x/1e2) END")) + f" AS {c}" for c in "rgb") + " FROM colours",
    "isp_colour": f"{_C} SELECT y, x, {_r(_clip(_mix('r') + '*(1.05e0-5e-2)'))} AS r, {_r(_clip(_mix('g') + '*1.05e0'))} AS g, {_r(_clip(_mix('b')))} AS b FROM colours",
    "haze_colour": f"{_C} SELECT y, x, " + ", ".join(_r(_clip(f"({c}*(1e0-(3e-2+2e-2*r))+{w}*(3e-2+2e-2*r))*97e-2+3e-2")) + f" AS {c}" for c, w in (("r", "75e-2"), ("g", "8e-1"), ("b", "85e-2"))) + " FROM colours",
    "thermal_colours": f"{_C} SELECT y, x, {_thermal_sql('r/3e-1*2e-1', '(r-3e-1)/3e-1*3e-1', '3e-1+(r-6e-1)/4e-1*7e-1')} AS tr, {_thermal_sql('r/3e-1*3e-1', '5e-1+(r-3e-1)/3e-1*3e-1', '8e-1+(r-6e-1)/4e-1*2e-1')} AS tg, {_thermal_sql('r/3e-1*8e-1', '8e-1-(r-3e-1)/3e-1*3e-1', '5e-1-(r-6e-1)/4e-1*5e-1')} AS tb FROM colours",
    "vessel_silhouette": f"{_G}, d AS (SELECT DISTINCT y%100 AS y, x FROM grid) SELECT y, x, {', '.join(map(_vessel_sql, ('small', 'generic', 'large')))} FROM d",
    "quantised_rgb": f"{_C} SELECT y, x, " + ", ".join(f"CAST(least(greatest(floor({c}*255e0+5e-1),0),255) AS INT) AS q{c}" for c in "rgb") + f", CAST(trunc({_clip('r')}*255e0) AS INT) AS cut, {_r('(r+g+b)/3')} AS grey FROM colours",
    "contour_lines": f"{_G} SELECT y, x, (z%500e0<15e0 OR z%500e0>485e0) AS line FROM grid",
    "vessel_flags": "WITH s AS (SELECT s_suppkey AS k, CASE s_suppkey%3 WHEN 0 THEN 'ferry' WHEN 1 THEN 'tss' ELSE 'irregular' END AS type FROM supplier) SELECT 'route_'||CASE WHEN k+1<1000 THEN lpad(CAST(k+1 AS VARCHAR),3,'0') ELSE CAST(k+1 AS VARCHAR) END AS id, type, CASE type WHEN 'ferry' THEN 'ferry' WHEN 'tss' THEN 'cargo' ELSE 'unknown' END AS vessel_type, type='irregular' AS suspicious, upper(type[1])||type[2:]||' '||chr(CAST(65+k%26 AS INT))||CAST(k+1 AS VARCHAR) AS name FROM s",
    "rounded_measures": "SELECT p_partkey, round(p_retailprice,1) AS r1, least(greatest(p_retailprice,920e0),980e0) AS clamped, CASE WHEN p_retailprice>950 THEN p_retailprice ELSE 0e0 END AS masked FROM part",
    "eo_config": "WITH p AS (SELECT p_partkey, p_size/5e0 AS gsd, (p_partkey*7919)%2000000 AS px FROM part), q AS (SELECT *, CASE WHEN px>=1000000 THEN 1 WHEN px>=300000 THEN 2 ELSE 4 END AS s FROM p) SELECT p_partkey, gsd, CAST(CASE WHEN gsd<=5e-1 THEN 7 WHEN gsd<=2 THEN 6 ELSE 5 END AS INT) AS octaves, CAST(CASE WHEN gsd<=5e-1 THEN 80 WHEN gsd<=2 THEN 160 ELSE 64 END AS INT) AS base_scale, CASE WHEN gsd<=5e-1 THEN 110e-2 WHEN gsd<=2 THEN 105e-2 ELSE 115e-2 END AS gamma, CASE WHEN gsd<=2 THEN 0e0 ELSE 6e-1 END AS warp_px, CAST(CASE WHEN gsd>=10 THEN 1 WHEN gsd<=2 AND px<600000 THEN greatest(s,2) ELSE s END AS INT) AS supersample FROM q",
}
_corners = SQL["utm_project"].replace("FROM points)", "FROM corners)")
SQL["world_dimensions"] = _corners[: len(_P)] + ", corners AS (SELECT id*2+k AS id, lon+(2*k-1)*(id%5+1)/(111e0*8e-1)/2e0 AS lon, lat+(2*k-1)*(id%5+1)/111e0/2e0 AS lat FROM points, (SELECT unnest([0,1]) AS k))" + _corners[len(_P) :].replace(") SELECT id, ", "), u AS (SELECT id, ", 1) + f"), d AS (SELECT id//2 AS id, max(easting)-min(easting) AS w, max(northing)-min(northing) AS h FROM u GROUP BY 1), g AS (SELECT *, CAST(ceil(w/25e-2) AS BIGINT) AS cols, CAST(ceil(h/25e-2) AS BIGINT) AS rows FROM d) SELECT id, {_r('w', 2)} AS width_m, {_r('h', 2)} AS height_m, cols, rows, CASE WHEN cols>12000 OR rows>12000 OR cols*rows>144000000 THEN cols||' x '||rows||' cells, over 12000 x 12000' END AS error FROM g"
