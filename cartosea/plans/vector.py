"""Queries over points, tracks, legs and zones, and graph operators over the grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartosea.operators import geometry as g
from cartosea.operators import graph, wayfinding
from cartosea.operators.stencil import stretch
from cartosea.plans import raster
from cartosea.sources import tables as t

r6 = lambda c: F.round(c, 6)


def traj_length_km(spark, sf):
    """Length of each user's track."""
    return g.track_length(t.tracks(spark, sf), "user_id", ["ts", "event_id"]).select("user_id", r6("km").alias("km"), "points")


def track_bounds(spark, sf):
    """Bounding box of each track."""
    return t.tracks(spark, sf).groupBy("user_id").agg(*[r6(f(c)).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("lon", "lat")])


def zone_area(spark, sf):
    """Area and bounds of the zones, and the largest of each type."""
    z = g.bounds(t.zones(spark, sf)).withColumn("area", g.area(F.col("ring")))
    top = z.groupBy("zone_type").agg(F.max_by("zone_id", F.struct("area", (-F.col("zone_id")).alias("i"))).alias("top"))
    return z.join(top, "zone_type").select("zone_id", "zone_type", F.round("area", 9).alias("area"), r6("min_lon").alias("min_lon"), r6("max_lat").alias("max_lat"), (F.col("top") == F.col("zone_id")).alias("largest"))


def zone_vertices(spark, sf):
    """Vertices of the rings with the midpoints of the edges that they begin."""
    e = t.zones(spark, sf).select("zone_id", F.posexplode(g.edges(F.col("ring"))).alias("i", "e"))
    return e.select("zone_id", "i", r6("e.ax").alias("lon"), r6("e.ay").alias("lat"), r6((F.col("e.ax") + F.col("e.bx")) / 2).alias("mid_lon"), r6((F.col("e.ay") + F.col("e.by")) / 2).alias("mid_lat"))


def offset_vertices(spark, sf):
    """Vertices pushed 0.01 degrees away from their zone's centroid."""
    e = t.zones(spark, sf).select("zone_id", F.posexplode(g.edges(F.col("ring"))).alias("i", "e"))
    c = e.groupBy("zone_id").agg(F.avg("e.ax").alias("cx"), F.avg("e.ay").alias("cy"))
    v = e.join(c, "zone_id").withColumns({"dx": F.col("e.ax") - F.col("cx"), "dy": F.col("e.ay") - F.col("cy")}).withColumn("d", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    return v.select("zone_id", "i", r6(F.col("e.ax") + F.col("dx") / F.col("d") * 0.01).alias("lon"), r6(F.col("e.ay") + F.col("dy") / F.col("d") * 0.01).alias("lat"))


def point_in_zone(spark, sf):
    """Points inside zones."""
    return g.points_in_zones(t.points(spark, sf), t.zones(spark, sf)).select("id", "zone_id")


def route_zone_hits(spark, sf):
    """Legs and the zones that they meet."""
    return g.segments_on_zones(t.legs(spark, sf), t.zones(spark, sf), ["route_id"])


def first_blocking(spark, sf):
    """Each leg with whether it is clear, the first zone that blocks it and how many do."""
    hits = g.segments_on_zones(t.legs(spark, sf), t.zones(spark, sf), ["route_id"]).groupBy("route_id").agg(F.min("zone_id").alias("first_zone"), F.count("*").alias("blocked"))
    return t.legs(spark, sf).select("route_id").join(hits, "route_id", "left").select("route_id", F.col("first_zone").isNull().alias("clear"), "first_zone", F.coalesce("blocked", F.lit(0)).alias("blocked"))


def invalid_routes(spark, sf):
    """Count of legs that meet a zone."""
    hits = g.segments_on_zones(t.legs(spark, sf), t.zones(spark, sf), ["route_id"]).select("route_id").distinct()
    return t.legs(spark, sf).join(hits.withColumn("hit", F.lit(1)), "route_id", "left").agg(F.count_if(F.col("hit") == 1).alias("invalid"), F.count("*").alias("routes"))


def zone_min_distance(spark, sf):
    """Least distance of each two zones."""
    return g.zone_distances(t.zones(spark, sf)).select("a", "b", r6("dist").alias("dist"))


def zone_nearest(spark, sf):
    """Each zone's nearest other zone, whatever the distance."""
    return g.nearest_zones(t.zones(spark, sf), 0.005).select("zone_id", "nearest", r6("dist").alias("dist"))


def zones_within(spark, sf):
    """Pairs of zones within 0.036 degrees."""
    return g.zones_within(t.zones(spark, sf), 0.036).select("a", "b", r6("dist").alias("dist"))


def adaptive_buffer(spark, sf):
    """The buffer for all zones, from the least distance between any two."""
    d = g.nearest_zones(t.zones(spark, sf)).agg(F.min("dist").alias("least"), F.count("*").alias("n"))
    return d.select(r6(g.adaptive_buffer(F.col("least"), F.col("n"))).alias("buffer"), r6("least").alias("least"))


def clipped_zones(spark, sf):
    """Area and box of each zone within a box of a tenth of a degree."""
    c = g.clip_rings(t.zones(spark, sf), (-122.45, 37.55), (-122.35, 37.65)).where(F.size("ring") > 0)
    e = c.select("zone_id", F.explode(g.edges(F.col("ring"))).alias("e"))
    return e.groupBy("zone_id").agg(F.round(F.abs(F.sum(F.col("e.ax") * F.col("e.by") - F.col("e.bx") * F.col("e.ay"))) / 2.0, 8).alias("area"), r6(F.min("e.ax")).alias("min_lon"), r6(F.max("e.ax")).alias("max_lon"), r6(F.min("e.ay")).alias("min_lat"), r6(F.max("e.ay")).alias("max_lat"))


def straight_waypoints(spark, sf):
    """Eleven points along each leg."""
    return g.straight_waypoints(t.legs(spark, sf), 10).select("route_id", "seq", r6("lon").alias("lon"), r6("lat").alias("lat"))


def resample_rings(spark, sf):
    """Sixteen points at even steps along each zone's boundary."""
    v = t.zones(spark, sf).select("zone_id", F.posexplode("ring").alias("i", "v")).select("zone_id", "i", "v.lon", "v.lat")
    return g.resample(v, "zone_id", 15).select("zone_id", "seq", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"))


def _sides(spark, sf):
    """(route_id, zone_id, left, pts, len): for each leg and zone that it meets, the ways by the vertices on either side."""
    hits = g.segments_on_zones(t.legs(spark, sf), t.zones(spark, sf), ["route_id"])
    v = hits.join(t.legs(spark, sf), "route_id").join(t.zones(spark, sf).select("zone_id", F.posexplode(F.slice("ring", 1, 6)).alias("i", "v")), "zone_id")
    cross = (F.col("elon") - F.col("slon")) * (F.col("v.lat") - F.col("slat")) - (F.col("elat") - F.col("slat")) * (F.col("v.lon") - F.col("slon"))
    side = v.groupBy("route_id", "zone_id", "slon", "slat", "elon", "elat", (cross > 0).alias("left")).agg(F.array_sort(F.collect_list(F.struct("i", F.col("v.lon").alias("lon"), F.col("v.lat").alias("lat")))).alias("vs"))
    place = lambda lon, lat: F.struct(F.col(lon).alias("lon"), F.col(lat).alias("lat"))
    pts = F.concat(F.array(place("slon", "slat")), F.transform("vs", lambda q: F.struct(q["lon"].alias("lon"), q["lat"].alias("lat"))), F.array(place("elon", "elat")))
    steps = F.zip_with(F.slice(pts, 1, F.size(pts) - 1), F.slice(pts, 2, F.size(pts) - 1), lambda a, b: F.sqrt(F.pow(b["lon"] - a["lon"], 2) + F.pow(b["lat"] - a["lat"], 2)))
    return side.select("route_id", "zone_id", "left", pts.alias("pts"), F.aggregate(steps, F.lit(0.0), lambda s, d: s + d).alias("len"))


def detour_side(spark, sf):
    """For each leg and zone that it meets: length of the way by the left and the right vertices, and the choice."""
    n = _sides(spark, sf).groupBy("route_id", "zone_id").agg(F.max(F.when(F.col("left"), F.col("len"))).alias("l"), F.max(F.when(~F.col("left"), F.col("len"))).alias("r"))
    return n.select("route_id", "zone_id", r6("l").alias("left_length"), r6("r").alias("right_length"), F.when(F.col("l").isNotNull() & (F.col("r").isNull() | (F.col("l") <= F.col("r"))), "left").otherwise("right").alias("side"))


def best_detour(spark, sf):
    """The shorter way around each zone that a leg meets, left of equals, as sixteen points at even steps."""
    best = _sides(spark, sf).groupBy("route_id", "zone_id").agg(F.min_by("pts", F.struct("len", (~F.col("left")).alias("right"))).alias("pts"))
    line = best.select(F.struct("route_id", "zone_id").alias("way"), F.posexplode("pts").alias("i", "p")).select("way", "i", "p.lon", "p.lat")
    return g.resample(line, "way", 15).select("way.route_id", "way.zone_id", "seq", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"))


def bbox_detour(spark, sf):
    """For each leg that meets a zone: the first clear one-point way around all of its zones' box, north first."""
    zones = t.zones(spark, sf)
    hits = g.segments_on_zones(t.legs(spark, sf), zones, ["route_id"]).join(g.bounds(zones), "zone_id")
    box = hits.groupBy("route_id").agg(F.min("min_lon").alias("x0"), F.max("max_lon").alias("x1"), F.min("min_lat").alias("y0"), F.max("max_lat").alias("y1"))
    b = t.legs(spark, sf).join(box, "route_id")
    mx, my = (F.col("slon") + F.col("elon")) / 2, (F.col("slat") + F.col("elat")) / 2
    ways = [(mx, F.col("y1") + 0.1), (mx, F.col("y0") - 0.1), (F.col("x1") + 0.1, my), (F.col("x0") - 0.1, my)]
    c = b.withColumn("w", F.explode(F.array(*[F.struct(F.lit(i).alias("p"), x.alias("lon"), y.alias("lat")) for i, (x, y) in enumerate(ways)])))
    key = ["route_id", F.col("w.p").alias("p"), F.col("w.lon").alias("wlon"), F.col("w.lat").alias("wlat")]
    legs = c.select(*key, "slon", "slat", F.col("w.lon").alias("elon"), F.col("w.lat").alias("elat")).unionByName(c.select(*key, F.col("w.lon").alias("slon"), F.col("w.lat").alias("slat"), "elon", "elat"))
    bad = g.segments_on_zones(legs, zones, ["route_id", "p"]).select("route_id", "p").distinct()
    clear = c.select(*key).join(bad, ["route_id", "p"], "left_anti")
    return clear.groupBy("route_id").agg(F.min_by(F.struct("p", "wlon", "wlat"), "p").alias("b")).select("route_id", F.col("b.p").alias("way"), r6("b.wlon").alias("lon"), r6("b.wlat").alias("lat"))


def visibility_edges(spark, sf):
    """Pairs of zone centres that see each other past all other zones."""
    v = t.zones(spark, sf).select("zone_id", g.edges(F.col("ring")).alias("e")).select("zone_id", F.explode("e").alias("e")).groupBy("zone_id").agg(F.avg("e.ax").alias("lon"), F.avg("e.ay").alias("lat"))
    a, b = v.select(F.col("zone_id").alias("a"), F.col("lon").alias("slon"), F.col("lat").alias("slat")), v.select(F.col("zone_id").alias("b"), F.col("lon").alias("elon"), F.col("lat").alias("elat"))
    pairs = a.join(b, F.col("a") < F.col("b"))
    hits = g.segments_on_zones(pairs, t.zones(spark, sf), ["a", "b"]).where("zone_id <> a and zone_id <> b").select("a", "b").distinct()
    return pairs.join(hits, ["a", "b"], "left_anti").select("a", "b", r6(F.sqrt(F.pow(F.col("elon") - F.col("slon"), 2) + F.pow(F.col("elat") - F.col("slat"), 2))).alias("w"))


#: Buffer and longest leg, in degrees, of the graph that the next queries look at.
BUFFER, REACH = 0.005, 0.06


def _graph(spark, sf):
    zones = t.zones(spark, sf)
    nodes = graph.staged(wayfinding.corners(zones, BUFFER))
    return zones, nodes, wayfinding.visibility(nodes, zones, BUFFER, REACH)


def visibility_graph(spark, sf):
    """Pushed-out corners of the zones that see each other past all buffered zones."""
    return _graph(spark, sf)[2].where("a < b").select("a", "b", r6("far").alias("far"))


def shortest_routes(spark, sf):
    """Shortest ways over that graph, for the legs that aren't clear themselves and whose ends see it."""
    zones, nodes, edges = _graph(spark, sf)
    legs = wayfinding.spread(t.legs(spark, sf), "route_id")
    hit = wayfinding.blocked(legs, zones, ["route_id"], BUFFER).select("route_id").distinct()
    best = wayfinding.shortest(legs.join(hit, "route_id", "left_semi"), nodes, edges, zones, BUFFER, REACH)
    return best.select("route_id", r6("length").alias("length"))


#: Buffer of the collision-free lines.
NARROW = 0.003


def collision_free_routes(spark, sf):
    """Points of a line for each leg that keeps away from zones, the rule that gave it, and whether it does."""
    out = wayfinding.collision_free(t.legs(spark, sf), t.zones(spark, sf), NARROW)
    return out.select("route_id", "clear", "rule", F.posexplode("line").alias("seq", "p")).select("route_id", "clear", "rule", "seq", F.round("p.lon", 5).alias("lon"), F.round("p.lat", 5).alias("lat"))


def snap_outside(spark, sf):
    """Points inside zones, moved to the first of 19 rings of 8 places that is outside all zones."""
    zones = t.zones(spark, sf)
    inside = g.points_in_zones(t.points(spark, sf), zones).select("id", "lon", "lat").distinct()
    dirs = [(1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, 1), (1, -1), (-1, -1)]
    moves = F.array(*[F.struct(F.lit(8 * (m - 1) + i).alias("p"), F.lit(0.005 * m * dx).alias("dx"), F.lit(0.005 * m * dy).alias("dy")) for m in range(1, 20) for i, (dx, dy) in enumerate(dirs)])
    tried = inside.withColumn("m", F.explode(moves)).select("id", F.col("m.p").alias("p"), (F.col("lon") + F.col("m.dx")).alias("lon"), (F.col("lat") + F.col("m.dy")).alias("lat"))
    bad = g.points_in_zones(tried, zones).select("id", "p").distinct()
    free = tried.join(bad, ["id", "p"], "left_anti")
    return free.groupBy("id").agg(F.min_by(F.struct("p", "lon", "lat"), "p").alias("b")).select("id", F.col("b.p").alias("try"), r6("b.lon").alias("lon"), r6("b.lat").alias("lat"))


def d8_direction(spark, sf):
    """Steepest descent of each cell."""
    return graph.d8_direction(t.grid(spark, sf))


def flow_accumulation(spark, sf):
    """Upstream cells of each cell."""
    return graph.flow_accumulation(graph.d8_direction(t.grid(spark, sf)))


def mask_regions(spark, sf):
    """Regions of high cells, and whether they have five cells or more."""
    labels = graph.components(t.grid(spark, sf).select("y", "x", (F.col("z") > 250000).alias("m")), "m")
    return labels.groupBy("label").agg(F.count("*").alias("cells")).select("label", "cells", (F.col("cells") >= 5).alias("kept"))


def clean_water(spark, sf):
    """A mask opened, closed and rid of regions under five cells."""
    return graph.clean_mask(t.grid(spark, sf).select("y", "x", (F.col("z") > 250000).alias("m")), "m", 5)


def rivers_d8(spark, sf):
    """Rivers and floodplain of a relief by flow accumulation."""
    found = graph.rivers_and_flood(stretch(raster.relief(spark, sf), F.col("z"), "n").select("y", "x", "n"))
    return found.withColumns({c: r6(c) for c in ("river_level", "flood_level")})


def mask_sets(spark, sf):
    """Union, difference and intersection of two masks by cell sets."""
    c = t.grid(spark, sf)
    a, b = c.where("z > 200000").select("y", "x"), c.where("x % 3 = 0").select("y", "x")
    parts = [a.union(b).distinct().withColumn("op", F.lit("union")), a.exceptAll(b).withColumn("op", F.lit("difference")), a.join(b, ["y", "x"], "left_semi").withColumn("op", F.lit("intersection"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("op").agg(F.count("*").alias("cells"), F.sum(F.col("y") * 100 + F.col("x")).alias("checksum"))


QUERIES = {
    f.__name__: f
    for f in (traj_length_km, track_bounds, zone_area, zone_vertices, offset_vertices, point_in_zone, route_zone_hits, first_blocking, invalid_routes, zone_min_distance, zone_nearest, zones_within, adaptive_buffer, clipped_zones, straight_waypoints, resample_rings, detour_side, best_detour, bbox_detour, visibility_edges, visibility_graph, shortest_routes, collision_free_routes, snap_outside, d8_direction, flow_accumulation, mask_regions, clean_water, rivers_d8, mask_sets)
}

_r = lambda v, n=6: f"(round({v}, {n}) + 0e0)"
_E, _L = t.ctes("edges"), t.ctes("legs", "edges")
_X = lambda a, b, c, d, e, f: f"(({c}-({a}))*({f}-({b}))-({d}-({b}))*({e}-({a})))"


def _hit(ax, ay, bx, by):
    """Condition that a segment properly crosses edge e or its start is inside by parity (summed by the caller)."""
    d1, d2 = _X(ax, ay, bx, by, "e.ax", "e.ay"), _X(ax, ay, bx, by, "e.bx", "e.by_")
    d3, d4 = _X("e.ax", "e.ay", "e.bx", "e.by_", ax, ay), _X("e.ax", "e.ay", "e.bx", "e.by_", bx, by)
    return f"({d1}*{d2}<=0 AND {d3}*{d4}<=0)"


def _in(lon, lat):
    return f"(sum(CASE WHEN (e.ay>{lat})<>(e.by_>{lat}) AND {lon}<(e.bx-e.ax)*({lat}-e.ay)/(e.by_-e.ay)+e.ax THEN 1 ELSE 0 END)%2=1)"


def _hits(source, keys, name="hits"):
    k = ", ".join(keys)
    return f"{name} AS (SELECT {k}, e.zone_id FROM {source} l, edges e GROUP BY {k}, e.zone_id, slon, slat, elon, elat HAVING bool_or{_hit('l.slon', 'l.slat', 'l.elon', 'l.elat')} OR {_in('l.slon', 'l.slat')})"


_ps = lambda px, py, s: f"sqrt(pow({px}-({s}.ax+least(greatest((({px}-{s}.ax)*({s}.bx-{s}.ax)+({py}-{s}.ay)*({s}.by_-{s}.ay))/(pow({s}.bx-{s}.ax,2)+pow({s}.by_-{s}.ay,2)),0e0),1e0)*({s}.bx-{s}.ax)),2)+pow({py}-({s}.ay+least(greatest((({px}-{s}.ax)*({s}.bx-{s}.ax)+({py}-{s}.ay)*({s}.by_-{s}.ay))/(pow({s}.bx-{s}.ax,2)+pow({s}.by_-{s}.ay,2)),0e0),1e0)*({s}.by_-{s}.ay)),2))"
_HOLD = f"hold AS (SELECT p.zone_id AS a, e.zone_id AS b, {_in('p.ax', 'p.ay')} AS h FROM edges p, edges e WHERE p.i=0 AND p.zone_id<>e.zone_id GROUP BY 1, 2, p.ax, p.ay)"
_DIST = f"{_HOLD}, zd AS (SELECT p.zone_id AS a, e.zone_id AS b, CASE WHEN bool_or(h1.h OR h2.h) THEN 0e0 ELSE min(CASE WHEN {_hit('p.ax', 'p.ay', 'p.bx', 'p.by_')} THEN 0e0 ELSE least({_ps('p.ax', 'p.ay', 'e')},{_ps('p.bx', 'p.by_', 'e')},{_ps('e.ax', 'e.ay', 'p')},{_ps('e.bx', 'e.by_', 'p')}) END) END AS dist FROM edges p JOIN edges e ON p.zone_id<e.zone_id JOIN hold h1 ON h1.a=p.zone_id AND h1.b=e.zone_id JOIN hold h2 ON h2.a=e.zone_id AND h2.b=p.zone_id GROUP BY 1,2)"
_PZ = f"{t.ctes('points', 'edges')}, pz AS (SELECT id, lon, lat, e.zone_id FROM points p, edges e GROUP BY id, lon, lat, e.zone_id HAVING {_in('p.lon', 'p.lat')})"
_MOVES = "mv AS (SELECT CAST(8*(m.range-1)+d.i AS INT) AS p, 5e-3*m.range*dx AS dx, 5e-3*m.range*dy AS dy FROM range(1,20) m, (VALUES (0,1,0),(1,-1,0),(2,0,1),(3,0,-1),(4,1,1),(5,-1,1),(6,1,-1),(7,-1,-1)) d(i,dx,dy))"
_D8 = "o8(k,dy,dx) AS (VALUES (0,0,1),(1,-1,1),(2,-1,0),(3,-1,-1),(4,0,-1),(5,1,-1),(6,1,0),(7,1,1)), nb AS (SELECT g.y, g.x, o.k, g.z-m.z AS drop_ FROM grid g, o8 o, grid m WHERE m.y=g.y+o.dy AND m.x=g.x+o.dx), rk AS (SELECT *, row_number() OVER (PARTITION BY y,x ORDER BY drop_ DESC, k) AS r, count(*) OVER (PARTITION BY y,x) AS n FROM nb), dd AS (SELECT y, x, CASE WHEN n=8 AND drop_>0 THEN k ELSE -1 END AS dir FROM rk WHERE r=1)"
_GR = t.ctes("grid")
def _rivers_sql():
    norm = raster._RELIEF.replace("FROM grid", "FROM g0")
    head = f"WITH RECURSIVE {_GR.removeprefix('WITH grid AS').join(['g0 AS', ''])}, {norm}, grid AS (SELECT y, x, n AS z FROM nn), s AS (SELECT max(y)+1 AS h, max(x)+1 AS w FROM grid), {_D8}"
    walk = "dn AS (SELECT y, x, y+dy AS ty, x+dx AS tx FROM dd JOIN o8 ON k=dir), wk AS (SELECT y AS oy, x AS ox, y, x FROM grid UNION ALL SELECT oy, ox, ty, tx FROM wk JOIN dn ON dn.y=wk.y AND dn.x=wk.x), ac AS (SELECT y, x, CAST(count(*) AS DOUBLE) AS c FROM wk GROUP BY 1,2)"
    unit = "ar AS (SELECT y, x, (c-min(c) OVER ())/(max(c) OVER ()-min(c) OVER ()) AS acc FROM ac), th AS (SELECT quantile_cont(acc, 1e0-4e-3) AS thr FROM ar)"
    wet = "wet AS (SELECT g.y, g.x, z AS n, CAST(acc>=thr AND z<92e-2 AS DOUBLE) AS a, least(greatest((acc-thr)/(1e0-thr+1e-6),0e0),1e0) AS b FROM ar JOIN grid g ON g.y=ar.y AND g.x=ar.x, th)"
    return f"{head}, {walk}, {unit}, {wet}, {raster._blur_sql('wet', 'a', 2, 'ba')}, {raster._blur_sql('wet', 'b', 2, 'bb')} SELECT wet.y, wet.x, ba.v>3e-1 AS river, bb.v*(1e0-least(greatest(n*13e-1-5e-1,0e0),1e0))>35e-2 AS flood, {_r('ba.v')} AS river_level, {_r('bb.v*(1e0-least(greatest(n*13e-1-5e-1,0e0),1e0))')} AS flood_level FROM wet JOIN ba ON ba.y=wet.y AND ba.x=wet.x JOIN bb ON bb.y=wet.y AND bb.x=wet.x"


def _clean_sql():
    opened = raster.SQL["open_close"].replace("150000", "250000").removesuffix(" SELECT y, x, m FROM m4").replace("WITH ", "WITH RECURSIVE ", 1)
    regions = "c AS (SELECT y, x, CAST(y AS BIGINT)*4294967296+x AS id FROM m4 WHERE m), ad AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON (b.y=a.y AND b.x=a.x+1) UNION ALL SELECT a.id, b.id FROM c a JOIN c b ON (b.y=a.y+1 AND b.x=a.x)), e AS (SELECT a, b FROM ad UNION ALL SELECT b, a FROM ad), r AS (SELECT id AS a, id AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON e.a=r.b), k AS (SELECT a FROM r GROUP BY 1 HAVING count(*)>=5)"
    return f"{opened}, {regions} SELECT y, x, m AND EXISTS (SELECT 1 FROM k WHERE k.a=CAST(y AS BIGINT)*4294967296+x) AS m FROM m4"


def _clip_sql():
    out = f"{t.ctes('verts')}, c0 AS (SELECT zone_id, CAST(i AS BIGINT) AS s, lon, lat FROM verts WHERE i<6)"
    for k, (at, bound, test) in enumerate((("lon", "-122.45e0", ">="), ("lon", "-122.35e0", "<="), ("lat", "37.55e0", ">="), ("lat", "37.65e0", "<="))):
        other = "lat" if at == "lon" else "lon"
        before = lambda c: f"coalesce(lag({c}) OVER (PARTITION BY zone_id ORDER BY s), last_value({c}) OVER (PARTITION BY zone_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
        out += f", e{k} AS (SELECT *, {before(at)} AS pa, {before(other)} AS po FROM c{k}), c{k + 1} AS (SELECT zone_id, s*2+k AS s, CASE k WHEN 0 THEN {bound} ELSE {at} END AS {at}, CASE k WHEN 0 THEN po+({bound}-pa)/({at}-pa)*({other}-po) ELSE {other} END AS {other} FROM e{k}, (VALUES (0),(1)) v(k) WHERE CASE k WHEN 0 THEN (pa{test}{bound})<>({at}{test}{bound}) ELSE {at}{test}{bound} END)"
    return out + f", f AS (SELECT *, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS nx, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS ny FROM c4 WINDOW w AS (PARTITION BY zone_id ORDER BY s)) SELECT zone_id, {_r('abs(sum(lon*ny-nx*lat))/2e0', 8)} AS area, {_r('min(lon)')} AS min_lon, {_r('max(lon)')} AS max_lon, {_r('min(lat)')} AS min_lat, {_r('max(lat)')} AS max_lat FROM f GROUP BY 1"


def _blocked_sql(name, source, keys, b):
    """Keys of the legs (ax, ay, bx, by_) of source that a buffered zone keeps from passing."""
    gap = f"CASE WHEN {_hit('l.ax', 'l.ay', 'l.bx', 'l.by_')} THEN 0e0 ELSE least({_ps('l.ax', 'l.ay', 'e')},{_ps('l.bx', 'l.by_', 'e')},{_ps('e.ax', 'e.ay', 'l')},{_ps('e.bx', 'e.by_', 'l')}) END"
    return f"{name} AS (SELECT DISTINCT {keys} FROM (SELECT {keys} FROM {source} l, edges e GROUP BY {keys}, l.ax, l.ay, l.bx, l.by_, e.zone_id HAVING min({gap})<{b!r}e0-1e-12 OR {_in('l.ax', 'l.ay')}))"


def _graph_sql():
    push = f"{1.5 * BUFFER / 2!r}e0"
    tries = f"md AS (SELECT zone_id, avg(ax) AS cx, avg(ay) AS cy FROM edges GROUP BY 1), v0 AS (SELECT zone_id, 2*i AS slot, ax AS x, ay AS y FROM edges UNION ALL SELECT zone_id, 2*i+1, (ax+bx)/2, (ay+by_)/2 FROM edges), tr AS (SELECT v0.zone_id, slot, p.range AS p, x+(x-cx)/sqrt(pow(x-cx,2)+pow(y-cy,2))*p.range*{push} AS lon, y+(y-cy)/sqrt(pow(x-cx,2)+pow(y-cy,2))*p.range*{push} AS lat FROM v0 JOIN md ON md.zone_id=v0.zone_id, range(1,8) p)"
    free = f"nr AS (SELECT DISTINCT zone_id, slot, p FROM (SELECT q.zone_id, q.slot, q.p FROM tr q, edges e GROUP BY q.zone_id, q.slot, q.p, q.lon, q.lat, e.zone_id HAVING min({_ps('q.lon', 'q.lat', 'e')})<{BUFFER!r}e0 OR {_in('q.lon', 'q.lat')})), nd AS (SELECT CAST(zone_id AS BIGINT)*1048576+slot AS node, arg_min(lon, p) AS lon, arg_min(lat, p) AS lat FROM tr WHERE NOT EXISTS (SELECT 1 FROM nr WHERE nr.zone_id=tr.zone_id AND nr.slot=tr.slot AND nr.p=tr.p) GROUP BY zone_id, slot)"
    far = lambda a, b: f"sqrt(pow({a}lon-{b}lon,2)+pow({a}lat-{b}lat,2))"
    pairs = f"pr AS (SELECT m.node AS a, n.node AS b, {far('m.', 'n.')} AS far, m.lon AS ax, m.lat AS ay, n.lon AS bx, n.lat AS by_ FROM nd m JOIN nd n ON m.node<n.node WHERE {far('m.', 'n.')}<={REACH!r}e0)"
    return f"{tries}, {free}, {pairs}, {_blocked_sql('bp', 'pr', 'a, b', BUFFER)}, vg AS (SELECT a, b, far FROM pr WHERE NOT EXISTS (SELECT 1 FROM bp WHERE bp.a=pr.a AND bp.b=pr.b))"


def _shortest_sql():
    links = ""
    for end in "se":
        far = f"sqrt(pow({end}lon-nd.lon,2)+pow({end}lat-nd.lat,2))"
        links += f", l{end} AS (SELECT lb.route_id, nd.node, {far} AS far, {end}lon AS ax, {end}lat AS ay, nd.lon AS bx, nd.lat AS by_ FROM lb, nd WHERE {far}<={REACH!r}e0), {_blocked_sql(f'b{end}', f'l{end}', 'route_id, node', BUFFER)}, k{end} AS (SELECT * FROM l{end} WHERE NOT EXISTS (SELECT 1 FROM b{end} b WHERE b.route_id=l{end}.route_id AND b.node=l{end}.node))"
    direct = f"lg AS (SELECT route_id, slon AS ax, slat AS ay, elon AS bx, elat AS by_ FROM legs), {_blocked_sql('bd', 'lg', 'route_id', BUFFER)}, lb AS (SELECT legs.* FROM legs JOIN bd ON bd.route_id=legs.route_id)"
    both = "gg AS (SELECT a, b, far FROM vg UNION ALL SELECT b, a, far FROM vg)"
    walk = "d(route_id, node, dist) USING KEY (route_id, node) AS (SELECT route_id, node, far FROM ks UNION SELECT d.route_id, gg.b, min(d.dist+gg.far) FROM d JOIN gg ON gg.a=d.node LEFT JOIN recurring.d r ON r.route_id=d.route_id AND r.node=gg.b WHERE d.dist+gg.far<coalesce(r.dist,1e9)-1e-15 GROUP BY 1,2)"
    return f"{_L.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_graph_sql()}, {direct}{links}, {both}, {walk} SELECT d.route_id, {_r('min(d.dist+ke.far)')} AS length FROM d JOIN ke ON ke.route_id=d.route_id AND ke.node=d.node GROUP BY 1"


def _even_sql(name, source, n):
    """(route_id, seq, lon, lat): n + 1 points at even steps along the lines (route_id, i, lon, lat) of source."""
    steps = f"{name}w AS (SELECT *, lag(lon) OVER q AS plon, lag(lat) OVER q AS plat FROM {source} WINDOW q AS (PARTITION BY route_id ORDER BY i)), {name}d AS (SELECT *, coalesce(sqrt(pow(lon-plon,2)+pow(lat-plat,2)),0e0) AS d FROM {name}w), {name}c AS (SELECT *, sum(d) OVER (PARTITION BY route_id ORDER BY i) AS hi, sum(d) OVER (PARTITION BY route_id) AS tot FROM {name}d)"
    at = f"{name}g AS (SELECT *, CAST(range AS INT) AS seq, range/{n}e0*tot AS tg, row_number() OVER (PARTITION BY route_id, range ORDER BY i) AS r FROM {name}c, range({n + 1}) WHERE plon IS NOT NULL AND hi-d-1e-12<=range/{n}e0*tot AND range/{n}e0*tot<=hi+1e-12)"
    part = "CASE WHEN d>0 THEN (tg-(hi-d))/d ELSE 0e0 END"
    return f"{steps}, {at}, {name} AS (SELECT route_id, seq, plon+{part}*(lon-plon) AS lon, plat+{part}*(lat-plat) AS lat FROM {name}g WHERE r=1)"


def _collision_sql():
    b = f"{NARROW!r}e0"
    gap = f"CASE WHEN {_hit('l.ax', 'l.ay', 'l.bx', 'l.by_')} THEN 0e0 ELSE least({_ps('l.ax', 'l.ay', 'e')},{_ps('l.bx', 'l.by_', 'e')},{_ps('e.ax', 'e.ay', 'l')},{_ps('e.bx', 'e.by_', 'l')}) END"
    first = f"lg AS (SELECT route_id, slon AS ax, slat AS ay, elon AS bx, elat AS by_ FROM legs), fz AS (SELECT route_id, min(zone_id) AS zone_id FROM (SELECT route_id, e.zone_id FROM lg l, edges e GROUP BY route_id, l.ax, l.ay, l.bx, l.by_, e.zone_id HAVING min({gap})<{b}-1e-12 OR {_in('l.ax', 'l.ay')}) GROUP BY 1)"
    outer = f"md AS (SELECT zone_id, avg(ax) AS cx, avg(ay) AS cy FROM edges GROUP BY 1), ov AS (SELECT e.zone_id, i, ax+(ax-cx)/sqrt(pow(ax-cx,2)+pow(ay-cy,2))*{b}*15e-1 AS lon, ay+(ay-cy)/sqrt(pow(ax-cx,2)+pow(ay-cy,2))*{b}*15e-1 AS lat FROM edges e JOIN md ON md.zone_id=e.zone_id)"
    sides = "v AS (SELECT l.*, i, lon, lat, (elon-slon)*(lat-slat)-(elat-slat)*(lon-slon)>0 AS lf FROM fz JOIN legs l ON l.route_id=fz.route_id JOIN ov ON ov.zone_id=fz.zone_id), p AS (SELECT route_id, lf, -1 AS i, slon AS lon, slat AS lat FROM v GROUP BY ALL UNION ALL SELECT route_id, lf, i, lon, lat FROM v UNION ALL SELECT route_id, lf, 99, elon, elat FROM v GROUP BY ALL)"
    pick = "pl AS (SELECT *, coalesce(sqrt(pow(lon-lag(lon) OVER q,2)+pow(lat-lag(lat) OVER q,2)),0e0) AS d FROM p WINDOW q AS (PARTITION BY route_id, lf ORDER BY i)), ps AS (SELECT route_id, lf, sum(d) AS tot FROM pl GROUP BY 1,2), ch AS (SELECT route_id, arg_min(lf, tot+CASE WHEN lf THEN 0e0 ELSE 1e-15 END) AS lf FROM ps GROUP BY 1), pb AS (SELECT p.route_id, i, lon, lat FROM p JOIN ch ON ch.route_id=p.route_id AND ch.lf=p.lf)"
    pieces = f"pc AS (SELECT route_id, lon AS ax, lat AS ay, lead(lon) OVER q AS bx, lead(lat) OVER q AS by_ FROM det WINDOW q AS (PARTITION BY route_id ORDER BY seq)), pq AS (SELECT * FROM pc WHERE bx IS NOT NULL), {_blocked_sql('bad', 'pq', 'route_id', NARROW)}"
    turn = f"bx AS (SELECT min(ax)-{b}-1e-2 AS w, max(ax)+{b}+1e-2 AS e, min(ay)-{b}-1e-2 AS s, max(ay)+{b}+1e-2 AS n FROM edges), tn AS (SELECT l.*, k AS p, CASE WHEN k IN (0,3) THEN w ELSE e END AS wlon, CASE WHEN k IN (0,1) THEN s ELSE n END AS wlat FROM legs l JOIN bad ON bad.route_id=l.route_id, bx, (SELECT unnest([0,1,2,3]) AS k)), tl AS (SELECT route_id, p, slon AS ax, slat AS ay, wlon AS bx, wlat AS by_ FROM tn UNION ALL SELECT route_id, p, wlon, wlat, elon, elat FROM tn), {_blocked_sql('bt', 'tl', 'route_id, p', NARROW)}"
    best = "ok AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY p) AS r FROM tn WHERE NOT EXISTS (SELECT 1 FROM bt WHERE bt.route_id=tn.route_id AND bt.p=tn.p)), bn AS (SELECT route_id, 0 AS i, slon AS lon, slat AS lat FROM ok WHERE r=1 UNION ALL SELECT route_id, 1, wlon, wlat FROM ok WHERE r=1 UNION ALL SELECT route_id, 2, elon, elat FROM ok WHERE r=1)"
    every = "al AS (SELECT route_id, 'straight' AS rule, CAST(range AS INT) AS seq, slon+(elon-slon)*(range/1e1) AS lon, slat+(elat-slat)*(range/1e1) AS lat FROM legs, range(11) WHERE route_id NOT IN (SELECT route_id FROM fz) UNION ALL SELECT route_id, 'corner', seq, lon, lat FROM crn UNION ALL SELECT route_id, CASE WHEN route_id IN (SELECT route_id FROM bad) THEN 'none' ELSE 'side' END, seq, lon, lat FROM det WHERE route_id NOT IN (SELECT route_id FROM crn))"
    return f"{_L}, {first}, {outer}, {sides}, {pick}, {_even_sql('det', 'pb', 15)}, {pieces}, {turn}, {best}, {_even_sql('crn', 'bn', 10)}, {every} SELECT route_id, rule<>'none' AS clear, rule, seq, {_r('lon', 5)} AS lon, {_r('lat', 5)} AS lat FROM al"


def _detour_sql():
    ends = "SELECT route_id, zone_id, lf, -1 AS i, slon AS lon, slat AS lat FROM v GROUP BY ALL UNION ALL SELECT route_id, zone_id, lf, i, lon, lat FROM v UNION ALL SELECT route_id, zone_id, lf, 99, elon, elat FROM v GROUP BY ALL"
    ways = f"{_L}, {_hits('legs', ['route_id'])}, v AS (SELECT h.route_id, h.zone_id, e.i, e.ax AS lon, e.ay AS lat, slon, slat, elon, elat, (elon-slon)*(e.ay-slat)-(elat-slat)*(e.ax-slon)>0 AS lf FROM hits h JOIN legs l ON l.route_id=h.route_id JOIN edges e ON e.zone_id=h.zone_id), p AS ({ends})"
    walk = "w AS (SELECT *, lag(lon) OVER q AS plon, lag(lat) OVER q AS plat FROM p WINDOW q AS (PARTITION BY route_id, zone_id, lf ORDER BY i)), st AS (SELECT *, coalesce(sqrt(pow(lon-plon,2)+pow(lat-plat,2)),0e0) AS d FROM w), cu AS (SELECT *, sum(d) OVER (PARTITION BY route_id, zone_id, lf ORDER BY i) AS hi, sum(d) OVER (PARTITION BY route_id, zone_id, lf) AS tot FROM st)"
    pick = "ch AS (SELECT route_id, zone_id, arg_min(lf, tot + CASE WHEN lf THEN 0e0 ELSE 1e-15 END) AS lf FROM cu GROUP BY 1,2), sg AS (SELECT cu.* FROM cu JOIN ch USING (route_id, zone_id, lf) WHERE plon IS NOT NULL)"
    at = "g AS (SELECT *, range AS seq, range/15e0*tot AS tg, row_number() OVER (PARTITION BY route_id, zone_id, range ORDER BY i) AS r FROM sg, range(16) WHERE hi-d-1e-12<=range/15e0*tot AND range/15e0*tot<=hi+1e-12)"
    t_ = "CASE WHEN d>0 THEN (tg-(hi-d))/d ELSE 0e0 END"
    return f"{ways}, {walk}, {pick}, {at} SELECT route_id, zone_id, CAST(seq AS INT) AS seq, {_r(f'plon+{t_}*(lon-plon)', 5)} AS lon, {_r(f'plat+{t_}*(lat-plat)', 5)} AS lat FROM g WHERE r=1"


SQL = {
    "visibility_graph": f"{_E}, {_graph_sql()} SELECT a, b, {_r('far')} AS far FROM vg",
    "shortest_routes": _shortest_sql(),
    "collision_free_routes": _collision_sql(),
    "best_detour": _detour_sql(),
    "clipped_zones": _clip_sql(),
    "clean_water": _clean_sql(),
    "rivers_d8": _rivers_sql(),
    "traj_length_km": f"{t.ctes('tracks')}, s AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM tracks WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, {_r('sum(coalesce(2*6371e0*asin(sqrt(pow(sin(radians(lat-plat)/2),2)+cos(radians(plat))*cos(radians(lat))*pow(sin(radians(lon-plon)/2),2))),0e0))')} AS km, count(*) AS points FROM s GROUP BY 1",
    "track_bounds": f"{t.ctes('tracks')} SELECT user_id, {_r('min(lon)')} AS min_lon, {_r('min(lat)')} AS min_lat, {_r('max(lon)')} AS max_lon, {_r('max(lat)')} AS max_lat FROM tracks GROUP BY 1",
    "zone_area": f"{_E}, a AS (SELECT zone_id, abs(sum(ax*by_-bx*ay))/2e0 AS area, min(ax) AS x0, max(ay) AS y1 FROM edges GROUP BY 1), q AS (SELECT a.*, zone_type, row_number() OVER (PARTITION BY zone_type ORDER BY area DESC, a.zone_id) AS r FROM a JOIN zone0 z ON z.zone_id=a.zone_id) SELECT zone_id, zone_type, {_r('area', 9)} AS area, {_r('x0')} AS min_lon, {_r('y1')} AS max_lat, r=1 AS largest FROM q",
    "zone_vertices": f"{_E} SELECT zone_id, i, {_r('ax')} AS lon, {_r('ay')} AS lat, {_r('(ax+bx)/2')} AS mid_lon, {_r('(ay+by_)/2')} AS mid_lat FROM edges",
    "offset_vertices": f"{_E}, c AS (SELECT zone_id, avg(ax) AS cx, avg(ay) AS cy FROM edges GROUP BY 1), v AS (SELECT e.zone_id, i, ax, ay, ax-cx AS dx, ay-cy AS dy FROM edges e JOIN c ON c.zone_id=e.zone_id) SELECT zone_id, i, {_r('ax+dx/sqrt(dx*dx+dy*dy)*1e-2')} AS lon, {_r('ay+dy/sqrt(dx*dx+dy*dy)*1e-2')} AS lat FROM v",
    "point_in_zone": f"{_PZ} SELECT id, zone_id FROM pz",
    "route_zone_hits": f"{_L}, {_hits('legs', ['route_id'])} SELECT route_id, zone_id FROM hits",
    "first_blocking": f"{_L}, {_hits('legs', ['route_id'])}, f AS (SELECT route_id, min(zone_id) AS z, count(*) AS n FROM hits GROUP BY 1) SELECT l.route_id, z IS NULL AS clear, z AS first_zone, coalesce(n,0) AS blocked FROM legs l LEFT JOIN f ON f.route_id=l.route_id",
    "invalid_routes": f"{_L}, {_hits('legs', ['route_id'])} SELECT (SELECT count(DISTINCT route_id) FROM hits) AS invalid, (SELECT count(*) FROM legs) AS routes",
    "zone_min_distance": f"{_E}, {_DIST} SELECT a, b, {_r('dist')} AS dist FROM zd",
    "zones_within": f"{_E}, {_DIST} SELECT a, b, {_r('dist')} AS dist FROM zd WHERE dist<=36e-3",
    "zone_nearest": f"{_E}, {_DIST}, both_ AS (SELECT a AS zone_id, b AS nearest, dist FROM zd UNION ALL SELECT b, a, dist FROM zd), k AS (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY dist, nearest) AS r FROM both_) SELECT zone_id, nearest, {_r('dist')} AS dist FROM k WHERE r=1",
    "adaptive_buffer": f"{_E}, {_DIST} SELECT {_r('CASE WHEN count(*)=0 OR min(dist)>=36e-3 THEN 18e-3 ELSE greatest(5e-3,3e-1*min(dist)) END')} AS buffer, {_r('min(dist)')} AS least FROM zd",
    "straight_waypoints": f"{t.ctes('legs')} SELECT route_id, CAST(range AS INT) AS seq, {_r('slon+(elon-slon)*(range/1e1)')} AS lon, {_r('slat+(elat-slat)*(range/1e1)')} AS lat FROM legs, range(11)",
    "resample_rings": f"{_E}, f AS (SELECT *, sqrt(pow(bx-ax,2)+pow(by_-ay,2)) AS st, sum(sqrt(pow(bx-ax,2)+pow(by_-ay,2))) OVER (PARTITION BY zone_id ORDER BY i) AS hi FROM edges), q AS (SELECT *, hi-st AS lo, max(hi) OVER (PARTITION BY zone_id) AS tot FROM f), p AS (SELECT zone_id, CAST(range AS INT) AS seq, range/15e0*tot AS tg, i, ax, ay, bx, by_, lo, hi FROM q, range(16)), w AS (SELECT *, row_number() OVER (PARTITION BY zone_id, seq ORDER BY i) AS r FROM p WHERE lo-1e-12<=tg AND tg<=hi+1e-12) SELECT zone_id, seq, {_r('ax+(tg-lo)/(hi-lo)*(bx-ax)', 5)} AS lon, {_r('ay+(tg-lo)/(hi-lo)*(by_-ay)', 5)} AS lat FROM w WHERE r=1",
    "detour_side": f"{_L}, {_hits('legs', ['route_id'])}, v AS (SELECT h.route_id, h.zone_id, e.i, e.ax AS lon, e.ay AS lat, slon, slat, elon, elat, (elon-slon)*(e.ay-slat)-(elat-slat)*(e.ax-slon)>0 AS lf FROM hits h JOIN legs l ON l.route_id=h.route_id JOIN edges e ON e.zone_id=h.zone_id), s AS (SELECT *, lag(lon,1,slon) OVER w AS plon, lag(lat,1,slat) OVER w AS plat, lead(i) OVER w IS NULL AS fin FROM v WINDOW w AS (PARTITION BY route_id, zone_id, lf ORDER BY i)), n AS (SELECT route_id, zone_id, lf, sum(sqrt(pow(lon-plon,2)+pow(lat-plat,2))+CASE WHEN fin THEN sqrt(pow(elon-lon,2)+pow(elat-lat,2)) ELSE 0e0 END) AS len FROM s GROUP BY 1,2,3), m AS (SELECT route_id, zone_id, max(len) FILTER (WHERE lf) AS l, max(len) FILTER (WHERE NOT lf) AS r FROM n GROUP BY 1,2) SELECT route_id, zone_id, {_r('l')} AS left_length, {_r('r')} AS right_length, CASE WHEN l IS NOT NULL AND (r IS NULL OR l<=r) THEN 'left' ELSE 'right' END AS side FROM m",
    "bbox_detour": f"{_L}, {_hits('legs', ['route_id'])}, bx AS (SELECT h.route_id, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM hits h JOIN edges e ON e.zone_id=h.zone_id GROUP BY 1), c AS (SELECT l.*, p, CASE p WHEN 0 THEN (slon+elon)/2 WHEN 1 THEN (slon+elon)/2 WHEN 2 THEN x1+1e-1 ELSE x0-1e-1 END AS wlon, CASE p WHEN 0 THEN y1+1e-1 WHEN 1 THEN y0-1e-1 ELSE (slat+elat)/2 END AS wlat FROM legs l JOIN bx ON bx.route_id=l.route_id, (VALUES (0),(1),(2),(3)) v(p)), sg AS (SELECT route_id, p, slon, slat, wlon AS elon, wlat AS elat FROM c UNION ALL SELECT route_id, p, wlon, wlat, elon, elat FROM c), {_hits('sg', ['route_id', 'p'], 'bad')}, ok AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY p) AS r FROM c WHERE (route_id,p) NOT IN (SELECT (route_id,p) FROM bad)) SELECT route_id, p AS way, {_r('wlon')} AS lon, {_r('wlat')} AS lat FROM ok WHERE r=1",
    "visibility_edges": f"{_E}, v AS (SELECT zone_id, avg(ax) AS lon, avg(ay) AS lat FROM edges GROUP BY 1), pr AS (SELECT p.zone_id AS a, q.zone_id AS b, p.lon AS slon, p.lat AS slat, q.lon AS elon, q.lat AS elat FROM v p JOIN v q ON p.zone_id<q.zone_id), {_hits('pr', ['a', 'b'])} SELECT a, b, {_r('sqrt(pow(elon-slon,2)+pow(elat-slat,2))')} AS w FROM pr WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.a=pr.a AND h.b=pr.b AND h.zone_id<>pr.a AND h.zone_id<>pr.b)",
    "snap_outside": f"{_PZ}, {_MOVES}, ins AS (SELECT DISTINCT id, lon, lat FROM pz), tr AS (SELECT id, p, lon+dx AS lon, lat+dy AS lat FROM ins, mv), bad AS (SELECT DISTINCT id, p FROM (SELECT id, p, e.zone_id FROM tr, edges e GROUP BY id, p, lon, lat, e.zone_id HAVING {_in('tr.lon', 'tr.lat')})), fr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS r FROM tr WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.id=tr.id AND b.p=tr.p)) SELECT id, p AS try, {_r('lon')} AS lon, {_r('lat')} AS lat FROM fr WHERE r=1",
    "d8_direction": f"{_GR}, {_D8} SELECT y, x, CAST(dir AS INT) AS dir FROM dd",
    "flow_accumulation": _GR.replace("WITH ", "WITH RECURSIVE ") + f", {_D8}, dn AS (SELECT y, x, y+dy AS ty, x+dx AS tx FROM dd JOIN o8 ON k=dir), wk AS (SELECT y AS oy, x AS ox, y, x FROM grid UNION ALL SELECT oy, ox, ty, tx FROM wk JOIN dn ON dn.y=wk.y AND dn.x=wk.x) SELECT y, x, count(*) AS acc FROM wk GROUP BY 1,2",
    "mask_regions": _GR.replace("WITH ", "WITH RECURSIVE ") + ", c AS (SELECT y, x, CAST(y AS BIGINT)*4294967296+x AS id FROM grid WHERE z>250000), ad AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON (b.y=a.y AND b.x=a.x+1) UNION ALL SELECT a.id, b.id FROM c a JOIN c b ON (b.y=a.y+1 AND b.x=a.x)), e AS (SELECT a, b FROM ad UNION ALL SELECT b, a FROM ad), r AS (SELECT id AS a, id AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON e.a=r.b), l AS (SELECT a, min(b) AS label FROM r GROUP BY 1) SELECT label, count(*) AS cells, count(*)>=5 AS kept FROM l GROUP BY 1",
    "mask_sets": f"{_GR}, a AS (SELECT y, x FROM grid WHERE z>200000), b AS (SELECT y, x FROM grid WHERE x%3=0), u AS (SELECT 'union' AS op, y, x FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'difference', y, x FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'intersection', y, x FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) SELECT op, count(*) AS cells, CAST(sum(y*100+x) AS BIGINT) AS checksum FROM u GROUP BY 1",
}
