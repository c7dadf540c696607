"""Points, segments and rings as arrays of (lon, lat): predicates as column expressions, joins by grid cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width in degrees of the cells that pair points and segments with rings.
CELL = 0.02


def edges(ring):
    """Array of (ax, ay, bx, by) of a closed ring."""
    return F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a["lon"].alias("ax"), a["lat"].alias("ay"), b["lon"].alias("bx"), b["lat"].alias("by")))


def contains(ring, lon, lat):
    """Whether a place is inside a ring: an odd number of edges to its east."""
    hit = lambda e: ((e["ay"] > lat) != (e["by"] > lat)) & (lon < (e["bx"] - e["ax"]) * (lat - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"])
    return F.aggregate(edges(ring), F.lit(0), lambda n, e: n + F.when(hit(e), 1).otherwise(0)) % 2 == 1


def _cross(ax, ay, bx, by, cx, cy):
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy):
    """Whether two segments have a point in common."""
    d1, d2 = _cross(ax, ay, bx, by, cx, cy), _cross(ax, ay, bx, by, dx, dy)
    d3, d4 = _cross(cx, cy, dx, dy, ax, ay), _cross(cx, cy, dx, dy, bx, by)
    on = lambda px, py, qx, qy, rx, ry: (F.least(px, qx) <= rx) & (rx <= F.greatest(px, qx)) & (F.least(py, qy) <= ry) & (ry <= F.greatest(py, qy))
    proper = (((d1 > 0) & (d2 < 0)) | ((d1 < 0) & (d2 > 0))) & (((d3 > 0) & (d4 < 0)) | ((d3 < 0) & (d4 > 0)))
    touch = ((d1 == 0) & on(ax, ay, bx, by, cx, cy)) | ((d2 == 0) & on(ax, ay, bx, by, dx, dy)) | ((d3 == 0) & on(cx, cy, dx, dy, ax, ay)) | ((d4 == 0) & on(cx, cy, dx, dy, bx, by))
    return proper | touch


def crosses(ring, ax, ay, bx, by):
    """Whether a segment meets a ring or its inside."""
    return F.exists(edges(ring), lambda e: segments_cross(ax, ay, bx, by, e["ax"], e["ay"], e["bx"], e["by"])) | contains(ring, ax, ay)


def point_segment(px, py, ax, ay, bx, by):
    """Distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    t = F.coalesce(((px - ax) * dx + (py - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.sqrt(F.pow(px - (ax + t * dx), 2) + F.pow(py - (ay + t * dy), 2))


def area(ring):
    """Area of a ring by the shoelace formula."""
    return F.abs(F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + e["ax"] * e["by"] - e["bx"] * e["ay"])) / 2.0


def bounds(zones: DataFrame) -> DataFrame:
    """zones with min_lon, max_lon, min_lat and max_lat of the ring."""
    lon, lat = F.transform("ring", lambda v: v["lon"]), F.transform("ring", lambda v: v["lat"])
    return zones.withColumns({"min_lon": F.array_min(lon), "max_lon": F.array_max(lon), "min_lat": F.array_min(lat), "max_lat": F.array_max(lat)})


def _cells(low, high, width: float):
    return F.sequence(F.floor(low / width).cast("bigint"), F.floor(high / width).cast("bigint"))


def tile(frame: DataFrame, lon0, lon1, lat0, lat1, width: float = CELL) -> DataFrame:
    """A row for each cell that a bounding box touches, in columns _cx and _cy."""
    return frame.withColumn("_cx", F.explode(_cells(lon0, lon1, width))).withColumn("_cy", F.explode(_cells(lat0, lat1, width)))


def points_in_zones(points: DataFrame, zones: DataFrame) -> DataFrame:
    """(point columns, zone_id) for each zone that a point is in: an equi-join of cells, then the predicate."""
    z = bounds(zones)
    z = tile(z, F.col("min_lon"), F.col("max_lon"), F.col("min_lat"), F.col("max_lat")).select("zone_id", "ring", "_cx", "_cy")
    p = points.withColumns({"_cx": F.floor(F.col("lon") / CELL).cast("bigint"), "_cy": F.floor(F.col("lat") / CELL).cast("bigint")})
    return p.join(z, ["_cx", "_cy"]).where(contains(F.col("ring"), F.col("lon"), F.col("lat"))).select(*points.columns, "zone_id")


def segments_on_zones(segments: DataFrame, zones: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, zone_id) for each zone that a segment (slon, slat, elon, elat) meets."""
    z = bounds(zones)
    z = tile(z, F.col("min_lon"), F.col("max_lon"), F.col("min_lat"), F.col("max_lat")).select("zone_id", "ring", "_cx", "_cy")
    s = tile(segments, F.least("slon", "elon"), F.greatest("slon", "elon"), F.least("slat", "elat"), F.greatest("slat", "elat"))
    return s.join(z, ["_cx", "_cy"]).where(crosses(F.col("ring"), F.col("slon"), F.col("slat"), F.col("elon"), F.col("elat"))).select(*keys, "zone_id").distinct()


def _edge_gap(p, q):
    """Least distance of two edges, 0 if they meet."""
    near = F.least(
        point_segment(p["ax"], p["ay"], q["ax"], q["ay"], q["bx"], q["by"]), point_segment(p["bx"], p["by"], q["ax"], q["ay"], q["bx"], q["by"]),
        point_segment(q["ax"], q["ay"], p["ax"], p["ay"], p["bx"], p["by"]), point_segment(q["bx"], q["by"], p["ax"], p["ay"], p["bx"], p["by"]),
    )
    return F.when(segments_cross(p["ax"], p["ay"], p["bx"], p["by"], q["ax"], q["ay"], q["bx"], q["by"]), 0.0).otherwise(near)


def edge_gaps(p, q) -> np.ndarray:
    """_edge_gap() of two sequences (ax, ay, bx, by) of arrays."""

    def spot(x, y, ax, ay, bx, by):
        dx, dy = bx - ax, by - ay
        n = dx * dx + dy * dy
        t = np.clip(np.where(n > 0, ((x - ax) * dx + (y - ay) * dy) / np.where(n > 0, n, 1.0), 0.0), 0.0, 1.0)
        return np.sqrt((x - (ax + t * dx)) ** 2 + (y - (ay + t * dy)) ** 2)

    d = [np.sign(_cross(*s, *end)) for s, o in ((p, q), (q, p)) for end in (o[:2], o[2:])]
    near = np.minimum(np.minimum(spot(*p[:2], *q), spot(*p[2:], *q)), np.minimum(spot(*q[:2], *p), spot(*q[2:], *p)))
    return np.where((d[0] * d[1] < 0) & (d[2] * d[3] < 0), 0.0, near)


def ring_distance(one, two):
    """Least distance of two rings with their insides."""
    edge = F.aggregate(edges(one), F.lit(float("inf")), lambda m, p: F.least(m, F.aggregate(edges(two), F.lit(float("inf")), lambda k, q: F.least(k, _edge_gap(p, q)))))
    first = lambda r, c: F.element_at(r, 1)[c]
    within = contains(two, first(one, "lon"), first(one, "lat")) | contains(one, first(two, "lon"), first(two, "lat"))
    return F.when(within, 0.0).otherwise(edge)


def _boxes(zones: DataFrame, reach: float, width: float) -> DataFrame:
    """A row for each cell of that width which a zone's box, widened by the reach, touches."""
    at = lambda c, pad: F.floor((F.col(c) + pad) / width).cast("bigint")
    span = lambda c: F.explode(F.sequence(at(f"min_{c}", -reach), at(f"max_{c}", reach)))
    return zones.withColumn("_cx", span("lon")).withColumn("_cy", span("lat"))


def _candidates(some: DataFrame, zones: DataFrame, reach: float, width: float) -> DataFrame:
    """(a, b, ring, other): zones b whose boxes are within reach of those of some zones a, each pair once."""
    gap = lambda c: F.greatest(F.col(f"min_{c}") - F.col(f"_max_{c}"), F.col(f"_min_{c}") - F.col(f"max_{c}"))
    left = _boxes(some.withColumnRenamed("zone_id", "a"), reach, width)
    right = _boxes(zones.select(F.col("zone_id").alias("b"), F.col("ring").alias("other"), "min_lon", "max_lon", "min_lat", "max_lat"), 0.0, width)
    right = right.withColumnsRenamed({c: f"_{c}" for c in ("min_lon", "max_lon", "min_lat", "max_lat")})
    # a pair meets in many cells: it counts in the one where its boxes' common corner lies
    corner = lambda c: F.floor(F.greatest(F.col(f"min_{c}") - reach, F.col(f"_min_{c}")) / width).cast("bigint")
    met = left.join(right, ["_cx", "_cy"]).where((F.col("a") != F.col("b")) & (F.col("_cx") == corner("lon")) & (F.col("_cy") == corner("lat")))
    return met.where((gap("lon") <= reach) & (gap("lat") <= reach)).select("a", "b", "ring", "other")


def zones_within(zones: DataFrame, radius: float) -> DataFrame:
    """(a, b, dist) of each pair of zones a < b that are within the radius: 0 if they meet or one holds the other. Zones
    meet by cells as wide as the radius, one side's boxes widened by it."""
    z = bounds(zones)
    near = _candidates(z, z, radius, max(radius, CELL)).where("a < b")
    return near.select("a", "b", ring_distance(F.col("ring"), F.col("other")).alias("dist")).where(F.col("dist") <= radius)


def nearest_zones(zones: DataFrame, first_reach: float = CELL) -> DataFrame:
    """(zone_id, nearest, dist): each zone's nearest other zone, however far (of equals the smallest id; null where there
    is none). Rounds of a doubling reach, over cells that grow with it: a zone leaves once something is found within the
    reach, for then nothing beyond can be nearer; only the others go on. Each round is written, its predecessor deleted."""
    from cartosea.operators.graph import discard, staged

    z = bounds(zones.select("zone_id", "ring"))
    left, reach, found = staged(z), first_reach, []
    whole = z.agg(F.max("max_lon") - F.min("min_lon"), F.max("max_lat") - F.min("min_lat")).first()
    most = max(whole[0] or 0.0, whole[1] or 0.0)
    while not left.isEmpty():
        last = reach > most
        near = _candidates(left, z, reach, max(reach, CELL)).select("a", "b", ring_distance(F.col("ring"), F.col("other")).alias("dist"))
        best = near.where(F.col("dist") <= reach * (1.5 if last else 1.0)).groupBy("a").agg(F.min(F.struct("dist", "b")).alias("n"))
        got = staged(left.join(best, F.col("zone_id") == F.col("a"), "left").select(*z.columns, "n"))
        found.append(got.where(F.lit(last) | F.col("n").isNotNull()).select("zone_id", F.col("n.b").alias("nearest"), F.col("n.dist").alias("dist")))
        discard(left)
        if last:
            break
        left, reach = staged(got.where("n is null").select(*z.columns)), 2.0 * reach
    out = found[0] if found else z.select("zone_id", F.lit(None).cast("bigint").alias("nearest"), F.lit(None).cast("double").alias("dist"))
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def zone_distances(zones: DataFrame, blocks: int = 16) -> DataFrame:
    """(a, b, dist) of every pair of zones a < b: a matrix, as long as the square of the zones. Pairs of blocks of zones
    meet, each in a task of its own. nearest_zones() and zones_within() do without the matrix."""
    block = F.pmod(F.xxhash64("zone_id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = zones.select(F.col("zone_id").alias("a"), "ring", block.alias("_i"), every.alias("_j"))
    b = zones.select(F.col("zone_id").alias("b"), F.col("ring").alias("other"), every.alias("_i"), block.alias("_j"))
    return a.join(b, ["_i", "_j"]).where("a < b").select("a", "b", ring_distance(F.col("ring"), F.col("other")).alias("dist"))


def clip_rings(zones: DataFrame, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
    """zones with their rings cut to a box (corners low and high as lon, lat), one side after the other; zones outside
    go. What a cut leaves in several parts stays one ring along the box's side, of the parts' area. Windows run along
    one zone's vertices."""
    step = Window.partitionBy("zone_id").orderBy("s")
    whole = step.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    places = zones.select("zone_id", F.posexplode(F.slice("ring", 1, F.size("ring") - 1)).alias("s", "p")).select("zone_id", F.col("s").cast("bigint").alias("s"), "p.lon", "p.lat")
    for at, bound, sign in (("lon", low[0], 1.0), ("lon", high[0], -1.0), ("lat", low[1], 1.0), ("lat", high[1], -1.0)):
        other = "lat" if at == "lon" else "lon"
        came = places.withColumns({f"_{c}": F.coalesce(F.lag(c).over(step), F.last(c).over(whole)) for c in ("lon", "lat")})
        came = came.withColumns({"_here": (F.col(f"_{at}") - bound) * sign >= 0, "_there": (F.col(at) - bound) * sign >= 0})
        t = (bound - F.col(f"_{at}")) / F.nullif(F.col(at) - F.col(f"_{at}"), F.lit(0.0))
        meet = {at: F.lit(bound), other: F.col(f"_{other}") + t * (F.col(other) - F.col(f"_{other}"))}
        both = F.array(
            F.struct(F.lit(0).alias("k"), (F.col("_here") != F.col("_there")).alias("on"), *[meet[c].alias(c) for c in ("lon", "lat")]),
            F.struct(F.lit(1).alias("k"), F.col("_there").alias("on"), "lon", "lat"),
        )
        places = came.select("zone_id", "s", F.explode(both).alias("o")).where("o.on").select("zone_id", (F.col("s") * 2 + F.col("o.k")).alias("s"), "o.lon", "o.lat")
    rings = places.groupBy("zone_id").agg(F.array_sort(F.collect_list(F.struct("s", "lon", "lat"))).alias("v"))
    ring = F.transform("v", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    return zones.drop("ring").join(rings.select("zone_id", F.concat(ring, F.slice(ring, 1, 1)).alias("ring")), "zone_id")


def smooth_rings(zones: DataFrame, distance, arc: int = 8) -> DataFrame:
    """zones with the outward corners of their rings rounded, as if each ring were moved in by the distance and out again:
    an arc of that radius (arc + 1 points) touches both edges, a smaller one where half an edge is shorter than its
    tangent. Inward corners stay. The area never grows, and a ring that doesn't cross itself doesn't afterwards."""
    n = F.size("ring") - 1
    turned = F.aggregate(edges(F.col("ring")), F.lit(0.0), lambda s, e: s + e["ax"] * e["by"] - e["bx"] * e["ay"])
    z = zones.withColumns({"_way": F.when(turned < 0, -1.0).otherwise(1.0), "_far": distance})
    v = lambda i: F.element_at("ring", (F.pmod(i, n) + 1).cast("int"))

    def corner(i):
        p, h, q = v(i - 1), v(i), v(i + 1)
        one = F.struct((h["lon"] - p["lon"]).alias("x"), (h["lat"] - p["lat"]).alias("y"), F.sqrt(F.pow(h["lon"] - p["lon"], 2) + F.pow(h["lat"] - p["lat"], 2)).alias("d"))
        two = F.struct((q["lon"] - h["lon"]).alias("x"), (q["lat"] - h["lat"]).alias("y"), F.sqrt(F.pow(q["lon"] - h["lon"], 2) + F.pow(q["lat"] - h["lat"], 2)).alias("d"))
        return F.struct(h["lon"].alias("lon"), h["lat"].alias("lat"), one.alias("one"), two.alias("two"))

    def bend(c):
        a, b = c["one"], c["two"]
        turn = F.atan2((a["x"] * b["y"] - a["y"] * b["x"]) * F.col("_way"), a["x"] * b["x"] + a["y"] * b["y"])
        return F.struct(c["lon"].alias("lon"), c["lat"].alias("lat"), (a["x"] / a["d"]).alias("ux"), (a["y"] / a["d"]).alias("uy"), turn.alias("turn"), F.least(F.col("_far") * F.tan(turn / 2), F.least(a["d"], b["d"]) / 2).alias("t"))

    def rounded(c):
        r = c["t"] / F.tan(c["turn"] / 2)
        sx, sy = c["lon"] - c["ux"] * c["t"], c["lat"] - c["uy"] * c["t"]
        nx, ny = -c["uy"] * F.col("_way") * r, c["ux"] * F.col("_way") * r  # from the arc's start to its middle

        def at(k):
            w = F.col("_way") * c["turn"] * k / float(arc)
            return F.struct((sx + nx - nx * F.cos(w) + ny * F.sin(w)).alias("lon"), (sy + ny - nx * F.sin(w) - ny * F.cos(w)).alias("lat"))

        sharp = F.array(F.struct(c["lon"].alias("lon"), c["lat"].alias("lat")))
        return F.when((c["turn"] > 1e-9) & (c["turn"] < 3.14159), F.transform(F.sequence(F.lit(0), F.lit(arc)), at)).otherwise(sharp)

    bends = z.withColumn("_c", F.transform(F.transform(F.sequence(F.lit(0), n - 1), corner), bend))
    ring = bends.withColumn("ring", F.flatten(F.transform("_c", rounded)))
    return ring.withColumn("ring", F.concat("ring", F.slice("ring", 1, 1))).drop("_way", "_far", "_c")


def ring_faults(zones: DataFrame) -> DataFrame:
    """(zone_id, closed, vertices, crossings, valid) of each ring: crossings are pairs of its edges, not neighbours, that have
    a point in common. Edges of a ring meet by cells, so a ring of any length takes no pass over all its pairs."""
    e = zones.select("zone_id", F.size("ring").alias("n"), F.posexplode(edges(F.col("ring"))).alias("i", "e"))
    box = tile(e, F.least("e.ax", "e.bx"), F.greatest("e.ax", "e.bx"), F.least("e.ay", "e.by"), F.greatest("e.ay", "e.by"))
    other = box.select("zone_id", "_cx", "_cy", F.col("i").alias("j"), F.col("e").alias("q"))
    far = (F.col("j") > F.col("i") + 1) & ~((F.col("i") == 0) & (F.col("j") == F.col("n") - 2))
    p, q = F.col("e"), F.col("q")
    crossed = box.join(other, ["zone_id", "_cx", "_cy"]).where(far & segments_cross(p["ax"], p["ay"], p["bx"], p["by"], q["ax"], q["ay"], q["bx"], q["by"]))
    count = crossed.select("zone_id", "i", "j").distinct().groupBy("zone_id").agg(F.count("*").alias("crossings"))
    whole = zones.select("zone_id", (F.element_at("ring", 1) == F.element_at("ring", -1)).alias("closed"), (F.size("ring") - 1).alias("vertices"), area(F.col("ring")).alias("_area"))
    out = whole.join(count, "zone_id", "left").withColumn("crossings", F.coalesce("crossings", F.lit(0)))
    return out.select("zone_id", "closed", "vertices", "crossings", (F.col("closed") & (F.col("vertices") >= 3) & (F.col("crossings") == 0) & (F.col("_area") > 0)).alias("valid"))


def adaptive_buffer(least, count, low: float = 0.005, high: float = 0.018):
    """Buffer around zones: smaller where the closest two are near each other."""
    return F.when((count < 2) | (least >= 2 * high), high).otherwise(F.greatest(F.lit(low), 0.3 * least))


def track_length(tracks: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, km, points): haversine length of each track in its order."""
    from cartosea.functions.geo import haversine_km

    w = Window.partitionBy(key).orderBy(*order)
    step = haversine_km(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    return tracks.withColumn("_km", F.coalesce(step, F.lit(0.0))).groupBy(key).agg(F.sum("_km").alias("km"), F.count("*").alias("points"))


def straight_waypoints(legs: DataFrame, n: int) -> DataFrame:
    """legs' key with seq, lon and lat of n + 1 evenly spaced points."""
    t = F.col("seq") / float(n)
    return legs.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(n)))).select("route_id", "seq", (F.col("slon") + (F.col("elon") - F.col("slon")) * t).alias("lon"), (F.col("slat") + (F.col("elat") - F.col("slat")) * t).alias("lat"))


def resample(lines: DataFrame, key: str, n: int) -> DataFrame:
    """(key, seq, lon, lat): n + 1 points at even steps along each polyline (key, i, lon, lat)."""
    w = Window.partitionBy(key).orderBy("i")
    step = F.sqrt(F.pow(F.col("lon") - F.lag("lon").over(w), 2) + F.pow(F.col("lat") - F.lag("lat").over(w), 2))
    far = lines.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("hi", F.sum("_step").over(w))
    seg = far.withColumns({"lo": F.lag("hi").over(w), "plon": F.lag("lon").over(w), "plat": F.lag("lat").over(w)}).where("lo is not null")
    total = far.groupBy(key).agg(F.max("hi").alias("total"))
    want = total.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("target", F.col("seq") / float(n) * F.col("total"))
    inside = want.join(seg, key).where("lo <= target and target <= hi")
    t = F.when(F.col("hi") > F.col("lo"), (F.col("target") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).otherwise(0.0)
    at = inside.withColumns({"_lon": F.col("plon") + t * (F.col("lon") - F.col("plon")), "_lat": F.col("plat") + t * (F.col("lat") - F.col("plat"))})
    first = at.groupBy(key, "seq").agg(F.min_by(F.struct("_lon", "_lat"), "i").alias("p"))
    return first.select(key, "seq", F.col("p._lon").alias("lon"), F.col("p._lat").alias("lat"))
