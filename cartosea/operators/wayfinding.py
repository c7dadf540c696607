"""Routes around zones planned as a set: every step takes the routes that are still open and leaves the rest alone.

A buffered zone is the set of places nearer than the buffer to it. Segments meet zones by cells: a segment walks the
cells along its length, a zone lies in those of its box, and an exact distance decides. Ends inside buffered zones are
moved out, clear legs are done; the others look for a shortest way over the visibility graph of the zones' pushed-out
corners, relaxed round by round for all routes together; what is still open tries ways around the box of all zones. No
row holds more than one zone, and each round is written to the shared folder, its predecessor deleted.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartosea.operators import geometry as g
from cartosea.operators.graph import discard, staged

#: Places tried around an end, in order, in steps of STEP degrees; ways of pushing a corner out, in half steps.
STEP, RINGS, FIRST_RINGS, PUSHES = 0.005, 19, 4, 7
#: Points of a tile that go into one task, and nodes times edges that it looks at at once.
PART, SIGHTS = 4096, 1 << 14
DIRECTIONS = [(1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, 1), (1, -1), (-1, -1)]


def walk(segments: DataFrame, reach: float, width: float = g.CELL) -> DataFrame:
    """A row for each cell (_cx, _cy) within reach of a segment: column by column, as many as the segment is long."""
    at = lambda v: F.floor(v / width).cast("bigint")
    low, high = F.least("slon", "elon"), F.greatest("slon", "elon")
    columns = segments.withColumn("_cx", F.explode(F.sequence(at(low - reach), at(high + reach))))
    # the part of the segment in the column, widened by the reach
    slope = (F.col("elat") - F.col("slat")) / F.nullif(F.col("elon") - F.col("slon"), F.lit(0.0))
    height = lambda x: F.col("slat") + slope * (F.least(F.greatest(x, low), high) - F.col("slon"))
    one, two = height(F.col("_cx") * width - reach), height((F.col("_cx") + 1) * width + reach)
    bottom, top = F.coalesce(F.least(one, two), F.least("slat", "elat")), F.coalesce(F.greatest(one, two), F.greatest("slat", "elat"))
    flat = F.when(slope.isNull(), F.least("slat", "elat")).otherwise(bottom), F.when(slope.isNull(), F.greatest("slat", "elat")).otherwise(top)
    return columns.withColumn("_cy", F.explode(F.sequence(at(flat[0] - reach), at(flat[1] + reach))))


def _inside(points: DataFrame, zones: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _zone) of the points (lon, lat) in zones: by cell, by box, then by the ring."""
    z = g.bounds(zones)
    z = g.tile(z, F.col("min_lon"), F.col("max_lon"), F.col("min_lat"), F.col("max_lat")).select(F.col("zone_id").alias("_zone"), "ring", "_cx", "_cy", "min_lon", "max_lon", "min_lat", "max_lat")
    p = points.withColumns({"_cx": F.floor(F.col("lon") / g.CELL).cast("bigint"), "_cy": F.floor(F.col("lat") / g.CELL).cast("bigint")})
    boxed = F.lit(True)
    for c in ("lon", "lat"):
        boxed = boxed & (F.col(c) >= F.col(f"min_{c}") - 1e-9) & (F.col(c) <= F.col(f"max_{c}") + 1e-9)
    return p.join(z, ["_cx", "_cy"]).where(boxed & g.contains(F.col("ring"), F.col("lon"), F.col("lat"))).select(*keys, "_zone")


def _edge_cells(zones: DataFrame, width: float = g.CELL) -> DataFrame:
    """A row (_zone, ax, ay, bx, by, _cx, _cy) for each edge of the zones and each cell of its box."""
    e = zones.select(F.col("zone_id").alias("_zone"), F.explode(g.edges(F.col("ring"))).alias("e")).select("_zone", "e.*")
    return g.tile(e, F.least("ax", "bx"), F.greatest("ax", "bx"), F.least("ay", "by"), F.greatest("ay", "by"), width)


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """frame in as many parts as a shuffle has: each of its few rows stands for much work."""
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def blocked(segments: DataFrame, zones: DataFrame, keys: list[str], buffer: float) -> DataFrame:
    """(keys, zone_id) of the segments (slon, slat, elon, elat) that a zone keeps from passing: nearer than the buffer, or
    begun inside. Segments meet edges as plain rows; those with an edge whole on one side, a buffer away from their line,
    need no distance."""
    leg = {"ax": F.col("slon"), "ay": F.col("slat"), "bx": F.col("elon"), "by": F.col("elat")}
    edge = {c: F.col(c) for c in ("ax", "ay", "bx", "by")}
    dx, dy = F.col("elon") - F.col("slon"), F.col("elat") - F.col("slat")
    off = lambda x, y: dx * (F.col(y) - F.col("slat")) - dy * (F.col(x) - F.col("slon"))
    wide = F.sqrt(dx * dx + dy * dy) * buffer
    beside = (F.least(off("ax", "ay"), off("bx", "by")) <= wide) & (F.greatest(off("ax", "ay"), off("bx", "by")) >= -wide)
    met = walk(segments.select(*keys, "slon", "slat", "elon", "elat"), buffer).join(_edge_cells(zones), ["_cx", "_cy"])
    close = met.where(beside & (g._edge_gap(leg, edge) < buffer - 1e-12)).select(*keys, "_zone")
    begun = _inside(segments.select(*keys, F.col("slon").alias("lon"), F.col("slat").alias("lat")), zones, keys)
    return close.unionByName(begun).distinct().withColumnRenamed("_zone", "zone_id")


def near(points: DataFrame, zones: DataFrame, keys: list[str], buffer: float) -> DataFrame:
    """(keys) of the points (lon, lat) in buffered zones."""
    boxed = g.tile(points.select(*keys, "lon", "lat"), F.col("lon") - buffer, F.col("lon") + buffer, F.col("lat") - buffer, F.col("lat") + buffer)
    met = boxed.join(_edge_cells(zones), ["_cx", "_cy"])
    close = met.where(g.point_segment(F.col("lon"), F.col("lat"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) < buffer).select(*keys)
    return close.unionByName(_inside(points, zones, keys).select(*keys)).distinct()


def _first_free(tries: DataFrame, zones: DataFrame, keys: list[str], buffer: float) -> DataFrame:
    """(keys, lon, lat): of the tries (keys, p, lon, lat) outside all buffered zones that of the least p."""
    free = tries.join(near(tries, zones, [*keys, "p"], buffer), [*keys, "p"], "left_anti")
    return free.groupBy(*keys).agg(F.min_by(F.struct("lon", "lat"), "p").alias("to")).select(*keys, "to.lon", "to.lat")


def snap(points: DataFrame, zones: DataFrame, keys: list[str], buffer: float) -> DataFrame:
    """points (keys, lon, lat), those in buffered zones moved to the first of 19 rings of 8 places that is outside; staged.
    Few need more than the first rings: the others are tried for what is left only."""
    left = inside = staged(points.join(near(points, zones, keys, buffer), keys, "left_semi"))
    found = []
    for rings in (range(FIRST_RINGS), range(FIRST_RINGS, RINGS)):
        moves = F.array(*[F.struct(F.lit(8 * m + i).alias("p"), F.lit(STEP * (m + 1) * dx).alias("dx"), F.lit(STEP * (m + 1) * dy).alias("dy")) for m in rings for i, (dx, dy) in enumerate(DIRECTIONS)])
        tries = spread(left, *keys).select(*keys, "lon", "lat", F.explode(moves).alias("m")).select(*keys, "m.p", (F.col("lon") + F.col("m.dx")).alias("lon"), (F.col("lat") + F.col("m.dy")).alias("lat"))
        found.append(staged(_first_free(tries, zones, keys, buffer)))
        left = left.join(found[-1], keys, "left_anti")
        if left.isEmpty():
            break
    moved = functools.reduce(DataFrame.unionByName, found).withColumnsRenamed({"lon": "_lon", "lat": "_lat"})
    out = staged(points.join(moved, keys, "left").select(*keys, F.coalesce("_lon", "lon").alias("lon"), F.coalesce("_lat", "lat").alias("lat")))
    for done in (inside, *found):
        discard(done)
    return out


def corners(zones: DataFrame, buffer: float) -> DataFrame:
    """(node, zone_id, lon, lat): vertices and edge midpoints of the zones, pushed away from the zone's middle until they
    are outside all buffered zones; those that never are go."""
    e = zones.select("zone_id", F.posexplode(g.edges(F.col("ring"))).alias("i", "e"))
    middle = e.groupBy("zone_id").agg(F.avg("e.ax").alias("cx"), F.avg("e.ay").alias("cy"))
    half = lambda a, b: (F.col(f"e.{a}") + F.col(f"e.{b}")) / 2
    both = F.array(F.struct((F.col("i") * 2).alias("slot"), F.col("e.ax").alias("x"), F.col("e.ay").alias("y")), F.struct((F.col("i") * 2 + 1).alias("slot"), half("ax", "bx").alias("x"), half("ay", "by").alias("y")))
    v = e.select("zone_id", F.explode(both).alias("v")).join(middle, "zone_id")
    dx, dy = F.col("v.x") - F.col("cx"), F.col("v.y") - F.col("cy")
    far = F.sqrt(dx * dx + dy * dy)
    far = F.when(far == 0.0, 1.0).otherwise(far)
    push = F.col("p") * (1.5 * buffer / 2)
    tries = v.withColumn("p", F.explode(F.sequence(F.lit(1), F.lit(PUSHES)))).select("zone_id", F.col("v.slot").alias("slot"), "p", (F.col("v.x") + dx / far * push).alias("lon"), (F.col("v.y") + dy / far * push).alias("lat"))
    free = _first_free(tries, zones, ["zone_id", "slot"], buffer)
    return free.select((F.col("zone_id").cast("bigint") * (1 << 20) + F.col("slot")).alias("node"), "zone_id", "lon", "lat")


def _legs(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and directions of the legs from each place p to each place q, both (2, n)."""
    d = q[:, None, :] - p[:, :, None]
    far = np.sqrt(d[0] ** 2 + d[1] ** 2)
    return far, np.where(far > 0, d / np.where(far > 0, far, 1.0), np.array([1.0, 0.0])[:, None, None])


def _blocks(p: np.ndarray, most: int = 64) -> list[np.ndarray]:
    """Indices of the places p (2, n) in runs of neighbours, each within one of 8 x 8 cells of their box."""
    size = np.maximum(np.ptp(p, axis=1, keepdims=True) / 8, 1e-9)
    x, y = np.minimum((p - p.min(1, keepdims=True)) // size, 7).astype(int)
    order = np.argsort(x * 8 + y, kind="stable")
    runs = np.split(order, np.flatnonzero(np.diff((x * 8 + y)[order])) + 1)
    return [run[k : k + most] for run in runs for k in range(0, len(run), most)]


def _look(p: np.ndarray, spots: np.ndarray, e: np.ndarray, buffer: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(far, seen) of the places p and spots (2, n): how far apart, and whether within reach with none of the edges e (4, n)
    and its buffer between. What hides a spot from all corners of the places' box hides it from the places, because the
    shadow of a disc is convex; other edges count for the spots whose legs they come near at all."""
    middle, radius = (e[:2] + e[2:]) / 2, np.hypot(*(e[2:] - e[:2])) / 2 + buffer
    (w, s), (o, n) = p.min(1), p.max(1)
    half = math.hypot(o - w, n - s) / 2
    far, u = _legs(np.array([[w, o, w, o, (w + o) / 2], [s, s, n, n, (s + n) / 2]]), spots)
    x, y = middle[0] - np.array([w, o, w, o, (w + o) / 2])[:, None], middle[1] - np.array([s, s, n, n, (s + n) / 2])[:, None]
    aside = np.abs(u[0][..., None] * y[:, None] - u[1][..., None] * x[:, None])
    ahead = np.abs(u[0][..., None] * x[:, None] + u[1][..., None] * y[:, None] - far[..., None] / 2)
    hidden = ((aside[:4] < buffer - 1e-9) & (ahead[:4] <= far[:4, :, None] / 2)).all(0).any(1) | (far[4] - half > reach + 1e-9)
    j, m = np.nonzero(~hidden[:, None] & (aside[4] <= radius + half + 1e-9) & (ahead[4] <= far[4][:, None] / 2 + radius + half + 1e-9))
    far, u = _legs(p, spots)
    seen = (far <= reach) & ~hidden
    if len(j):
        # a middle beside a leg and well within the buffer blocks it; the others that are close are looked at exactly
        x, y, ux, uy, mid = middle[0][m] - p[0][:, None], middle[1][m] - p[1][:, None], u[0][:, j], u[1][:, j], far[:, j] / 2
        aside, ahead = np.abs(ux * y - uy * x), np.abs(ux * x + uy * y - mid)
        first = np.flatnonzero(np.diff(j, prepend=-1))
        seen[:, j[first]] &= ~np.logical_or.reduceat((aside < buffer - 1e-9) & (ahead <= mid), first, axis=1)
        i, k = np.nonzero((aside <= radius[m] + 1e-9) & (ahead <= mid + radius[m] + 1e-9) & seen[:, j])
        bad = g.edge_gaps((*p[:, i], *spots[:, j[k]]), e[:, m[k]]) < buffer - 1e-12
        seen[i[bad], j[k[bad]]] = False
    return far, seen


def _seen(buffer: float, reach: float, schema):
    """What a group of sights() does: its points against its nodes, past its edges, neighbours and some nodes at a time."""

    def f(points: pa.Table, scene: pa.Table) -> pa.Table:
        at = scene["node"].is_valid().to_numpy()
        spots = np.stack([scene[c].to_numpy()[at] for c in ("ax", "ay")])
        e = np.stack([scene[c].to_numpy()[~at] for c in ("ax", "ay", "bx", "by")])
        p = np.stack([points[c].to_numpy() for c in ("lon", "lat")])
        step, found = max(1, SIGHTS // (e.shape[1] + 1)), [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        for block in _blocks(p) if p.shape[1] else []:
            for low in range(0, spots.shape[1], step):
                far, seen = _look(p[:, block], spots[:, low : low + step], e, buffer, reach)
                i, j = np.nonzero(seen)
                found.append((block[i], low + j, far[i, j]))
        i, j, far = (np.concatenate(c) for c in zip(*found))
        columns = {c: points[c].take(pa.array(i)) for c in points.column_names} | {"node": scene["node"].drop_null().take(pa.array(j)), "far": pa.array(far), "olon": pa.array(spots[0][j]), "olat": pa.array(spots[1][j])}
        return pa.table({c: columns[c] for c in schema.names})

    return f


def sights(points: DataFrame, nodes: DataFrame, zones: DataFrame, buffer: float, reach: float) -> DataFrame:
    """points (lon, lat and more) with each node (node, far, olon, olat) within reach that no edge of a zone, with its
    buffer, hides from them; staged.

    Points and nodes meet by pairs of tiles, with the edges of the corridor between the two; a tile's points come in parts
    of some PART, so a task holds one part, one tile's nodes and one corridor."""
    width = max(reach / 8, g.CELL)
    most = math.ceil(reach / width)
    at = lambda c: F.floor(F.col(c) / width).cast("bigint")
    here = points.withColumns({"_ax": at("lon"), "_ay": at("lat")})
    there = nodes.select("node", F.col("lon").alias("ax"), F.col("lat").alias("ay"), at("lon").alias("_bx"), at("lat").alias("_by"))
    # pairs of tiles within reach, by blocks of tiles as wide as that
    block, around = lambda c: F.floor(F.col(c) / most), lambda c: F.explode(F.sequence(F.floor(F.col(c) / most) - 1, F.floor(F.col(c) / most) + 1))
    begun = here.groupBy("_ax", "_ay").agg(F.ceil(F.count("*") / PART).alias("_parts")).withColumn("_px", around("_ax")).withColumn("_py", around("_ay"))
    ended = there.select("_bx", "_by").distinct().withColumns({"_px": block("_bx"), "_py": block("_by")})
    apart = lambda c: F.greatest(F.abs(F.col(f"_a{c}") - F.col(f"_b{c}")) - 1, F.lit(0))
    pairs = staged(begun.join(ended, ["_px", "_py"]).where(F.sqrt(F.pow(apart("x"), 2) + F.pow(apart("y"), 2)) * width <= reach + 1e-9).select("_ax", "_ay", "_bx", "_by", "_parts"))
    tiles = ["_ax", "_ay", "_bx", "_by"]
    centre = lambda c: (F.col(c) + 0.5) * width
    lines = pairs.select("*", centre("_ax").alias("slon"), centre("_ay").alias("slat"), centre("_bx").alias("elon"), centre("_by").alias("elat"))
    corridor = walk(lines, 0.7072 * width + buffer, width).join(_edge_cells(zones, width).drop("_zone"), ["_cx", "_cy"]).select(*tiles, "_parts", F.lit(None).cast("bigint").alias("node"), "ax", "ay", "bx", "by").distinct()
    shown = pairs.join(there, ["_bx", "_by"]).select(*tiles, "_parts", "node", "ax", "ay", F.lit(None).cast("double").alias("bx"), F.lit(None).cast("double").alias("by"))
    scene = shown.unionByName(corridor).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))).drop("_parts")
    parts = here.join(pairs, ["_ax", "_ay"]).withColumn("_part", F.pmod(F.xxhash64(*points.columns), "_parts")).drop("_parts")
    schema = T.StructType([*points.schema.fields, *[T.StructField(n, t) for n, t in (("node", T.LongType()), ("far", T.DoubleType()), ("olon", T.DoubleType()), ("olat", T.DoubleType()))]])
    one, two = (spread(frame.select(*rest, *[F.col(c).alias(c) for c in (*tiles, "_part")]), *tiles, "_part").groupBy(*tiles, "_part") for frame, rest in ((parts, points.columns), (scene, ["node", "ax", "ay", "bx", "by"])))
    out = staged(one.cogroup(two).applyInArrow(_seen(buffer, reach, schema), schema))
    discard(pairs)
    return out


def visibility(nodes: DataFrame, zones: DataFrame, buffer: float, reach: float) -> DataFrame:
    """(a, b, far) both ways: nodes within reach of each other, with no buffered zone between them; staged."""
    seen = sights(nodes.select(F.col("node").alias("a"), "lon", "lat"), nodes, zones, buffer, reach)
    clear = seen.where("a < node").select("a", F.col("node").alias("b"), "far")
    out = staged(clear.unionByName(clear.select(F.col("b").alias("a"), F.col("a").alias("b"), "far")))
    discard(seen)
    return out


def shortest(legs: DataFrame, nodes: DataFrame, edges: DataFrame, zones: DataFrame, buffer: float, reach: float) -> DataFrame:
    """(route_id, length, path): for legs (route_id, slon, slat, elon, elat) that aren't clear themselves, the shortest way
    over the graph; path has the nodes between the ends. Routes without a way are absent.

    Routes share the ways between nodes: a tree of shortest ways grows from each node that a start sees, once for all
    routes, so rounds hold at most the square of the nodes and don't grow with the routes. Each round relaxes the edges of
    the nodes whose distance fell in the last one; rounds are as many as the bends of a way. Then each route takes the
    least sum over the nodes that its two ends see. Of equal ways the one with the smaller nodes stays. A route's way over
    the two nodes that seem best is known at once, and only nodes that can do as well by straight lines are tried.
    """
    end = lambda one, two: F.struct(F.lit(one).alias("end"), *[F.col(f"{e}{c}").alias(f"{n}{c}") for e, n in ((one, ""), (two, "t")) for c in ("lon", "lat")])
    ends = staged(legs.select("route_id", F.explode(F.array(end("s", "e"), end("e", "s"))).alias("x")).select("route_id", "x.*"))
    outside = ends.join(_inside(ends.select("route_id", "end", "lon", "lat"), zones, ["route_id", "end"]), ["route_id", "end"], "left_anti")
    straight = lambda a, b, c, d: F.sqrt(F.pow(F.col(a) - F.col(c), 2) + F.pow(F.col(b) - F.col(d), 2))
    rows = sights(outside, nodes, zones, buffer, reach)
    seen = rows.select("route_id", "end", "node", "far", "olon", "olat", (F.col("far") + straight("olon", "olat", "tlon", "tlat")).alias("via"))
    # only routes with both ends in sight of the graph count
    best_of = lambda e: F.expr(f"min_by(struct(node, far), via) filter (where end = '{e}')")
    guess = staged(seen.groupBy("route_id").agg(best_of("s").alias("a"), best_of("e").alias("b")).where("a is not null and b is not null"))
    roots = seen.where("end = 's'").join(guess, "route_id", "left_semi").select(F.col("node").alias("src")).distinct()
    known = staged(roots.select("src", F.col("src").alias("node"), F.lit(0.0).alias("dist"), F.array("src").alias("path"), F.lit(True).alias("new")))
    while not known.where("new").isEmpty():
        frontier = spread(known.where("new"), "node")
        reached = frontier.join(edges.withColumnRenamed("a", "node"), "node").select("src", F.col("b").alias("node"), (F.col("dist") + F.col("far")).alias("dist"), F.concat("path", F.array("b")).alias("path"))
        # the least distance by plain numbers first: few ways go on to the comparison of paths
        least = reached.groupBy("src", "node").agg(F.min("dist").alias("dist"))
        better = least.join(known.select("src", "node", F.col("dist").alias("had")), ["src", "node"], "left").where("had is null or dist < had").select("src", "node", "dist")
        news = reached.join(better, ["src", "node", "dist"]).groupBy("src", "node", "dist").agg(F.min("path").alias("path"))
        tried = known.select("src", "node", "dist", "path", F.lit(False).alias("new")).unionByName(news.withColumn("new", F.lit(True)))
        after = staged(tried.groupBy("src", "node").agg(F.min(F.struct("dist", "new", "path")).alias("s")).select("src", "node", "s.dist", "s.path", "s.new"))
        discard(known)
        known = after
    reached = known.select("src", "node", "dist")
    enough = staged(guess.select("route_id", F.col("a.node").alias("src"), F.col("b.node").alias("node"), (F.col("a.far") + F.col("b.far")).alias("far")).join(reached, ["src", "node"], "left").select("route_id", (F.col("far") + F.col("dist") + 1e-9).alias("most")))
    tried = seen.join(enough, "route_id").where("most is null or via <= most")
    side = lambda e, node, far, x: tried.where(F.col("end") == e).select("route_id", F.col("node").alias(node), F.col("far").alias(far), F.col("olon").alias(f"{x}lon"), F.col("olat").alias(f"{x}lat"))
    met = side("s", "src", "first", "a").join(side("e", "node", "last", "b"), "route_id").join(enough, "route_id")
    met = met.where(F.col("most").isNull() | (F.col("first") + straight("alon", "alat", "blon", "blat") + F.col("last") <= F.col("most")))
    ways = staged(met.join(reached, ["src", "node"]).select("route_id", "src", "node", (F.col("first") + F.col("dist") + F.col("last")).alias("length")))
    least = ways.groupBy("route_id").agg(F.min("length").alias("length"))
    ties = ways.join(least, ["route_id", "length"]).join(known.select("src", "node", "path"), ["src", "node"])
    best = staged(ties.groupBy("route_id").agg(F.min(F.struct("length", "path")).alias("w")).select("route_id", "w.length", "w.path"))
    for done in (ends, rows, guess, known, enough, ways):
        discard(done)
    return best


def box_ways(legs: DataFrame, zones: DataFrame, buffer: float, pad: float = 0.1) -> DataFrame:
    """(route_id, way): the first clear way over one side, then over two corners, of the box of all zones."""
    box = g.bounds(zones).agg((F.min("min_lon") - pad).alias("w"), (F.max("max_lon") + pad).alias("e"), (F.min("min_lat") - pad).alias("s"), (F.max("max_lat") + pad).alias("n"))
    place = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    w, e, s, n = (F.col(c) for c in "wesn")
    mx, my = (F.col("slon") + F.col("elon")) / 2, (F.col("slat") + F.col("elat")) / 2
    turn = [(w, n), (e, n), (w, s), (e, s)]
    ways = [[(mx, n)], [(mx, s)], [(e, my)], [(w, my)]] + [[turn[i], turn[j]] for i in range(4) for j in range(i + 1, 4)]
    tried = legs.crossJoin(F.broadcast(box)).select("route_id", "slon", "slat", "elon", "elat", F.posexplode(F.array(*[F.array(*[place(x, y) for x, y in way]) for way in ways])).alias("p", "way"))
    return first_clear(tried, zones, buffer)


def first_clear(tried: DataFrame, zones: DataFrame, buffer: float) -> DataFrame:
    """(route_id, way): of the ways (route_id, p, slon, slat, elon, elat, way: places between) the first that is clear."""
    line = F.concat(F.array(F.struct(F.col("slon").alias("lon"), F.col("slat").alias("lat"))), "way", F.array(F.struct(F.col("elon").alias("lon"), F.col("elat").alias("lat"))))
    steps = F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1), lambda a, b: F.struct(a["lon"].alias("slon"), a["lat"].alias("slat"), b["lon"].alias("elon"), b["lat"].alias("elat")))
    legs = tried.select("route_id", "p", F.explode(steps).alias("l")).select("route_id", "p", "l.*")
    bad = blocked(legs, zones, ["route_id", "p"], buffer).select("route_id", "p").distinct()
    return tried.join(bad, ["route_id", "p"], "left_anti").groupBy("route_id").agg(F.min_by("way", "p").alias("way"))


def plan(routes: DataFrame, zones: DataFrame, buffer: float, reach: float = 0.1) -> DataFrame:
    """(route_id, type, waypoints, route_valid, length, line) for routes (route_id, type, slon, slat, elon, elat).

    Irregular routes ignore zones. reach bounds the legs of the visibility graph (wide open water needs a wide one: the
    graph has a row for each pair of corners that close). Routes without a clear way are straight and not valid.
    """
    place = lambda a, b: F.struct(F.col(a).alias("lon"), F.col(b).alias("lat"))
    free = routes.where("type = 'irregular'").select("route_id", "type", "slon", "slat", "elon", "elat", F.lit(True).alias("route_valid"), F.array().cast("array<struct<lon: double, lat: double>>").alias("way"))
    bound = routes.where("type <> 'irregular'")
    ends = bound.select("route_id", F.explode(F.array(F.struct(F.lit("s").alias("end"), place("slon", "slat").alias("at")), F.struct(F.lit("e").alias("end"), place("elon", "elat").alias("at")))).alias("x"))
    moved = snap(ends.select("route_id", "x.end", "x.at.lon", "x.at.lat"), zones, ["route_id", "end"], buffer)
    both = moved.groupBy("route_id").agg(*[F.max(F.when(F.col("end") == e, F.col(c))).alias(f"{e}{c}") for e in "se" for c in ("lon", "lat")])
    legs = staged(bound.select("route_id", "type").join(both, "route_id"))
    hit = staged(blocked(spread(legs, "route_id"), zones, ["route_id"], buffer).select("route_id").distinct())
    open_ = legs.join(hit, "route_id", "left_semi")
    nodes = staged(corners(zones, buffer))
    edges = visibility(nodes, zones, buffer, reach)
    over = shortest(open_, nodes, edges, zones, buffer, reach)
    bends = over.select("route_id", F.posexplode("path").alias("i", "node")).join(nodes, "node").groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("i", "lon", "lat"))).alias("v"))
    ways = staged(bends.select("route_id", F.transform("v", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("way")))
    around = staged(box_ways(spread(open_.join(ways, "route_id", "left_anti"), "route_id"), zones, buffer))
    found = legs.join(hit.withColumn("_hit", F.lit(True)), "route_id", "left").join(ways.unionByName(around), "route_id", "left")
    kept = found.select("route_id", "type", "slon", "slat", "elon", "elat", (F.col("_hit").isNull() | F.col("way").isNotNull()).alias("route_valid"), F.coalesce("way", F.array().cast("array<struct<lon: double, lat: double>>")).alias("way"))
    line = F.concat(F.array(place("slon", "slat")), "way", F.array(place("elon", "elat")))
    out = staged(kept.unionByName(free).select("route_id", "type", "route_valid", line.alias("line")))
    for done in (moved, legs, hit, nodes, edges, over, ways, around):
        discard(done)
    steps = F.zip_with(F.slice("line", 1, F.size("line") - 1), F.slice("line", 2, F.size("line") - 1), lambda a, b: F.sqrt(F.pow(b["lon"] - a["lon"], 2) + F.pow(b["lat"] - a["lat"], 2)))
    return out.select(F.col("route_id").cast("string").alias("route_id"), "type", F.size("line").alias("waypoints"), "route_valid", F.aggregate(steps, F.lit(0.0), lambda s, d: s + d).alias("length"), "line")


def collision_free(legs: DataFrame, zones: DataFrame, buffer: float, points: int = 10) -> DataFrame:
    """(route_id, clear, rule, line) for legs (route_id, slon, slat, elon, elat): a straight line of points + 1 places
    where nothing is near; else the shorter side of the first blocking zone (the smallest id), over its corners moved a
    buffer away from its middle, at sixteen even steps; else the first clear way over a corner of the box of all buffered
    zones; else that side after all, not clear. rule names the step that decided: straight, side, corner or none. Each
    step goes on with what is still open."""
    legs = staged(legs.select("route_id", "slon", "slat", "elon", "elat"))
    hits = staged(blocked(spread(legs, "route_id"), zones, ["route_id"], buffer).groupBy("route_id").agg(F.min("zone_id").alias("zone_id")))
    straight = g.straight_waypoints(legs.join(hits, "route_id", "left_anti"), points).withColumn("rule", F.lit("straight"))
    ring = zones.select("zone_id", F.posexplode(F.slice("ring", 1, F.size("ring") - 1)).alias("i", "v"))
    middle = ring.groupBy("zone_id").agg(F.avg("v.lon").alias("cx"), F.avg("v.lat").alias("cy"))
    dx, dy = F.col("v.lon") - F.col("cx"), F.col("v.lat") - F.col("cy")
    far = F.sqrt(dx * dx + dy * dy)
    outer = ring.join(middle, "zone_id").select("zone_id", "i", (F.col("v.lon") + dx / far * buffer * 1.5).alias("lon"), (F.col("v.lat") + dy / far * buffer * 1.5).alias("lat"))
    v = hits.join(legs, "route_id").join(outer, "zone_id")
    cross = (F.col("elon") - F.col("slon")) * (F.col("lat") - F.col("slat")) - (F.col("elat") - F.col("slat")) * (F.col("lon") - F.col("slon"))
    place = lambda a, b: F.struct(F.col(a).alias("lon"), F.col(b).alias("lat"))
    side = v.groupBy("route_id", "slon", "slat", "elon", "elat", (cross <= 0).alias("right")).agg(F.array_sort(F.collect_list(F.struct("i", "lon", "lat"))).alias("v"))
    pts = F.concat(F.array(place("slon", "slat")), F.transform("v", lambda q: F.struct(q["lon"].alias("lon"), q["lat"].alias("lat"))), F.array(place("elon", "elat")))
    steps = F.zip_with(F.slice("pts", 1, F.size("pts") - 1), F.slice("pts", 2, F.size("pts") - 1), lambda a, b: F.sqrt(F.pow(b["lon"] - a["lon"], 2) + F.pow(b["lat"] - a["lat"], 2)))
    sided = side.withColumn("pts", pts).withColumn("len", F.aggregate(steps, F.lit(0.0), lambda s, d: s + d))
    best = sided.groupBy("route_id").agg(F.min_by("pts", F.struct("len", "right")).alias("pts"))
    line = best.select("route_id", F.posexplode("pts").alias("i", "p")).select("route_id", "i", "p.lon", "p.lat")
    detour = staged(g.resample(line, "route_id", 15))
    after = lambda c: F.element_at("v", F.col("n") + 1)[c]
    whole = spread(detour, "route_id").groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))).alias("v"))
    pieces = whole.withColumn("n", F.explode(F.sequence(F.lit(1), F.size("v") - 1))).select("route_id", F.element_at("v", F.col("n"))["lon"].alias("slon"), F.element_at("v", F.col("n"))["lat"].alias("slat"), after("lon").alias("elon"), after("lat").alias("elat"))
    bad = staged(blocked(pieces, zones, ["route_id"], buffer).select("route_id").distinct())
    pad = buffer + 0.01
    box = g.bounds(zones).agg((F.min("min_lon") - pad).alias("w"), (F.max("max_lon") + pad).alias("e"), (F.min("min_lat") - pad).alias("s"), (F.max("max_lat") + pad).alias("n"))
    turns = F.array(*[F.array(place(x, y)) for x, y in (("w", "s"), ("e", "s"), ("e", "n"), ("w", "n"))])
    tried = spread(legs.join(bad, "route_id", "left_semi"), "route_id").crossJoin(F.broadcast(box)).select("route_id", "slon", "slat", "elon", "elat", F.posexplode(turns).alias("p", "way"))
    turned = first_clear(tried, zones, buffer)
    bent = legs.join(turned, "route_id").select("route_id", F.posexplode(F.concat(F.array(place("slon", "slat")), "way", F.array(place("elon", "elat")))).alias("i", "p")).select("route_id", "i", "p.lon", "p.lat")
    corner = staged(g.resample(bent, "route_id", points).withColumn("rule", F.lit("corner")))
    kept = detour.join(corner.select("route_id").distinct(), "route_id", "left_anti").join(bad.withColumn("_bad", F.lit(True)), "route_id", "left")
    kept = kept.select("route_id", "seq", "lon", "lat", F.when(F.col("_bad"), "none").otherwise("side").alias("rule"))
    every = straight.select("route_id", "seq", "lon", "lat", "rule").unionByName(kept).unionByName(corner.select("route_id", "seq", "lon", "lat", "rule"))
    lines = every.groupBy("route_id", "rule").agg(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))).alias("v"))
    out = staged(lines.select("route_id", (F.col("rule") != "none").alias("clear"), "rule", F.transform("v", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("line")))
    for done in (legs, hits, detour, bad, corner):
        discard(done)
    return out


def route_properties(planned: DataFrame) -> DataFrame:
    """planned with vessel_type, suspicious and warning."""
    return planned.withColumns({
        "vessel_type": F.when(F.col("type") == "ferry", "ferry").when(F.col("type") == "tss", "cargo").otherwise("unknown"),
        "suspicious": F.col("type") == "irregular",
        "warning": F.when(~F.col("route_valid"), "Route passes through restricted zone — no clear path could be calculated"),
    })


def buffer_of(zones: DataFrame) -> float:
    """The adaptive buffer of all zones, as one number: 0.018, less where two zones are nearer than twice that."""
    least = g.zones_within(zones, 0.036).agg(F.min("dist")).first()[0]
    return 0.018 if least is None or least >= 0.036 else max(0.005, 0.3 * least)
