"""Vessels, lanes, assets, routes and zones for the rows of a table: every draw is a hash of the row's key and the draw's
number, so rows come from the cluster's own scan in any order, and a key has the same ones at any scale. The seeded
streams of `generators` are for the small published collections."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartosea.functions.geo import km_to_deg
from cartosea.operators import lattice
from cartosea.operators.geometry import clip_rings, smooth_rings
from cartosea.sources.generators import ASSETS, BUOYS, DENSITIES, EDGES, SPEEDS, VESSELS, Box

#: Draws stay below 1, so that an index never reaches the number of choices.
BELOW = 0.999999
# Fixed values of each kind of zone: radius in km, vertices, irregularity, smoothing in radii, restriction; a wind farm is
# circular or boxy.
ZONES = {"mpa": ((5, 30), (12, 19), (0.2, 0.4), 0.15, "no-fishing"), "military": ((10, 50), (5, 7), (0.05, 0.15), 0.05, "no-entry"), "windfarm": ((5, 20), (16, 23), (0.05, 0.15), 0.08, "restricted")}
BOXY = ((4, 5), (0.01, 0.05))
KINDS = list(ZONES)


def drawn(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """rows with _u, an array of a row's draws 0 to most - 1: hashes of its key and the draw's number, a batch of rows at a
    time. As an expression in the engine each would be some thousand operations to plan."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def draws(key: pd.Series) -> pd.Series:
        return pd.Series(list(lattice.hashed(key.to_numpy("int64")[:, None], np.arange(most)[None, :], seed)))

    return rows.withColumn("_u", draws("key"))


def draw(n):
    """Draw number n of a row, 0..1."""
    return F.col("_u")[n]


def _index(u, n):
    return F.floor(u * (n * BELOW)).cast("int")


def _choice(u, names: list[str]):
    return F.element_at(F.array(*map(F.lit, names)), _index(u, len(names)) + 1)


def _letter(key):
    return F.char((65 + key % 26).cast("int"))


def vessels(rows: DataFrame, seed: int = 42, box: Box = Box()) -> DataFrame:
    """A vessel for each key: (id, name, type, lon, lat, speed_knots, heading, mmsi, length_m)."""
    rows, u = drawn(rows, 7, seed), draw
    kind = _choice(u(3), VESSELS)
    low, high = (F.element_at(F.create_map(*[F.lit(x) for k in VESSELS for x in (k, float(SPEEDS[k][i]))]), F.col("type")) for i in (0, 1))
    out = rows.select("key", "_u", kind.alias("type"))
    return out.select(
        F.format_string("vessel_%03d", F.col("key") + 1).alias("id"), F.concat(F.initcap("type"), F.lit(" "), _letter(F.col("key")), (F.col("key") + 1).cast("string")).alias("name"), "type",
        (box.west + (box.east - box.west) * u(1)).alias("lon"), (box.south + (box.north - box.south) * u(2)).alias("lat"),
        F.round(low + (high - low) * u(4), 1).alias("speed_knots"), F.round(360.0 * u(5), 1).alias("heading"), (200_000_000 + F.col("key")).cast("string").alias("mmsi"), (50 + _index(u(6), 251)).alias("length_m"),
    )


def lanes(rows: DataFrame, count: int, seed: int = 1042, box: Box = Box()) -> DataFrame:
    """A lane for each key below count, along and across the box in turn: (id, name, direction, line, width_m, traffic_density)."""
    rows = drawn(rows, 3, seed)
    k, share = F.col("key"), F.col("key") / float(count)
    across, along = box.east - box.west, box.north - box.south
    bends, steps = (0.0, 0.01, -0.01, 0.0), (0.0, 0.3, 0.7, 1.0)
    place = lambda lon, lat: F.struct(lon.alias("lon"), lat.alias("lat"))
    north = F.array(*[place(box.west + share * across + b, F.lit(box.south + along * s)) for b, s in zip(bends, steps)])
    east = F.array(*[place(F.lit(box.west + across * s), box.south + share * along + b) for b, s in zip(bends, steps)])
    way = F.element_at(F.array(*map(F.lit, ("northbound", "eastbound", "southbound", "westbound"))), (k % 4 + 1).cast("int"))
    return rows.select(F.format_string("lane_%03d", k + 1).alias("id"), F.concat(F.lit("Shipping Lane "), _letter(k)).alias("name"), way.alias("direction"), F.when(k % 2 == 0, north).otherwise(east).alias("line"), (400 + _index(draw(1), 401)).alias("width_m"), _choice(draw(2), DENSITIES).alias("traffic_density"))


def assets(rows: DataFrame, seed: int = 2042, box: Box = Box()) -> DataFrame:
    """An asset for each key, 60 % of them within 0.05 degrees of an edge of the box: (id, name, type, lon, lat, berths,
    max_draft_m, range_nm, height_m, buoy_type, light)."""
    rows, u = drawn(rows, 9, seed), draw
    edge, off = F.when(u(1) < 0.6, _choice(u(2), EDGES)), 0.05 * u(3)
    own = rows.select("key", "_u", edge.alias("edge"), off.alias("off"), _choice(u(5), ASSETS).alias("type"))
    lon = F.when(F.col("edge") == "east", box.east - F.col("off")).when(F.col("edge") == "west", box.west + F.col("off")).otherwise(box.west + (box.east - box.west) * u(4))
    lat = F.when(F.col("edge") == "north", box.north - F.col("off")).when(F.col("edge") == "south", box.south + F.col("off")).otherwise(box.south + (box.north - box.south) * u(8))
    of = lambda kind, v: F.when(F.col("type") == kind, v)
    return own.select(
        F.format_string("%s_%03d", "type", F.col("key") + 1).alias("id"), F.concat(F.initcap(F.translate("type", "_", " ")), F.lit(" "), _letter(F.col("key")), (F.col("key") + 1).cast("string")).alias("name"), "type", lon.alias("lon"), lat.alias("lat"),
        of("port", 2 + _index(u(6), 19)).alias("berths"), of("port", 8 + _index(u(7), 11)).alias("max_draft_m"), of("lighthouse", 10 + _index(u(6), 21)).alias("range_nm"), of("lighthouse", 15 + _index(u(7), 46)).alias("height_m"),
        of("buoy", _choice(u(6), BUOYS)).alias("buoy_type"), of("buoy", u(7) < 0.5).alias("light"),
    )


def routes(rows: DataFrame, seed: int = 3042, box: Box = Box()) -> DataFrame:
    """(id, type, name, line, stops): for each key in turn a ferry's bowed line, two separated lanes to either side of one, and
    an irregular line with three detours and two stops (places of the line, from 0)."""
    rows, u = drawn(rows, 32, seed), draw
    at = {"sx": box.west + (box.east - box.west) * u(1), "sy": box.south + (box.north - box.south) * u(2), "ex": box.west + (box.east - box.west) * u(3), "ey": box.south + (box.north - box.south) * u(4), "n": 8 + _index(u(5), 7)}
    b = rows.select("key", "_u", *[v.alias(k) for k, v in at.items()])
    dx, dy = F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")
    b = b.withColumn("len", F.sqrt(dx * dx + dy * dy))
    px, py = -dy / F.col("len"), dx / F.col("len")
    half = km_to_deg(F.lit(2.0), F.lit((box.south + box.north) / 2)) / 2

    def place(k, off):
        t = k / F.col("n")
        bow = 0.02 * F.sin(t * math.pi) + off
        return F.struct((F.col("sx") + dx * t + px * bow).alias("lon"), (F.col("sy") + dy * t + py * bow).alias("lat"))

    line = lambda off: F.transform(F.sequence(F.lit(0), F.col("n")), lambda k: place(k, off))
    hold = lambda v, a, z: F.least(F.greatest(v, F.lit(a)), F.lit(z))
    keyed = [F.transform(F.sequence(F.lit(0), F.col("n")), lambda k: F.struct(k.cast("double").alias("s"), place(k, F.lit(0.0)).alias("p")))]
    for j in range(3):
        k = F.floor((0.2 + 0.6 * u(10 + 3 * j)) * F.col("n")).cast("int")
        far, angle, p = 0.05 + 0.1 * u(11 + 3 * j), 2 * math.pi * u(12 + 3 * j), place(k, F.lit(0.0))
        moved = F.struct(hold(p["lon"] + far * F.cos(angle), box.west, box.east).alias("lon"), hold(p["lat"] + far * F.sin(angle), box.south, box.north).alias("lat"))
        keyed.append(F.array(F.struct((k + (j + 1) / 10.0).alias("s"), moved.alias("p"))))
    detoured = F.transform(F.array_sort(F.concat(*keyed)), lambda q: q["p"])
    stops = F.array(*[F.floor((0.1 + 0.8 * u(30 + j)) * (F.col("n") + 3)).cast("int") for j in range(2)])
    none = F.array().cast("array<int>")
    lane = lambda j, off: F.struct(F.format_string(f"route_%d_lane_{j}", "key").alias("id"), F.lit("tss").alias("type"), F.format_string(f"TSS route %d lane {j + 1}", F.col("key") + 1).alias("name"), line(off).alias("line"), none.alias("stops"))
    one = lambda kind, word, way, st: F.array(F.struct(F.format_string("route_%d", "key").alias("id"), F.lit(kind).alias("type"), F.format_string(f"{word} route %d", F.col("key") + 1).alias("name"), way.alias("line"), st.alias("stops")))
    made = F.when(F.col("key") % 3 == 0, one("ferry", "Ferry", line(F.lit(0.0)), none)).when(F.col("key") % 3 == 1, F.array(lane(0, half), lane(1, -half))).otherwise(one("irregular", "Irregular", detoured, stops))
    return b.select(F.explode(made).alias("r")).select("r.*")


def stars(rows: DataFrame, seed: int = 42, box: Box = Box()) -> DataFrame:
    """(zone_id, zone_type, restriction, smooth, ring): for each key a polygon of jittered angles and radii around a place of
    the box; smooth is how far its corners are to be rounded, in degrees."""
    rows, u = drawn(rows, 102 + 2 * ZONES["windfarm"][1][1], seed), draw
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("key") % 3 + 1).cast("int"))
    pick = lambda f: F.element_at(F.create_map(*[F.lit(x) for k in KINDS for x in (k, f(ZONES[k]))]), F.col("zone_type"))
    boxy = (F.col("zone_type") == "windfarm") & (u(4) >= 0.5)
    low_n, high_n = (F.when(boxy, BOXY[0][i]).otherwise(pick(lambda z: z[1][i])) for i in (0, 1))
    low_i, high_i = (F.when(boxy, BOXY[1][i]).otherwise(pick(lambda z: float(z[2][i]))) for i in (0, 1))
    z = rows.select("key", "_u", kind.alias("zone_type"), (box.west + (box.east - box.west) * u(1)).alias("cx"), (box.south + (box.north - box.south) * u(2)).alias("cy"))
    km = pick(lambda v: float(v[0][0])) + (pick(lambda v: float(v[0][1])) - pick(lambda v: float(v[0][0]))) * u(3)
    z = z.select("*", km_to_deg(km, F.col("cy")).alias("rad"), (low_n + _index(u(5), high_n - low_n + 1)).alias("n"), (low_i + (high_i - low_i) * u(6)).alias("irr"))

    def vertex(k):
        angle = 2 * math.pi * k / F.col("n") + F.col("irr") * (2.0 * draw(100 + 2 * k) - 1.0)
        r = F.col("rad") * (1.0 + F.col("irr") * 0.5 * (2.0 * draw(101 + 2 * k) - 1.0))
        return F.struct((F.col("cx") + r * F.cos(angle) / F.cos(F.radians("cy"))).alias("lon"), (F.col("cy") + r * F.sin(angle)).alias("lat"))

    ring = F.transform(F.sequence(F.lit(0), F.col("n")), lambda k: vertex(k % F.col("n")))
    return z.select(F.col("key").alias("zone_id"), "zone_type", pick(lambda v: v[4]).alias("restriction"), (F.col("rad") * pick(lambda v: v[3])).alias("smooth"), ring.alias("ring"))


def zones(rows: DataFrame, seed: int = 42, box: Box = Box(), smooth: bool = True) -> DataFrame:
    """(zone_id, zone_type, restriction, ring): stars with rounded corners, cut at the box. Without smoothing they have
    few vertices and hold the smooth ones, so ways around them are clear of those too."""
    drawn_ = stars(rows, seed, box)
    made = smooth_rings(drawn_, F.col("smooth")) if smooth else drawn_
    return clip_rings(made.drop("smooth"), (box.west, box.south), (box.east, box.north))
