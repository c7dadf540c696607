"""Deterministic points, tracks, grids, colours and zones from the given tables.

Everything is integer arithmetic on keys followed by one division, so that any engine gets the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells in a row of the grid that the orders fill.
WIDTH = 100
#: Vertices of a zone around its centre, in radii.
HEXAGON = [(1.0, 0.0), (0.5, 0.9), (-0.5, 0.9), (-1.0, 0.0), (-0.5, -0.9), (0.5, -0.9)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lonlat(key: str):
    lon = F.lit(-122.5) + 0.2 * ((F.col(key) * 7919) % 10007) / 10007.0
    lat = F.lit(37.5) + 0.2 * ((F.col(key) * 104729) % 10009) / 10009.0
    return lon.alias("lon"), lat.alias("lat")


def points(spark, sf_dir, table: str = "customer", key: str = "c_custkey") -> DataFrame:
    """(id, lon, lat) for each row of a keyed table."""
    return read(spark, sf_dir, table).select(F.col(key).alias("id"), *_lonlat(key))


def tracks(spark, sf_dir) -> DataFrame:
    """(user_id, ts, event_id, lon, lat): vessel positions from the events."""
    return read(spark, sf_dir, "events").select("user_id", "ts", "event_id", *_lonlat("event_id"))


def grid(spark, sf_dir) -> DataFrame:
    """(y, x, z): a cell for each order, z its price."""
    key = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(F.floor(key / WIDTH).cast("int").alias("y"), (key % WIDTH).cast("int").alias("x"), F.col("o_totalprice").alias("z"))


def colours(spark, sf_dir) -> DataFrame:
    """(y, x, r, g, b): a hashed colour for each cell of the grid."""
    k = F.col("o_orderkey")
    band = lambda m, n: (((k * m) % n) / float(n))
    return read(spark, sf_dir, "orders").select(
        F.floor(k / WIDTH).cast("int").alias("y"), (k % WIDTH).cast("int").alias("x"), band(7919, 1009).alias("r"), band(104729, 1013).alias("g"), band(1299709, 1019).alias("b")
    )


def patches(spark, sf_dir) -> DataFrame:
    """(y, x, r, g, b): patches of 9 x 7 cells of one hashed colour each."""
    k = F.floor(F.col("o_orderkey") / (9 * WIDTH)) * 31 + F.floor((F.col("o_orderkey") % WIDTH) / 7)
    band = lambda m, n: (((k * m) % n) / float(n))
    return read(spark, sf_dir, "orders").select(
        F.floor(F.col("o_orderkey") / WIDTH).cast("int").alias("y"), (F.col("o_orderkey") % WIDTH).cast("int").alias("x"), band(7919, 1009).alias("r"), band(104729, 1013).alias("g"), band(1299709, 1019).alias("b")
    )


def zones(spark, sf_dir) -> DataFrame:
    """(zone_id, zone_type, ring): a closed hexagon for each nation."""
    k = F.col("n_nationkey").cast("bigint")
    base = read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("zone_id"),
        F.when(k % 3 == 0, "mpa").when(k % 3 == 1, "military").otherwise("windfarm").alias("zone_type"),
        (F.lit(-122.5) + 0.2 * ((k * 37) % 101) / 101.0).alias("clon"), (F.lit(37.5) + 0.2 * ((k * 59) % 103) / 103.0).alias("clat"), (F.lit(0.004) + 0.0005 * (k % 5)).alias("rad"),
    )
    vertex = [F.struct((F.col("clon") + F.col("rad") * ox).alias("lon"), (F.col("clat") + F.col("rad") * oy).alias("lat")) for ox, oy in [*HEXAGON, HEXAGON[0]]]
    return base.select("zone_id", "zone_type", F.array(*vertex).alias("ring"))


def legs(spark, sf_dir) -> DataFrame:
    """(route_id, slon, slat, elon, elat): a start and an end for each supplier."""
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        k.alias("route_id"),
        (F.lit(-122.5) + 0.2 * ((k * 7919) % 997) / 997.0).alias("slon"), (F.lit(37.5) + 0.2 * ((k * 104729) % 991) / 991.0).alias("slat"),
        (F.lit(-122.5) + 0.2 * ((k * 6151 + 500) % 983) / 983.0).alias("elon"), (F.lit(37.5) + 0.2 * ((k * 3571 + 300) % 977) / 977.0).alias("elat"),
    )


#: The same relations as DuckDB text.
SQL = {
    "points": "SELECT c_custkey AS id, -122.5e0 + 2e-1*((c_custkey*7919)%10007)/10007e0 AS lon, 37.5e0 + 2e-1*((c_custkey*104729)%10009)/10009e0 AS lat FROM customer",
    "tracks": "SELECT user_id, ts, event_id, -122.5e0 + 2e-1*((event_id*7919)%10007)/10007e0 AS lon, 37.5e0 + 2e-1*((event_id*104729)%10009)/10009e0 AS lat FROM events",
    "grid": "SELECT CAST(o_orderkey//100 AS INT) AS y, CAST(o_orderkey%100 AS INT) AS x, o_totalprice AS z FROM orders",
    "colours": "SELECT CAST(o_orderkey//100 AS INT) AS y, CAST(o_orderkey%100 AS INT) AS x, ((o_orderkey*7919)%1009)/1009e0 AS r, ((o_orderkey*104729)%1013)/1013e0 AS g, ((o_orderkey*1299709)%1019)/1019e0 AS b FROM orders",
    "patches": "SELECT y, x, ((k*7919)%1009)/1009e0 AS r, ((k*104729)%1013)/1013e0 AS g, ((k*1299709)%1019)/1019e0 AS b FROM (SELECT CAST(o_orderkey//100 AS INT) AS y, CAST(o_orderkey%100 AS INT) AS x, o_orderkey//900*31+(o_orderkey%100)//7 AS k FROM orders)",
    "zone0": "SELECT n_nationkey AS zone_id, CASE WHEN n_nationkey%3=0 THEN 'mpa' WHEN n_nationkey%3=1 THEN 'military' ELSE 'windfarm' END AS zone_type, -122.5e0+2e-1*((n_nationkey*37)%101)/101e0 AS clon, 37.5e0+2e-1*((n_nationkey*59)%103)/103e0 AS clat, 4e-3+5e-4*(n_nationkey%5) AS rad FROM nation",
    "off": "SELECT * FROM (VALUES (0,1e0,0e0),(1,5e-1,9e-1),(2,-5e-1,9e-1),(3,-1e0,0e0),(4,-5e-1,-9e-1),(5,5e-1,-9e-1),(6,1e0,0e0)) t(i,ox,oy)",
    "verts": "SELECT zone_id, zone_type, i, clon+rad*ox AS lon, clat+rad*oy AS lat FROM zone0, off",
    "edges": "SELECT a.zone_id, a.i, a.lon AS ax, a.lat AS ay, b.lon AS bx, b.lat AS by_ FROM verts a JOIN verts b ON a.zone_id=b.zone_id AND b.i=a.i+1",
    "legs": "SELECT s_suppkey AS route_id, -122.5e0+2e-1*((s_suppkey*7919)%997)/997e0 AS slon, 37.5e0+2e-1*((s_suppkey*104729)%991)/991e0 AS slat, -122.5e0+2e-1*((s_suppkey*6151+500)%983)/983e0 AS elon, 37.5e0+2e-1*((s_suppkey*3571+300)%977)/977e0 AS elat FROM supplier",
}
_NEEDS = {"verts": ("zone0", "off"), "edges": ("zone0", "off", "verts")}


def ctes(*names: str) -> str:
    """WITH clause that defines the named relations."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*_NEEDS.get(n, ()), n) if x not in order]
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in order)
