"""Whole runs: a terrain with its levels, and a maritime scene from a configuration file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartosea.functions import geo
from cartosea.operators import imaging, palettes, terrain, wayfinding, world
from cartosea.operators import stencil as st
from cartosea.operators.graph import discard, staged
from cartosea.sources import fleets, geojson, runs
from cartosea.sources.generators import Box

#: Cells of a resolution in metres.
METRES = {"25cm": 0.25, "1m": 1.0, "10m": 10.0}
#: Elevation, 0..1, up to which there is water, and up to which water may rise.
SEA, FLOOD = 0.12, 0.18


def run_terrain(spark: SparkSession, biome: str, bounds: tuple[float, float, float, float], resolutions: list[str], path: str, timestamp: str, seed: int = 42) -> None:
    """Make a biome over bounds (west, south, east, north in degrees) and write its layers at all resolutions to path, the
    coarser ones from the finest. A request that is out of order, unknown or too large is an error before anything is made."""
    runs.check_request(bounds, resolutions)
    west, south, east, north = bounds
    wanted = {r: METRES[r] for r in resolutions}
    finest = min(wanted.values())
    low, high = (geo.utm_easting_northing(F.lit(x), F.lit(y)) for x, y in ((west, south), (east, north)))
    cols, rows, error = geo.grid_cells(F.abs(high[0] - low[0]), F.abs(high[1] - low[1]), F.lit(finest))
    about = spark.range(1).select(cols.alias("cols"), rows.alias("rows"), error.alias("error"), low[0].alias("west"), high[1].alias("north")).first()
    if about["error"]:
        raise ValueError(about["error"])
    width = about["cols"]
    cells = spark.range(width * about["rows"]).select(F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    dem = staged(terrain.make_dem(cells, biome, seed, finest))
    unit = st.stretch(dem, F.col("z_m"), "n").select("y", "x", "z_m", "n", (F.col("n") < SEA).alias("water"), (F.col("n") < FLOOD).alias("flood"), (F.col("n") < SEA / 3).alias("river"))
    colours = palettes.build_rgb(unit.select("y", "x", "n", "river", "water"), biome, seed)
    base = unit.select("y", "x", F.col("z_m").alias("z"), "water", "flood").join(colours, ["y", "x"])
    world.build(spark, base, finest, wanted, path, about["west"], about["north"], timestamp)
    discard(dem)


def settings(spark: SparkSession, path: str):
    """A configuration file's numbers: routes and their types, zones of each kind, thermal frames, seed."""
    kinds = ", ".join(f"{k}: int" for k in fleets.KINDS)
    r = spark.read.option("multiLine", True).schema(f"num_routes int, route_type array<string>, num_zones struct<{kinds}>, flir_frames int, random_seed int").json(path).first()
    zones = r["num_zones"].asDict() if r and r["num_zones"] else {}
    return {"routes": r["num_routes"] or 0, "types": r["route_type"] or ["ferry"], "zones": {k: zones.get(k) or 0 for k in fleets.KINDS}, "frames": r["flir_frames"] or 0, "seed": r["random_seed"] if r["random_seed"] is not None else 42}


def procedural_zones(spark: SparkSession, counts: dict[str, int], seed: int, box: Box, smooth: bool = True) -> DataFrame:
    """(zone_id, zone_type, restriction, ring): so many zones of each kind."""
    kinds = len(fleets.KINDS)
    most = max([0, *counts.values()])
    wanted = F.element_at(F.array(*[F.lit(counts.get(k, 0)) for k in fleets.KINDS]), (F.col("id") % kinds + 1).cast("int"))
    return fleets.zones(spark.range(most * kinds).where(F.floor(F.col("id") / kinds) < wanted).select(F.col("id").alias("key")), seed, box, smooth)


def procedural_routes(spark: SparkSession, count: int, types: list[str], seed: int, box: Box) -> DataFrame:
    """(route_id, type, slon, slat, elon, elat): ends at random places of the box, types in turn."""
    keys = fleets.drawn(spark.range(count).select(F.col("id").alias("key")), 5, seed + 3000)
    lon, lat = (lambda n: box.west + (box.east - box.west) * fleets.draw(n)), (lambda n: box.south + (box.north - box.south) * fleets.draw(n))
    kind = F.element_at(F.array(*map(F.lit, types)), (F.col("key") % len(types) + 1).cast("int"))
    return keys.select(F.col("key").alias("route_id"), kind.alias("type"), lon(1).alias("slon"), lat(2).alias("slat"), lon(3).alias("elon"), lat(4).alias("elat"))


def run_maritime(spark: SparkSession, config: str, path: str, timestamp: str, box: Box = Box(), reach: float = 0.5) -> list[str]:
    """Everything that a configuration file asks for, written to folders under path; returns their names. Users' routes are
    planned around users' zones, generated ones around all zones. Outputs without rows aren't written."""
    conf, asked, made = geojson.config(spark, config), settings(spark, config), []

    def write(name: str, features: DataFrame) -> None:
        geojson.write(features, f"{path}/{name}")
        made.append(name)

    # a configuration is one file: its zones are numbered in one task
    own = staged(geojson.user_zones(conf).withColumn("key", F.row_number().over(Window.orderBy("zone_id")).cast("bigint") - 1))
    numbered = own.select(F.col("key").alias("zone_id"), "ring")
    if not own.isEmpty():
        write("user_zones", geojson.features(own, "Polygon", "ring", ["zone_id", "name", "zone_type", "restriction"]))
    routes = geojson.user_routes(conf)
    planned = lambda legs, zones: wayfinding.route_properties(wayfinding.plan(legs, zones, wayfinding.buffer_of(zones), reach))
    props = ["route_id", "type", "vessel_type", "suspicious", "waypoints", "route_valid", "warning"]
    if not routes.isEmpty():
        write("user_routes", geojson.features(planned(routes, numbered).join(routes.select("route_id", "name"), "route_id"), "LineString", "line", ["name", *props]))
    zones = staged(procedural_zones(spark, asked["zones"], asked["seed"], box))
    if not zones.isEmpty():
        write("procedural_zones", geojson.features(zones, "Polygon", "ring", ["zone_id", "zone_type", "restriction"]))
    if asked["routes"]:
        # around the unsmoothed zones, whose corners are few
        outlines = procedural_zones(spark, asked["zones"], asked["seed"], box, smooth=False)
        every = staged(geojson.obstacles(numbered, outlines).select("zone_id", "ring"))
        write("procedural_routes", geojson.features(planned(procedural_routes(spark, asked["routes"], asked["types"], asked["seed"], box), every), "LineString", "line", props))
        discard(every)
    if asked["frames"]:
        frames = spark.range(asked["frames"]).select(F.col("id").cast("int").alias("frame"))
        imaging.thermal_frames(frames, imaging.thermal_base(spark, 64, "generic", asked["seed"]), 64, asked["seed"]).write.mode("overwrite").partitionBy("frame").parquet(f"{path}/flir")
        made.append("flir")
    runs.write_metadata(spark, f"{path}/metadata", "maritime", timestamp, outputs=made)
    discard(own)
    discard(zones)
    return made
