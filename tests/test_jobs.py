"""Files of runs: base world, overviews, collections, archives, requests."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartosea.operators import city, palettes, world
from cartosea.operators import stencil as st
from cartosea.sources import geojson, rasters, runs


def _base(spark, h=40, w=30):
    rng = np.random.default_rng(2)
    rows = [(y, x, float(30 * np.sin(y / 9) + 20 * np.cos(x / 7)), bool(rng.random() < 0.2), bool(rng.random() < 0.3), *map(float, rng.random(3))) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "y int, x int, z double, water boolean, flood boolean, r double, g double, b double")


def test_base_world(spark, tmp_path):
    base, path = _base(spark), str(tmp_path)
    wanted = {"1m": 1.0, "5m": 5.0, "10m": 10.0}
    world.build(spark, base, 1.0, wanted, path, 500.0, 900.0, "2026_01_02_030405")
    about = spark.read.parquet(f"{path}/layers").collect()
    assert len(about) == 3 * len(world.LAYERS) and {(r["resolution"], r["height"], r["width"]) for r in about} == {("1m", 40, 30), ("5m", 8, 6), ("10m", 4, 3)}
    assert {r["resolution"]: r["transform"]["a"] for r in about} == wanted
    want = {(r["y"], r["x"]): r for r in world.level(base, 5, 5.0).collect()}
    for layer in ("dem", "water", "hillshade", "visual", "r"):
        got = {(r["y"], r["x"]): r["value"] for r in rasters.read(spark, path, layer, "5m").collect()}
        assert got == {k: pytest.approx(r[layer]) for k, r in want.items()}
    assert runs.read_metadata(spark, f"{path}/manifest")["resolutions"] == wanted
    with pytest.raises(ValueError, match="multiple"):
        world.build(spark, base, 1.0, {"odd": 2.5}, path, 0.0, 0.0, "x")


def test_overviews_are_stored_by_level(spark, tmp_path):
    base = _base(spark).select("y", "x", "z", F.col("water").cast("double").alias("m"))
    rasters.write_overviews(base, "z", str(tmp_path), "dem", "1m")
    rasters.write_overviews(base, "m", str(tmp_path), "water", "1m", nearest=True)
    for level in rasters.LEVELS:
        k = 1 << level
        one = rasters.read_overview(spark, str(tmp_path), "dem", "1m", level)
        got = {(r["y"], r["x"]): r["value"] for r in one.collect()}
        whole = {(r["by"], r["bx"]): r["z"] for r in st.block(base, k, z=F.avg("z")).collect()}
        assert len(got) == -(-40 // k) * -(-30 // k) and all(got[p] == pytest.approx(v) for p, v in whole.items())
        files = one.inputFiles()
        assert files and all(f"level={level}/" in f and "layer=dem/" in f for f in files)
        marks = {(r["y"], r["x"]): r["value"] for r in rasters.read_overview(spark, str(tmp_path), "water", "1m", level).collect()}
        own = {(r["y"], r["x"]): r["m"] for r in base.collect()}
        assert marks == {p: own[p[0] * k + k // 2, p[1] * k + k // 2] for p in marks} and len(marks) >= (40 // k) * (30 // k)
    assert rasters.rescaled({"a": 2.0, "b": 0.0, "c": 5.0, "d": 0.0, "e": -2.0, "f": 7.0}, 30, 40, 10, 16) == {"a": 6.0, "b": 0.0, "c": 5.0, "d": 0.0, "e": -5.0, "f": 7.0}


def test_collections(spark, tmp_path):
    rows = spark.createDataFrame([(i, {"lon": float(i), "lat": 1.0}) for i in range(20)], "id long, p struct<lon: double, lat: double>").repartition(5)
    for n in (20, 1, 0):
        out = str(tmp_path / str(n))
        geojson.write_collection(geojson.features(rows.where(F.col("id") < n), "Point", "p", ["id"]), out)
        (text,) = [r[0] for r in spark.read.text(out, wholetext=True).collect()]
        found = json.loads(text)
        assert found["crs"] == geojson.CRS and {f["properties"]["id"] for f in found["features"]} == set(range(n))
    assert geojson.read(spark, str(tmp_path / "20")).count() == 20


def test_requests_and_archives(spark):
    runs.check_request((0, 0, 1, 1), ["1m", "25cm"])
    for bounds, names in (((1, 0, 0, 1), []), ((0, 1, 1, 1), []), ((0, 0, 1, 1), ["2m"])):
        with pytest.raises(ValueError):
            runs.check_request(bounds, names)
    names = ["dem_1m.tif", "dem_10m.tif", "rgb_25cm.tif", "water_1m.png", "other_1m.tif", "slope.tif", "zoom_levels.json", "preview_imagery.png", "dataset.zip"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    kept = lambda r: {x["name"] for x in runs.archived_layers(df, r).collect()}
    assert kept(["1m"]) == {"dem_1m.tif", "zoom_levels.json", "preview_imagery.png"}
    assert kept(["25cm", "10m"]) == {"dem_10m.tif", "rgb_25cm.tif", "zoom_levels.json", "preview_imagery.png"}
    assert kept([]) == {"zoom_levels.json", "preview_imagery.png"}


def test_city_has_roads_and_parks(spark):
    cells = spark.range(220 * 230).select(F.floor(F.col("id") / 230).cast("int").alias("y"), (F.col("id") % 230).cast("int").alias("x")).select("y", "x", (F.col("y") / 220.0).alias("n"), ((F.col("x") > 60) & (F.col("x") < 80)).alias("water"))
    out = city.city_rgb(cells, 7).agg(F.count_if("road").alias("road"), F.count_if(F.col("road") & F.col("water")).alias("wet"), F.count("*").alias("n")).first()
    assert 1000 < out["road"] < out["n"] / 4 and out["wet"] == 0
    assert palettes.build_rgb(cells.withColumn("river", F.lit(False)), "city").count() == 220 * 230
    scene = city.city_scene(cells).agg(F.avg(F.col("road").cast("double")).alias("road"), F.count_if("park").alias("park"), F.min("height"), F.max("height")).first()
    assert 0.1 < scene["road"] < 0.25 and scene[2] == 0.0 and 20.0 <= scene[3] <= 35.0


def test_no_boolean_column_is_constant(sf):
    """A mask that is false or true everywhere proves nothing; the ones listed are so by what they say."""
    import duckdb

    from cartosea.plans import registry

    listed = {("obstacles", "closed"), ("ring_validity", "closed"), ("rivers_d8", "flood"), ("rivers_d8", "river"), ("planned_routes", "route_valid"), ("map_tiles", "allowed"), ("pyramid_levels", "water")}
    # the smallest grid has the top rows of a silhouette only, and no park
    listed |= {("vessel_silhouette", k) for k in ("small", "generic", "large")} | {("city_scene", "park")}
    c = duckdb.connect()
    for n in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '/root/testdata/sf0.001/{n}.parquet'" if sf is None else f"CREATE VIEW {n} AS SELECT * FROM '{sf}/{n}.parquet'")
    constant = set()
    for name, sql in registry.oracle_sql().items():
        r = c.execute(sql)
        flags = [(i, d[0]) for i, d in enumerate(r.description) if str(d[1]) == "BOOLEAN"]
        rows = r.fetchall()
        assert rows, name
        constant |= {(name, k) for i, k in flags if len(rows) > 1 and len({x[i] for x in rows}) == 1}
    assert constant <= listed, constant - listed


def test_maritime_run(spark, tmp_path):
    from cartosea import jobs

    conf = tmp_path / "config.json"
    box = lambda w, s, e, n: [[w, s], [e, s], [e, n], [w, n]]
    conf.write_text(json.dumps({
        "user_no_go_zones": [{"id": "a", "name": "A", "zoneType": "military", "coordinates": box(148.04, -37.76, 148.06, -37.74)}],
        "user_routes": [{"id": "r", "name": "R", "start": {"lon": 148.0, "lat": -37.9}, "end": {"lon": 148.1, "lat": -37.6}, "type": "ferry"}],
        "num_routes": 4, "route_type": ["ferry", "irregular"], "num_zones": {"mpa": 1, "military": 0, "windfarm": 2}, "flir_frames": 2, "random_seed": 5,
    }))
    made = jobs.run_maritime(spark, str(conf), str(tmp_path / "out"), "2026_01_02_030405")
    assert made == ["user_zones", "user_routes", "procedural_zones", "procedural_routes", "flir"] == runs.read_metadata(spark, str(tmp_path / "out/metadata"))["outputs"]
    (route,) = geojson.read(spark, str(tmp_path / "out/user_routes")).collect()
    about = json.loads(route["properties"])
    assert about["route_valid"] and about["waypoints"] > 2 and about["vessel_type"] == "ferry"
    kinds = [json.loads(r["properties"])["zone_type"] for r in geojson.read(spark, str(tmp_path / "out/procedural_zones")).collect()]
    assert sorted(kinds) == ["mpa", "windfarm", "windfarm"]
    assert geojson.read(spark, str(tmp_path / "out/procedural_routes")).count() == 4
    assert spark.read.parquet(str(tmp_path / "out/flir")).groupBy("frame").count().collect()[0]["count"] == 64 * 64
    conf.write_text("{}")
    assert jobs.run_maritime(spark, str(conf), str(tmp_path / "none"), "2026_01_02_030405") == []


def test_terrain_run(spark, tmp_path):
    from cartosea import jobs

    bounds = (-122.5000, 37.5000, -122.4995, 37.5004)
    jobs.run_terrain(spark, "coast", bounds, ["1m", "10m"], str(tmp_path), "2026_01_02_030405")
    about = {(r["layer"], r["resolution"]): (r["height"], r["width"]) for r in spark.read.parquet(f"{tmp_path}/layers").collect()}
    assert len(about) == 2 * len(world.LAYERS)
    h, w = about["dem", "1m"]
    assert 40 < w < 50 and 40 < h < 50 and about["dem", "10m"] == (h // 10, w // 10)
    for wrong in (((0, 1, 1, 0), ["1m"]), (bounds, ["3m"]), ((-122.5, 37.5, -122.0, 38.0), ["1m"])):
        with pytest.raises(ValueError):
            jobs.run_terrain(spark, "coast", *wrong, str(tmp_path / "no"), "x")
