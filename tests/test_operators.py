"""Invariants and NumPy cross-checks of the operators, and given values of the generators."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartosea.functions import noise
from cartosea.operators import geometry, graph, imaging
from cartosea.operators import stencil as st
from cartosea.sources import generators as gen
from cartosea.sources import geojson


def _cells(spark, a):
    return spark.createDataFrame([(int(y), int(x), float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], "y int, x int, z double")


def _array(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["y"], r["x"]] = r[name]
    return out


@pytest.fixture(scope="module")
def z():
    return np.random.default_rng(3).random((9, 11))


def test_blur_wraps_and_keeps_the_mean(spark, z):
    one = lambda a: sum(np.roll(a, d, i) for i, d in ((0, 1), (0, -1), (0, 0))) / 3
    want = z
    for _ in range(2):
        want = one(want)
        want = sum(np.roll(want, d, 1) for d in (-1, 0, 1)) / 3
    assert np.allclose(_array(st.blur(_cells(spark, z), "z", 2), "v", z.shape), want)
    assert np.allclose(_array(st.blur(_cells(spark, z), "z", 1), "v", z.shape), z)


def test_gradient_and_laplacian_equal_numpy(spark, z):
    g = st.gradient(_cells(spark, z), "z", 2.0)
    gy, gx = np.gradient(z, 2.0)
    assert np.allclose(_array(g, "gy", z.shape), gy) and np.allclose(_array(g, "gx", z.shape), gx)
    lap = np.abs(sum(np.roll(z, d, i) for i in (0, 1) for d in (1, -1)) - 4 * z)
    assert np.allclose(_array(st.laplacian(_cells(spark, z)), "lap", z.shape), lap)


def test_area_resize_keeps_the_mean(spark, z):
    small = st.area_resize(_cells(spark, z), "z", 3, 4).collect()
    assert len(small) == 12 and math.isclose(np.mean([r["v"] for r in small]), z.mean(), rel_tol=1e-9)


def test_flow_sums_to_the_outlets(spark, z):
    acc = graph.flow_accumulation(graph.d8_direction(_cells(spark, z)))
    ends = acc.join(graph.d8_direction(_cells(spark, z)), ["y", "x"]).where("dir < 0").agg(F.sum("acc")).first()[0]
    assert ends == z.size


def _counted(monkeypatch):
    """The number of times that graph writes a round, as a list that grows."""
    calls, plain = [], graph.staged
    monkeypatch.setattr(graph, "staged", lambda df: calls.append(1) or plain(df))
    return calls


def test_flow_across_tiles_equals_a_walk(spark, monkeypatch):
    h, w = 270, 300
    a = np.add.outer(np.abs(np.arange(h) - 131) * 1.0, np.abs(np.arange(w) - 40) * 0.7) + np.random.default_rng(8).random((h, w))
    cells = graph.staged(_cells(spark, a))
    d = _array(graph.d8_direction(cells), "dir", a.shape).astype(int)
    want = np.ones(a.shape, int)
    for y, x in sorted(np.ndindex(a.shape), key=lambda p: -a[p]):
        if d[y, x] >= 0:
            want[y + graph.D8[d[y, x]][0], x + graph.D8[d[y, x]][1]] += want[y, x]
    assert (_array(graph.flow_accumulation(graph.d8_direction(cells)), "acc", a.shape) == want).all()
    calls = _counted(monkeypatch)
    ramp = graph.d8_direction(_cells(spark, np.add.outer(np.arange(200.0, 0, -1), [1000.0, 0.0, 1000.0])))
    assert graph.flow_accumulation(ramp).agg(F.max("acc")).first()[0] == 199
    assert len(calls) <= 4  # rounds don't grow with the length of what one tile holds


def test_components_across_tiles(spark, monkeypatch):
    h, w = 270, 530
    a = (np.random.default_rng(9).random((h, w)) < 0.6).astype(float)
    want = np.where(a > 0, np.add.outer(np.arange(h) << 32, np.arange(w)), 1 << 62)
    while True:
        p = np.pad(want, 1, constant_values=1 << 62)
        low = np.where(a > 0, np.minimum.reduce([want, p[2:, 1:-1], p[:-2, 1:-1], p[1:-1, 2:], p[1:-1, :-2]]), 1 << 62)
        if (low == want).all():
            break
        want = low
    cells = _cells(spark, a).select("y", "x", (F.col("z") > 0).alias("m"))
    got = graph.components(cells, "m").collect()
    assert len(got) == int(a.sum()) and all(r["label"] == want[r["y"], r["x"]] for r in got)
    calls = _counted(monkeypatch)
    snake = np.array([[y % 2 == 0 or x == (0 if y % 4 == 1 else 40) for x in range(41)] for y in range(41)]) * 1.0
    assert graph.components(_cells(spark, snake).select("y", "x", (F.col("z") > 0).alias("m")), "m").select("label").distinct().count() == 1
    assert len(calls) <= 4  # rounds don't grow with the windings within a tile
    assert graph.components(cells.where("y < 0"), "m").count() == 0


def test_components(spark):
    m = np.array([[1, 1, 0, 1], [0, 1, 0, 1], [1, 0, 0, 0], [1, 1, 1, 1]], float)
    cells = _cells(spark, m).withColumn("m", F.col("z") > 0)
    sizes = sorted(r["count"] for r in graph.components(cells, "m").groupBy("label").count().collect())
    assert sizes == [2, 3, 5]
    assert graph.drop_small(cells, "m", 3).count() == 8


def test_noise_is_the_same_in_any_tile(spark):
    grid = spark.range(400).select((F.col("id") % 20).alias("x"), F.floor(F.col("id") / 20).alias("y"))
    whole = {(r["x"], r["y"]): r["n"] for r in grid.select("x", "y", noise.fbm(F.col("x"), F.col("y"), 3, 8, seed=1).alias("n")).collect()}
    part = grid.where("x >= 10 and y >= 10").select("x", "y", noise.fbm(F.col("x"), F.col("y"), 3, 8, seed=1).alias("n")).collect()
    assert all(whole[r["x"], r["y"]] == r["n"] for r in part) and all(0 <= v <= 1 for v in whole.values())


def test_hash_lattice_equals_wrapping_arithmetic(spark):
    pts = [(x, y) for x in range(-40, 40, 7) for y in range(-40, 40, 9)]
    with np.errstate(over="ignore"):
        x, y = (np.array(v, np.int64) for v in zip(*pts))
        h = (x * 73856093) ^ (y * 19349663) ^ np.int64(42 * 83492791)
        h = (h ^ (h >> 16)) * np.int64(0x85EBCA6B)
        h = (h ^ (h >> 13)) * np.int64(0xC2B2AE35)
        want = ((h ^ (h >> 16)) & 0xFFFFFF) / 0xFFFFFF
    df = spark.createDataFrame([(int(a), int(b)) for a, b in pts], "x long, y long").coalesce(1)
    got = [r["h"] for r in df.select(noise.hash_lattice(F.col("x"), F.col("y"), 42).alias("h")).collect()]
    assert np.allclose(got, want, atol=0)


def test_generators_given_values():
    v = list(gen.vessel_rows(gen.Box(), 10, 42))
    assert v[0] == ("vessel_001", "Passenger A1", "passenger", -122.37211464030842, 37.505002151044536, 22.4, 50.2, "200000000", 76)
    kinds = [r[2] for r in v]
    assert {k: kinds.count(k) for k in set(kinds)} == {"passenger": 3, "cargo": 3, "military": 3, "tanker": 1}
    a = list(gen.asset_rows(gen.Box(), 15, 2042))
    assert a[0] == ("lighthouse_001", "Lighthouse A1", "lighthouse", -122.37948617808242, 37.54676138982991, None, None, 19, 21, None, None)
    r = list(gen.route_rows(gen.Box(), 10, 3042))
    assert [len(x[3]) for x in r] == [10, 13, 13, 18, 14, 14, 14, 17, 12, 14, 14, 13, 13]
    assert tuple(map(float, r[0][3][0])) == (-122.42270274553023, 37.54601816120767)


def test_user_files(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"user_no_go_zones": [{"id": "a", "coordinates": [[0,0],[1,0],[1,1]]}, {"coordinates": [[0,0],[1,1]]}, {"name": "n", "zoneType": "military", "coordinates": [[2,2],[3,2],[3,3],[2,2]]}],\n "user_routes": [{"start": {"lon": 0, "lat": 0}, "end": {"lon": 1, "lat": 1}, "type": "ferry"}, {"start": {"lon": 0, "lat": 0}}, {"start": {"lon": 2, "lat": 0}, "end": {"lon": 1, "lat": 1}}]}')
    conf = geojson.config(spark, str(path))
    z = geojson.user_zones(conf)
    assert {(r["zone_id"], r["zone_type"], len(r["ring"])) for r in z.collect()} == {("a", "mpa", 4), ("user_zone_2", "military", 4)}
    # numbered by the place among the kept ones
    assert [(r["route_id"], r["name"], r["type"]) for r in geojson.user_routes(conf).collect()] == [("route_0", "Route 1", "ferry"), ("route_1", "Route 2", "irregular")]
    with pytest.raises(ValueError):
        geojson.write_route(spark, "not_a_route", str(tmp_path / "r"))
    geojson.write_route(spark, [(0, 0), (0.1, 0.1), (0.2, 0.2)], str(tmp_path / "r"), {"vessel": "test_boat", "speed": 10})
    (one,) = geojson.read(spark, str(tmp_path / "r")).collect()
    assert one["kind"] == "LineString" and json.loads(one["coordinates"]) == [[0, 0], [0.1, 0.1], [0.2, 0.2]] and json.loads(one["properties"])["vessel"] == "test_boat"
    out = str(tmp_path / "z")
    geojson.write(geojson.features(z, "Polygon", "ring", ["zone_id", "zone_type"]), out)
    back = geojson.read(spark, out)
    assert back.count() == 2 and {r["kind"] for r in back.collect()} == {"Polygon"}
    assert sorted(r["area"] for r in z.select(geometry.area(F.col("ring")).alias("area")).collect()) == [0.5, 0.5]


def test_sensor_tiles_have_no_seams(spark):
    rng = np.random.default_rng(1)
    n = 70
    img, dem, water = rng.random((n, n, 3)), 20 * rng.random((n, n)), (rng.random((n, n)) < 0.4).astype(float)
    s = imaging.Sensor(noise_sigma=0.02)
    whole = imaging.sense(img, s, imaging.Frame(np.arange(n), np.arange(n), n, n), dem, water)
    rows = [(y, x, *map(float, img[y, x]), float(dem[y, x]), float(water[y, x])) for y in range(n) for x in range(n)]
    df = spark.createDataFrame(rows, "y int, x int, r double, g double, b double, z double, water double")
    for tile in (24, 50):
        got = np.zeros_like(img)
        for r in imaging.sense_tiles(df, imaging.Sensor(noise_sigma=0.02, tile=tile, halo=24)).collect():
            got[r["y"], r["x"]] = r["r"], r["g"], r["b"]
        assert np.abs(got - whole).max() < 1e-9
    assert imaging.sense(img[:1, :1], s, imaging.Frame(np.arange(1), np.arange(1), 1, 1)).shape == (1, 1, 3)


def test_nearest_zones_reach_any_distance(spark):
    rng = np.random.default_rng(3)
    rings = {}
    for i in range(60):
        x, y, r = (*rng.uniform(0, 0.4, 2), 0.003) if i < 54 else (*rng.uniform(-40, 40, 2), rng.uniform(0.001, 0.2))
        rings[i] = [(x + r * dx, y + r * dy) for dx, dy in ((1, 0), (0, 1), (-1, 0), (0, -1), (1, 0))]
    zones = spark.createDataFrame([(i, [{"lon": float(a), "lat": float(b)} for a, b in r]) for i, r in rings.items()], "zone_id long, ring array<struct<lon: double, lat: double>>")
    every = {(r["a"], r["b"]): r["dist"] for r in geometry.zone_distances(zones, 3).collect()}
    assert len(every) == 60 * 59 // 2
    best = {i: min((d, a + b - i) for (a, b), d in every.items() if i in (a, b)) for i in rings}
    got = {r["zone_id"]: (r["dist"], r["nearest"]) for r in geometry.nearest_zones(zones, 0.004).collect()}
    assert got == best
    assert {(r["a"], r["b"]): r["dist"] for r in geometry.zones_within(zones, 0.06).collect()} == {k: d for k, d in every.items() if d <= 0.06}
    (alone,) = geometry.nearest_zones(zones.where("zone_id = 1")).collect()
    assert alone["nearest"] is None and geometry.nearest_zones(zones.limit(0)).count() == 0


def test_entry_points_import():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "traj_length_km" in e.queries()


def test_raster_files(spark, z, tmp_path):
    from cartosea.sources import rasters

    holes = _cells(spark, z).withColumn("z", F.when(F.col("x") == 3, float("nan")).otherwise(F.col("z")))
    for name in ("dem", "slope"):
        rasters.write(holes, "z", str(tmp_path), name, "1m", 1.0, 500.0, 900.0, "m")
    back = rasters.read(spark, str(tmp_path), "dem", "1m")
    assert back.count() == z.size and back.where("value is null").count() == z.shape[0]
    about = spark.read.parquet(f"{tmp_path}/layers").where("layer = 'dem'").first()
    assert (about["height"], about["width"], about["min_zoom"], about["transform"]["f"]) == (9, 11, 14, 900.0)


def test_exact_quantiles_by_narrowing(spark, monkeypatch):
    from cartosea.operators import ranks

    rng = np.random.default_rng(3)
    monkeypatch.setattr(ranks, "FEW", 50)
    for v in (rng.normal(size=3000), np.repeat([1.0, 2.0, 5.0], [2000, 900, 100]), np.arange(7.0)):
        df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "z double").repartition(3)
        qs = [0.0, 0.015, 0.5, 0.985, 1.0]
        assert np.allclose(ranks.quantiles(df, "z", qs), np.quantile(v, qs), rtol=0, atol=1e-12)
    assert ranks.quantiles(df.limit(0), "z", [0.5]) == [None]


def test_tiles_do_not_change_stencils(spark, monkeypatch):
    a = np.random.default_rng(5).random((23, 17))
    df = _cells(spark, a)
    want = {(r["y"], r["x"]): (r["gy"], r["gx"]) for r in st.gradient(df, "z").collect()}
    gy, gx = np.gradient(a)
    assert all(abs(gy[k] - v[0]) < 1e-12 and abs(gx[k] - v[1]) < 1e-12 for k, v in want.items()) and len(want) == a.size
    small = st.tiles(df, 1, 5)
    assert st.own(small).count() == a.size
    for k in (2, 6):
        b = a.copy()
        for _ in range(k):
            b = (np.roll(b, 1, 0) + b + np.roll(b, -1, 0)) / 3
            b = (np.roll(b, 1, 1) + b + np.roll(b, -1, 1)) / 3
        assert all(abs(b[r["y"], r["x"]] - r["v"]) < 1e-9 for r in st.blur(df, "z", k).collect())
    mask = spark.createDataFrame([(y, x, bool(a[y, x] > 0.4)) for y in range(23) for x in range(17)], "y int, x int, m boolean")
    plain = {(r["y"], r["x"]): r["m"] for r in st.open_close(mask, "m").collect()}
    monkeypatch.setattr(st, "TILE", 5)
    whole = st.tiles
    monkeypatch.setattr(st, "tiles", lambda cells, halo, size=5: whole(cells, halo, size))
    assert {(r["y"], r["x"]): r["m"] for r in st.open_close(mask, "m").collect()} == plain
    assert {(r["y"], r["x"]): (r["gy"], r["gx"]) for r in st.gradient(df, "z").collect()} == want


def test_run_metadata(spark, tmp_path):
    from cartosea.sources import runs

    bounds = {"max_lat": 37.6, "max_lon": -122.3, "min_lat": 37.5, "min_lon": -122.5}
    runs.write_metadata(spark, str(tmp_path / "m"), "a generator", "2026_03_08_125158", area_km=1, bounds=bounds, resolutions=["1m", "10m"])
    assert runs.read_metadata(spark, str(tmp_path / "m")) == {"generator": "a generator", "timestamp": "2026_03_08_125158", "area_km": 1, "bounds": bounds, "resolutions": ["1m", "10m"]}
    assert runs.archived(["b/x.tif", "a.PNG", ".hidden.json", "_tmp.tif", "note.txt"]) == ["a.PNG", "b/x.tif"]


def test_all_published_rows():
    """Digests of all published rows of seed 42: 10 vessels, 4 lanes, 15 assets, 13 routes."""
    import hashlib

    plain = lambda v: [[float(x), float(y)] for x, y in v] if isinstance(v, list) else v
    digest = lambda rows: hashlib.sha256(json.dumps([[plain(v) for v in r] for r in rows]).encode()).hexdigest()[:16]
    box = gen.Box()
    assert digest(gen.vessel_rows(box, 10, 42)) == "4186845242d823e7"
    assert digest(gen.lane_rows(box, 4, 1042)) == "f68822ebf7a484fb"
    assert digest(gen.asset_rows(box, 15, 2042)) == "02e3a02f5a6ce4ab"
    assert digest(gen.route_rows(box, 10, 3042)) == "b247921b1aefb2c1"


def test_zones_by_set(spark, sf):
    from cartosea.sources import fleets
    from cartosea.sources import tables as t

    rows = spark.range(60).select(F.col("id").alias("key"))
    box = gen.Box()
    raw = fleets.stars(rows)
    smooth = geometry.smooth_rings(raw, F.col("smooth"))
    area = lambda z: {r["zone_id"]: r["a"] for r in z.select("zone_id", geometry.area(F.col("ring")).alias("a")).collect()}
    before, after = area(raw), area(smooth)
    assert all(0 < after[k] <= before[k] * (1 + 1e-12) for k in before) and any(after[k] < before[k] for k in before)
    cut = geometry.bounds(fleets.zones(rows)).collect()
    assert len(cut) == 60
    for r in cut:
        assert box.west - 1e-12 <= r["min_lon"] and r["max_lon"] <= box.east + 1e-12 and box.south - 1e-12 <= r["min_lat"] and r["max_lat"] <= box.north + 1e-12
    crossed = {r["zone_id"] for r in geometry.ring_faults(raw).where("crossings > 0").collect()}
    assert {r["zone_id"] for r in geometry.ring_faults(smooth).where("not valid").collect()} <= crossed
    # a square's corners become quarter circles
    ring = [{"lon": float(x), "lat": float(y)} for x, y in ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))]
    for way in (ring, ring[::-1]):
        z = spark.createDataFrame([(1, way)], "zone_id long, ring array<struct<lon: double, lat: double>>")
        assert area(geometry.smooth_rings(z, F.lit(1.0), 400))[1] == pytest.approx(16 - (4 - math.pi), abs=1e-4)
    bow = spark.createDataFrame([(1, [ring[i] for i in (0, 2, 1, 3, 0)]), (2, ring[:4])], "zone_id long, ring array<struct<lon: double, lat: double>>")
    assert {r["zone_id"]: (r["closed"], r["crossings"], r["valid"]) for r in geometry.ring_faults(bow).collect()} == {1: (True, 1, False), 2: (False, 0, False)}
    routes = fleets.routes(rows).collect()
    assert {r["type"] for r in routes} == {"ferry", "tss", "irregular"} and all(0 <= s < len(r["line"]) for r in routes for s in r["stops"])
    assert all(len(r["stops"]) == (2 if r["type"] == "irregular" else 0) for r in routes)


def test_quantiles_make_their_column_once(spark, monkeypatch):
    from cartosea.operators import ranks

    monkeypatch.setattr(ranks, "FEW", 50)
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(k):
        made.add(1)
        return float(k * 7919 % 3001)

    df = spark.range(3000).repartition(3).select(value("id").alias("v"))
    assert np.isclose(ranks.quantiles(df, "v", [0.85])[0], np.quantile(np.arange(3000) * 7919 % 3001, 0.85)) and made.value == 3000


@pytest.mark.parametrize("shape", [(9, 11), (1, 7), (5, 1)])
def test_one_pass_tells_what_separate_ones_do(spark, shape):
    """Blur, gradient and Laplacian together, on whole grids and (but for the Laplacian) with the last row cut short."""
    z = np.random.default_rng(8).random(shape)
    short = _cells(spark, z).where((F.col("y") < shape[0] - 1) | (F.col("x") < max(1, shape[1] // 2)))
    for cells, names in ((_cells(spark, z), ["m", "gy", "gx", "lap"]), (short, ["m", "gy", "gx"])):
        got = st.blurs(cells.withColumn("m", F.col("z")), {"m": 6}, ["z"], "z")
        want = st.gradient(cells, "z").join(st.laplacian(cells), ["y", "x"]).join(st.blur(cells, "z", 6).withColumnRenamed("v", "m"), ["y", "x"])
        one, two = ({(r["y"], r["x"]): [r[c] for c in names] for r in df.collect()} for df in (got, want))
        assert one == two


def test_mountains_join_no_cells(spark):
    """Cells go to tiles with what they have; no step joins them back."""
    from cartosea.operators import palettes

    n = F.col("z")
    cells = _cells(spark, np.random.default_rng(1).random((6, 5))).select("y", "x", n.alias("n"), (n < 0.1).alias("river"), (n < 0.2).alias("water"))
    plan = palettes.build_rgb(cells, "mountain")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and "Join Cross" in plan


def test_noise_of_close_places_is_that_of_each_alone():
    from cartosea.operators import lattice

    y, x = (v.ravel() for v in np.mgrid[-9:40, -5:60])
    for grid in (2, 7, 200):
        alone = np.concatenate([lattice.points_noise(y[i : i + 1], x[i : i + 1], grid, 11) for i in range(len(y))])
        assert (lattice.points_noise(y, x, grid, 11) == alone).all()
    assert len(lattice.points_noise(y[:0], x[:0], 7, 11)) == 0
