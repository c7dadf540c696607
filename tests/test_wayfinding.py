"""Planning by set against one route after another in plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartosea.operators import wayfinding
from tests import planner

BOX = lambda w, s, e, n: [(w, s), (e, s), (e, n), (w, n), (w, s)]
RINGS = "zone_id long, ring array<struct<lon: double, lat: double>>"
LEGS = "route_id long, type string, slon double, slat double, elon double, elat double"


def _zones(spark, rings):
    return spark.createDataFrame([(i, [{"lon": float(x), "lat": float(y)} for x, y in r]) for i, r in enumerate(rings)], RINGS)


@pytest.mark.parametrize(
    "rings, kind, points",
    [([], "ferry", 2), ([BOX(148.5, -37.8, 148.55, -37.75)], "ferry", 2), ([BOX(148.04, -37.76, 148.06, -37.74)], "ferry", None), ([BOX(148.04, -37.76, 148.06, -37.74)], "irregular", 2), ([BOX(148.03, -37.78, 148.06, -37.72), BOX(148.07, -37.78, 148.10, -37.72)], "ferry", None)],
)
def test_scenarios(spark, rings, kind, points):
    buffer = 0.018 if len(rings) < 2 else 0.005
    line, ok = planner.plan((148.0, -37.9), (148.1, -37.6), rings, kind, buffer)
    assert ok and (len(line) > 2 if points is None else len(line) == points)
    legs = spark.createDataFrame([(1, kind, 148.0, -37.9, 148.1, -37.6)], LEGS)
    (got,) = wayfinding.plan(legs, _zones(spark, rings), buffer, 1.0).collect()
    assert got["route_valid"] and got["waypoints"] == len(line)
    assert np.allclose([(p["lon"], p["lat"]) for p in got["line"]], line)


def _world(seed=4):
    rng = np.random.default_rng(seed)
    rings = []
    for x, y in rng.uniform(0, 0.2, (9, 2)):
        a, r = rng.uniform(0, 6), rng.uniform(0.004, 0.02)
        v = [(float(x + r * math.cos(a + k * math.tau / 5)), float(y + r * math.sin(a + k * math.tau / 5))) for k in range(5)]
        rings.append([*v, v[0]])
    legs = [(i, ("ferry", "tss", "irregular")[i % 3], *map(float, rng.uniform(-0.02, 0.22, 4))) for i in range(24)]
    legs += [(100, "ferry", *rings[0][0], 0.2, 0.2), (101, "ferry", 0.1, 0.1, 0.1, 0.1), (102, "tss", 0.05, 0.0, 0.05, 0.2)]
    return rings, legs


def test_equals_the_plain_planner(spark):
    rings, legs = _world()
    out = {r["route_id"]: r for r in wayfinding.plan(spark.createDataFrame(legs, LEGS), _zones(spark, rings), 0.005, 1.0).collect()}
    for i, kind, a, b, c, d in legs:
        line, ok = planner.plan((a, b), (c, d), rings, kind, 0.005)
        got = out[str(i)]
        assert got["route_valid"] == ok
        assert got["length"] == pytest.approx(sum(math.dist(p, q) for p, q in zip(line, line[1:])), abs=1e-12)


def test_rounds_do_not_grow_with_routes(spark, monkeypatch):
    zones = _zones(spark, [BOX(0.04, 0.04, 0.06, 0.06)])
    nodes = wayfinding.staged(wayfinding.corners(zones, 0.005))
    edges = wayfinding.staged(wayfinding.visibility(nodes, zones, 0.005, 1.0))
    plain, sizes = wayfinding.staged, []

    def staged(df):
        out = plain(df)
        if "new" in out.columns:
            sizes[-1] = max(sizes[-1], out.count())
        return out

    monkeypatch.setattr(wayfinding, "staged", staged)
    for n in (1, 12):
        sizes.append(0)
        legs = spark.createDataFrame([(i, 0.0, 0.05, 0.1, 0.05) for i in range(n)], "route_id long, slon double, slat double, elon double, elat double")
        got = wayfinding.shortest(legs, nodes, edges, zones, 0.005, 1.0).collect()
        assert len(got) == n and len({(r["length"], tuple(r["path"])) for r in got}) == 1
    assert sizes[0] == sizes[1] > 0


def test_one_file_of_legs_is_many_tasks(spark):
    legs = spark.createDataFrame([(i, 0.0, 0.05, 0.1, 0.05) for i in range(40)], "route_id long, slon double, slat double, elon double, elat double").coalesce(1)
    assert wayfinding.spread(legs, "route_id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_sights_equal_every_leg_tested(spark, monkeypatch):
    monkeypatch.setattr(wayfinding, "PART", 7)  # tiles of several parts
    rings, _ = _world(7)
    zones, places = planner.Zones(rings, 0.004), np.random.default_rng(8).uniform(-0.05, 0.25, (60, 2))
    places[:20] = places[20] + 1e-3 * places[:20]
    outside = [(i, *map(float, p)) for i, p in enumerate(places) if not zones.inside(p)]
    spots = [(1000 + i, *map(float, p)) for i, p in enumerate(planner.Zones(rings, 0.005).nodes())]
    outside.append((60, *spots[0][1:]))  # at a node
    for reach in (0.03, 0.1, 1.0):
        got = wayfinding.sights(spark.createDataFrame(outside, "id long, lon double, lat double"), spark.createDataFrame(spots, "node long, lon double, lat double"), _zones(spark, rings), 0.004, reach).collect()
        want = {(i, n): math.dist(p, q) for i, *p in outside for n, *q in spots if math.dist(p, q) <= reach and zones.clear(p, q)}
        assert len(got) == len(want) > 0
        assert all(r["far"] == pytest.approx(want[r["id"], r["node"]], abs=1e-12) for r in got)


def test_legs_to_nodes_are_not_walked_one_by_one(spark, monkeypatch):
    zones = _zones(spark, [BOX(0.04, 0.04, 0.06, 0.06)])
    nodes = wayfinding.staged(wayfinding.corners(zones, 0.005))
    edges = wayfinding.visibility(nodes, zones, 0.005, 1.0)
    plain, walked = wayfinding.walk, []

    def walk(segments, *args):
        walked[-1] += segments.count()
        return plain(segments, *args)

    monkeypatch.setattr(wayfinding, "walk", walk)
    for n in (1, 60):
        walked.append(0)
        legs = spark.createDataFrame([(i, 0.0, 0.05, 0.1, 0.05) for i in range(n)], "route_id long, slon double, slat double, elon double, elat double")
        assert wayfinding.shortest(legs, nodes, edges, zones, 0.005, 1.0).count() == n
    assert walked[0] == walked[1]


def test_blocked_walks_every_cell(spark):
    rings, legs = _world(5)
    zones = planner.Zones(rings, 0.004)
    want = {i for i, _, a, b, c, d in legs if not zones.clear((a, b), (c, d))}
    for scale in (1, 40):  # legs of several cells too
        far = [(i, k, *(scale * v for v in p)) for i, k, *p in legs]
        big = [[(scale * x, scale * y) for x, y in r] for r in rings]
        got = wayfinding.blocked(spark.createDataFrame(far, LEGS), _zones(spark, big), ["route_id"], 0.004 * scale)
        assert {r["route_id"] for r in got.collect()} == want


def test_snap_reaches_far_rings(spark, monkeypatch):
    rings, tried = [BOX(0, 0, 0.1, 0.1), BOX(1, 1, 2, 2)], []
    places = [(0, 0.05, 0.048), (1, 0.003, 0.05), (2, 1.5, 1.5), (3, 0.5, 0.5)]  # far in, at a side, too far in, outside
    plain = wayfinding._first_free
    monkeypatch.setattr(wayfinding, "_first_free", lambda tries, *rest: tried.append(tries.count()) or plain(tries, *rest))
    got = {r["id"]: (r["lon"], r["lat"]) for r in wayfinding.snap(spark.createDataFrame(places, "id long, lon double, lat double"), _zones(spark, rings), ["id"], 0.005).collect()}
    for i, *p in places:
        assert got[i] == pytest.approx(planner.snap(tuple(p), planner.Zones(rings, 0.005)), abs=1e-12)
    assert tried == [3 * 8 * wayfinding.FIRST_RINGS, 2 * 8 * (wayfinding.RINGS - wayfinding.FIRST_RINGS)]


def test_collision_free(spark):
    rings, legs = _world(6)
    zones = planner.Zones(rings, 0.003)
    out = {r["route_id"]: r for r in wayfinding.collision_free(spark.createDataFrame(legs, LEGS), _zones(spark, rings), 0.003).collect()}
    assert out.keys() == {leg[0] for leg in legs} and {r["rule"] for r in out.values()} >= {"straight", "side"}
    for i, _, a, b, c, d in legs:
        r = out[i]
        line = [(p["lon"], p["lat"]) for p in r["line"]]
        assert np.allclose(line[0], (a, b)) and np.allclose(line[-1], (c, d))
        free = all(zones.clear(p, q) for p, q in zip(line, line[1:]))
        assert r["clear"] == free and (r["rule"] == "straight") == zones.clear((a, b), (c, d))


def test_empty(spark):
    none = spark.createDataFrame([], LEGS)
    assert wayfinding.plan(none, _zones(spark, [BOX(0, 0, 1, 1)]), 0.01, 1.0).count() == 0
    assert wayfinding.blocked(none, _zones(spark, []), ["route_id"], 0.01).count() == 0
