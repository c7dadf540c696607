"""Queries of generators, files and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartosea.functions import noise
from cartosea.operators import geometry as g
from cartosea.operators import wayfinding
from cartosea.sources import fleets, geojson
from cartosea.sources import tables as t

r6 = lambda c: F.round(c, 6)


def _keys(spark, sf, table, key):
    return t.read(spark, sf, table).select(F.col(key).cast("bigint").alias("key"))


def vessels(spark, sf):
    """A vessel for each customer."""
    v = fleets.vessels(_keys(spark, sf, "customer", "c_custkey"))
    return v.withColumns({"lon": r6("lon"), "lat": r6("lat")})


def sea_lanes(spark, sf):
    """Points of a lane for each nation."""
    rows = _keys(spark, sf, "nation", "n_nationkey")
    return fleets.lanes(rows, rows.count()).select("id", "direction", F.posexplode("line").alias("i", "p")).select("id", "direction", "i", r6("p.lon").alias("lon"), r6("p.lat").alias("lat"))


def coastal_assets(spark, sf):
    """An asset for each supplier."""
    return fleets.assets(_keys(spark, sf, "supplier", "s_suppkey")).withColumns({"lon": r6("lon"), "lat": r6("lat")})


def generated_routes(spark, sf):
    """Points of the routes of each supplier, with those where an irregular one stops."""
    r = fleets.routes(_keys(spark, sf, "supplier", "s_suppkey"))
    return r.select("id", "type", "name", "stops", F.posexplode("line").alias("seq", "p")).select("id", "type", "name", "seq", r6("p.lon").alias("lon"), r6("p.lat").alias("lat"), F.array_contains("stops", F.col("seq")).alias("stop"))


def star_zones(spark, sf):
    """Vertices of a zone for each supplier, before smoothing and clipping."""
    z = fleets.stars(_keys(spark, sf, "supplier", "s_suppkey"))
    return z.select("zone_id", "zone_type", "restriction", r6("smooth").alias("smooth"), F.posexplode("ring").alias("i", "v")).select("zone_id", "zone_type", "restriction", "smooth", "i", r6("v.lon").alias("lon"), r6("v.lat").alias("lat"))


def generated_zones(spark, sf):
    """Area and box of those zones, smoothed and cut at the box."""
    z = g.bounds(fleets.zones(_keys(spark, sf, "supplier", "s_suppkey")))
    return z.select("zone_id", "zone_type", "restriction", F.size("ring").alias("vertices"), F.round(g.area(F.col("ring")), 8).alias("area"), *[r6(c).alias(c) for c in ("min_lon", "max_lon", "min_lat", "max_lat")])


def smoothed_zones(spark, sf):
    """Zones with corners rounded by 0.0015 degrees: vertices, and areas before and after."""
    z = t.zones(spark, sf).withColumn("before", g.area(F.col("ring")))
    return g.smooth_rings(z, F.lit(0.0015)).select("zone_id", (F.size("ring") - 1).alias("vertices"), F.round("before", 9).alias("before"), F.round(g.area(F.col("ring")), 9).alias("area"))


def ring_validity(spark, sf):
    """Faults of rings whose second and third vertices are swapped in every other zone, which crosses edges."""
    v = lambda i: F.element_at("ring", i)
    swapped = F.array(v(1), v(3), v(2), *[v(i) for i in range(4, 8)])
    z = t.zones(spark, sf)
    return g.ring_faults(z.withColumn("ring", F.when(F.col("zone_id") % 2 == 0, swapped).otherwise(F.col("ring"))))


def obstacles(spark, sf):
    """Users' and generated zones together, and whether their rings are closed."""
    made = fleets.stars(_keys(spark, sf, "supplier", "s_suppkey"))
    return geojson.obstacles(t.zones(spark, sf), made).select("zone_id", "source", (F.element_at("ring", 1) == F.element_at("ring", -1)).alias("closed"))


def zone_features(spark, sf):
    """The zones as GeoJSON, read as JSON again."""
    f = geojson.features(t.zones(spark, sf), "Polygon", "ring", ["zone_id", "zone_type"])
    return f.select(F.get_json_object("feature", "$.properties.zone_id").cast("int").alias("zone_id"), F.get_json_object("feature", "$.properties.zone_type").alias("zone_type"), F.get_json_object("feature", "$.geometry.type").alias("kind"), r6(F.get_json_object("feature", "$.geometry.coordinates[0][0][0]").cast("double")).alias("lon"))


def _routes(spark, sf):
    kind = F.when(F.col("route_id") % 3 == 0, "ferry").when(F.col("route_id") % 3 == 1, "tss").otherwise("irregular")
    return t.legs(spark, sf).withColumn("type", kind)


def planned_routes(spark, sf):
    """Routes of all suppliers around all zones."""
    zones = t.zones(spark, sf)
    out = wayfinding.route_properties(wayfinding.plan(_routes(spark, sf), zones, wayfinding.buffer_of(zones), 0.4))
    return out.select("route_id", "type", "vessel_type", "suspicious", "waypoints", "route_valid", "warning", r6("length").alias("length"))


def feature_counts(spark, sf):
    """Features of each type."""
    return _routes(spark, sf).groupBy("type").agg(F.count("*").alias("features"))


QUERIES = {f.__name__: f for f in (vessels, sea_lanes, coastal_assets, generated_routes, star_zones, generated_zones, smoothed_zones, ring_validity, obstacles, zone_features, planned_routes, feature_counts)}
_N = "(SELECT count(*) FROM nation)"
_r = lambda v, n=6: f"(round({v}, {n}) + 0e0)"
_u = lambda n, seed: noise.hash_sql("key", str(n), seed)
_ix = lambda u, n: f"CAST(floor({u}*({n}*{fleets.BELOW}e0)) AS INT)"
_pick = lambda u, names: f"(CASE {_ix(u, len(names))} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(names)) + " END)"
_NAME = "chr(CAST(65+key%26 AS INT))||CAST(key+1 AS VARCHAR)"
_title = lambda c: f"array_to_string(list_transform(string_split(replace({c},'_',' '),' '), lambda w: upper(w[1])||w[2:]),' ')"


def _vessels_sql():
    u = lambda n: _u(n, 42)
    low, high = (" ".join(f"WHEN '{k}' THEN {v[i]}e0" for k, v in fleets.SPEEDS.items()) for i in (0, 1))
    return f"""WITH k AS (SELECT CAST(c_custkey AS BIGINT) AS key FROM customer), q AS (SELECT key, {_pick(u(3), fleets.VESSELS)} AS type, {u(1)} AS a, {u(2)} AS b, {u(4)} AS c, {u(5)} AS d, {u(6)} AS e FROM k)
SELECT 'vessel_'||lpad(CAST(key+1 AS VARCHAR), CAST(greatest(3, length(CAST(key+1 AS VARCHAR))) AS INT), '0') AS id, {_title('type')}||' '||{_NAME} AS name, type, {_r('-122.5e0+2e-1*a')} AS lon, {_r('37.5e0+2e-1*b')} AS lat,
round((CASE type {low} END)+((CASE type {high} END)-(CASE type {low} END))*c, 1) AS speed_knots, round(36e1*d, 1) AS heading, CAST(200000000+key AS VARCHAR) AS mmsi, 50+{_ix('e', 251)} AS length_m FROM q"""


def _assets_sql():
    u = lambda n: _u(n, 2042)
    of = lambda kind, v: f"CASE WHEN type='{kind}' THEN {v} END"
    return f"""WITH k AS (SELECT CAST(s_suppkey AS BIGINT) AS key FROM supplier), q AS (SELECT key, CASE WHEN {u(1)}<6e-1 THEN {_pick(u(2), fleets.EDGES)} END AS edge, 5e-2*{u(3)} AS off, {_pick(u(5), fleets.ASSETS)} AS type, {u(4)} AS a, {u(8)} AS b, {u(6)} AS c, {u(7)} AS d FROM k)
SELECT type||'_'||lpad(CAST(key+1 AS VARCHAR), CAST(greatest(3, length(CAST(key+1 AS VARCHAR))) AS INT), '0') AS id, {_title('type')}||' '||{_NAME} AS name, type, {_r("CASE edge WHEN 'east' THEN -122.3e0-off WHEN 'west' THEN -122.5e0+off ELSE -122.5e0+2e-1*a END")} AS lon, {_r("CASE edge WHEN 'north' THEN 37.7e0-off WHEN 'south' THEN 37.5e0+off ELSE 37.5e0+2e-1*b END")} AS lat,
{of('port', f"2+{_ix('c', 19)}")} AS berths, {of('port', f"8+{_ix('d', 11)}")} AS max_draft_m, {of('lighthouse', f"10+{_ix('c', 21)}")} AS range_nm, {of('lighthouse', f"15+{_ix('d', 46)}")} AS height_m, {of('buoy', _pick('c', fleets.BUOYS))} AS buoy_type, {of('buoy', 'd<5e-1')} AS light FROM q"""


def _routes_sql():
    u = lambda n: _u(n, 3042)
    draws = ", ".join(f"{u(n)} AS u{n}" for n in (*range(10, 19), 30, 31))
    base = f"WITH k AS (SELECT CAST(s_suppkey AS BIGINT) AS key FROM supplier), b AS (SELECT key, -122.5e0+2e-1*{u(1)} AS sx, 37.5e0+2e-1*{u(2)} AS sy, -122.5e0+2e-1*{u(3)} AS ex, 37.5e0+2e-1*{u(4)} AS ey, 8+{_ix(u(5), 7)} AS n, {draws} FROM k), l AS (SELECT *, sqrt(pow(ex-sx,2)+pow(ey-sy,2)) AS len FROM b)"
    lon, lat = "sx+(ex-sx)*(CAST(i AS DOUBLE)/n)-(ey-sy)/len*(2e-2*sin(CAST(i AS DOUBLE)/n*pi())+off)", "sy+(ey-sy)*(CAST(i AS DOUBLE)/n)+(ex-sx)/len*(2e-2*sin(CAST(i AS DOUBLE)/n*pi())+off)"
    half = "(2e0/111e0+2e0/(111e0*cos(radians(37.6e0))))/2e0/2e0"
    lines = f"ln AS (SELECT l.*, unnest(CASE WHEN key%3=1 THEN [0,1] ELSE [0] END) AS j FROM l), pt AS (SELECT *, CASE WHEN key%3<>1 THEN 0e0 WHEN j=0 THEN {half} ELSE -({half}) END AS off, unnest(range(0, n+1)) AS i FROM ln), pp AS (SELECT *, CAST(i AS DOUBLE) AS s, {lon} AS lon, {lat} AS lat FROM pt)"
    bends = " UNION ALL ".join(f"SELECT key, i+{j + 1}/1e1, least(greatest(lon+(5e-2+1e-1*u{11 + 3 * j})*cos(2*pi()*u{12 + 3 * j}),-122.5e0),-122.3e0), least(greatest(lat+(5e-2+1e-1*u{11 + 3 * j})*sin(2*pi()*u{12 + 3 * j}),37.5e0),37.7e0) FROM pp WHERE key%3=2 AND i=CAST(floor((2e-1+6e-1*u{10 + 3 * j})*n) AS INT)" for j in range(3))
    every = f"al AS (SELECT key, j, s, lon, lat FROM pp UNION ALL SELECT key, 0, * EXCLUDE (key) FROM ({bends}) z(key, s, lon, lat)), sq AS (SELECT *, CAST(row_number() OVER (PARTITION BY key, j ORDER BY s)-1 AS INT) AS seq FROM al)"
    return f"""{base}, {lines}, {every} SELECT 'route_'||sq.key||(CASE WHEN sq.key%3=1 THEN '_lane_'||j ELSE '' END) AS id, CASE sq.key%3 WHEN 0 THEN 'ferry' WHEN 1 THEN 'tss' ELSE 'irregular' END AS type, CASE sq.key%3 WHEN 0 THEN 'Ferry route '||(sq.key+1) WHEN 1 THEN 'TSS route '||(sq.key+1)||' lane '||(j+1) ELSE 'Irregular route '||(sq.key+1) END AS name, seq, {_r('sq.lon')} AS lon, {_r('sq.lat')} AS lat, sq.key%3=2 AND (seq=floor((1e-1+8e-1*u30)*(n+3)) OR seq=floor((1e-1+8e-1*u31)*(n+3))) AS stop FROM sq JOIN l ON l.key=sq.key"""


def _stars_sql():
    u = lambda n: _u(n, 42)
    case = lambda f: "(CASE zone_type " + " ".join(f"WHEN '{k}' THEN {f(v)}" for k, v in fleets.ZONES.items()) + " END)"
    lit = lambda v: f"{float(v)!r}e0"
    kinds = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(fleets.KINDS))
    n0, n1, i0, i1 = (f"(CASE WHEN bx THEN {lit(fleets.BOXY[a][b])} ELSE {case(lambda v: lit(v[1 + a][b]))} END)" for a in (0, 1) for b in (0, 1))
    r0, r1 = case(lambda v: lit(v[0][0])), case(lambda v: lit(v[0][1]))
    shape = f"WITH k AS (SELECT CAST(s_suppkey AS BIGINT) AS key FROM supplier), a AS (SELECT key, CASE key%3 {kinds} END AS zone_type, -122.5e0+2e-1*{u(1)} AS cx, 37.5e0+2e-1*{u(2)} AS cy, {u(3)} AS u3, {u(4)} AS u4, {u(5)} AS u5, {u(6)} AS u6 FROM k), b AS (SELECT *, zone_type='windfarm' AND u4>=5e-1 AS bx FROM a), c AS (SELECT *, {r0}+({r1}-{r0})*u3 AS km, CAST({n0} AS INT)+{_ix('u5', f'({n1}-{n0}+1)')} AS n, {i0}+({i1}-{i0})*u6 AS irr FROM b), d AS (SELECT *, (km/111e0+km/(111e0*cos(radians(cy))))/2e0 AS rad FROM c)"
    at = f"e AS (SELECT *, unnest(range(0, n+1)) AS i FROM d), f AS (SELECT *, i%n AS m FROM e), g AS (SELECT *, 2*pi()*m/n+irr*(2e0*{noise.hash_sql('key', '(100+2*m)', 42)}-1e0) AS an, rad*(1e0+irr*5e-1*(2e0*{noise.hash_sql('key', '(101+2*m)', 42)}-1e0)) AS r FROM f)"
    return f"{shape}, {at} SELECT key AS zone_id, zone_type, {case(lambda v: repr(v[4]))} AS restriction, {_r(f'rad*{case(lambda v: lit(v[3]))}')} AS smooth, CAST(i AS INT) AS i, {_r('cx+r*cos(an)/cos(radians(cy))')} AS lon, {_r('cy+r*sin(an)')} AS lat FROM g"


def _smooth_sql():
    win = "OVER (PARTITION BY zone_id ORDER BY i)"
    near = f"e AS (SELECT zone_id, i, bx-ax AS x, by_-ay AS y, sqrt(pow(bx-ax,2)+pow(by_-ay,2)) AS d, ax AS lon, ay AS lat FROM edges), c AS (SELECT zone_id, i, lon, lat, coalesce(lag(x) {win}, last_value(x) OVER w) AS px, coalesce(lag(y) {win}, last_value(y) OVER w) AS py, coalesce(lag(d) {win}, last_value(d) OVER w) AS pd, x, y, d FROM e WINDOW w AS (PARTITION BY zone_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), o AS (SELECT zone_id, sign(sum(ax*by_-bx*ay)) AS way, abs(sum(ax*by_-bx*ay))/2e0 AS before FROM edges GROUP BY 1)"
    bend = "b AS (SELECT c.*, way, before, atan2((px*y-py*x)*way, px*x+py*y) AS turn FROM c JOIN o ON o.zone_id=c.zone_id), t AS (SELECT *, least(15e-4*tan(turn/2), least(pd,d)/2) AS t FROM b), r AS (SELECT *, t/tan(turn/2) AS r, lon-px/pd*t AS sx, lat-py/pd*t AS sy FROM t), n AS (SELECT *, -py/pd*way*r AS nx, px/pd*way*r AS ny FROM r)"
    arc = "a AS (SELECT zone_id, before, i, k, sx+nx-nx*cos(way*turn*k/8e0)+ny*sin(way*turn*k/8e0) AS lon, sy+ny-nx*sin(way*turn*k/8e0)-ny*cos(way*turn*k/8e0) AS lat FROM n, (SELECT range AS k FROM range(9)) WHERE turn>1e-9 UNION ALL SELECT zone_id, before, i, 0, lon, lat FROM n WHERE turn<=1e-9), f AS (SELECT *, coalesce(lead(lon) OVER q, first_value(lon) OVER q) AS qx, coalesce(lead(lat) OVER q, first_value(lat) OVER q) AS qy FROM a WINDOW q AS (PARTITION BY zone_id ORDER BY i, k))"
    return f"{t.ctes('edges')}, {near}, {bend}, {arc} SELECT zone_id, CAST(count(*) AS INT) AS vertices, {_r('max(before)', 9)} AS before, {_r('abs(sum(lon*qy-qx*lat))/2e0', 9)} AS area FROM f GROUP BY 1"


def _faults_sql():
    x = lambda a, b, c, d, e, f: f"(({c}-{a})*({f}-{b})-({d}-{b})*({e}-{a}))"
    hit = " AND ".join(f"{x(*p, *q, *r)}*{x(*p, *q, *s)}<=0" for p, q, r, s in ((("p.ax", "p.ay"), ("p.bx", "p.by_"), ("q.ax", "q.ay"), ("q.bx", "q.by_")), (("q.ax", "q.ay"), ("q.bx", "q.by_"), ("p.ax", "p.ay"), ("p.bx", "p.by_"))))
    swap = "CASE WHEN zone_id%2=0 AND i=1 THEN 2 WHEN zone_id%2=0 AND i=2 THEN 1 ELSE i END"
    return f"{t.ctes('verts')}, s AS (SELECT zone_id, {swap} AS i, lon, lat FROM verts), e AS (SELECT a.zone_id, a.i, a.lon AS ax, a.lat AS ay, b.lon AS bx, b.lat AS by_ FROM s a JOIN s b ON b.zone_id=a.zone_id AND b.i=a.i+1), c AS (SELECT p.zone_id, count(*) AS n FROM e p JOIN e q ON q.zone_id=p.zone_id AND q.i>p.i+1 AND NOT (p.i=0 AND q.i=5) WHERE {hit} GROUP BY 1) SELECT z.zone_id, TRUE AS closed, 6 AS vertices, coalesce(n,0) AS crossings, coalesce(n,0)=0 AS valid FROM zone0 z LEFT JOIN c ON c.zone_id=z.zone_id"


SQL = {
    "vessels": _vessels_sql(),
    "coastal_assets": _assets_sql(),
    "generated_routes": _routes_sql(),
    "star_zones": _stars_sql(),
    "smoothed_zones": _smooth_sql(),
    "ring_validity": _faults_sql(),
    "obstacles": "SELECT CAST(n_nationkey AS BIGINT) AS zone_id, 'user' AS source, TRUE AS closed FROM nation UNION ALL SELECT s_suppkey+(SELECT max(n_nationkey)+1 FROM nation), 'procedural', TRUE FROM supplier",
    "sea_lanes": f"WITH l AS (SELECT n_nationkey AS i, n_nationkey/CAST({_N} AS DOUBLE) AS f FROM nation), p(j,d,s) AS (VALUES (0,0e0,0e0),(1,1e-2,3e-1),(2,-1e-2,7e-1),(3,0e0,1e0)) SELECT 'lane_'||lpad(CAST(i+1 AS VARCHAR),3,'0') AS id, CASE i%4 WHEN 0 THEN 'northbound' WHEN 1 THEN 'eastbound' WHEN 2 THEN 'southbound' ELSE 'westbound' END AS direction, j AS i, (round(CASE WHEN i%2=0 THEN -122.5e0+f*2e-1+d ELSE -122.5e0+2e-1*s END,6)+0e0) AS lon, (round(CASE WHEN i%2=0 THEN 37.5e0+2e-1*s ELSE 37.5e0+f*2e-1+d END,6)+0e0) AS lat FROM l, p",
    "zone_features": f"{t.ctes('verts')} SELECT zone_id, zone_type, 'Polygon' AS kind, (round(lon,6)+0e0) AS lon FROM verts WHERE i=0",
    "feature_counts": "SELECT CASE s_suppkey%3 WHEN 0 THEN 'ferry' WHEN 1 THEN 'tss' ELSE 'irregular' END AS type, count(*) AS features FROM supplier GROUP BY 1",
}
