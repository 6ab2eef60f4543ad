"""SQL of the catalog's queries for an independent engine: name -> one statement over the same tables."""

from __future__ import annotations

from wayfold.sources.fixtures import RINGS

D = "CAST({} AS DOUBLE)".format


def hav(a: str, b: str, c: str, d: str) -> str:
    return f"2*{D('6371008.8')}*asin(least(1.0::DOUBLE,sqrt(pow(sin((radians({d})-radians({b}))/2),2)+cos(radians({b}))*cos(radians({d}))*pow(sin((radians({c})-radians({a}))/2),2))))"


def brg(a: str, b: str, c: str, d: str) -> str:
    x = f"degrees(atan2(sin(radians({c}-{a}))*cos(radians({d})), cos(radians({b}))*sin(radians({d}))-sin(radians({b}))*cos(radians({d}))*cos(radians({c}-{a}))))"
    return f"(CASE WHEN {x}<0 THEN {x}+360 ELSE {x} END)"


def delta(a: str, b: str) -> str:
    return f"least(abs({a}-{b})%360, 360-abs({a}-{b})%360)"


def shift(x: str, y: str) -> tuple[str, str]:
    """Offsets in degrees of a place (lng, lat), by the published series."""
    u, v = f"({x}-105.0::DOUBLE)", f"({y}-35.0::DOUBLE)"
    wave = lambda t, parts: "+".join(f"sin({t}*pi()*{D(k)})*{D(a)}*2.0/3.0" for a, k in parts)
    lat = f"(-100.0::DOUBLE+2.0*{u}+3.0*{v}+0.2::DOUBLE*{v}*{v}+0.1::DOUBLE*{u}*{v}+0.2::DOUBLE*sqrt(abs({u}))+{wave(u, [(20.0, 6.0), (20.0, 2.0)])}+{wave(v, [(20.0, 1.0), (40.0, 1 / 3), (160.0, 1 / 12), (320.0, 1 / 30)])})"
    lng = f"(300.0::DOUBLE+{u}+2.0*{v}+0.1::DOUBLE*{u}*{u}+0.1::DOUBLE*{u}*{v}+0.1::DOUBLE*sqrt(abs({u}))+{wave(u, [(20.0, 6.0), (20.0, 2.0), (20.0, 1.0), (40.0, 1 / 3), (150.0, 1 / 12), (300.0, 1 / 30)])})"
    e, a = D("0.00669342162296594323"), D("6378245.0")
    m = f"(1-{e}*sin(radians({y}))*sin(radians({y})))"
    return f"({lng}*180.0/({a}/sqrt({m})*cos(radians({y}))*pi()))", f"({lat}*180.0/({a}*(1-{e})/({m}*sqrt({m}))*pi()))"


def seg(p: str, q: str, a: str, b: str, c: str, d: str) -> str:
    """Metres from (p, q) to the segment (a, b)-(c, d), equirectangular around the point."""
    k = f"(radians(1.0)*{D('6371008.8')})"
    ax, ay, bx, y2 = f"(({a}-{p})*{k}*cos(radians({q})))", f"(({b}-{q})*{k})", f"(({c}-{p})*{k}*cos(radians({q})))", f"(({d}-{q})*{k})"
    sq = f"(({bx}-{ax})*({bx}-{ax})+({y2}-{ay})*({y2}-{ay}))"
    t = f"(CASE WHEN {sq}=0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE,least(1.0::DOUBLE,((0.0::DOUBLE-{ax})*({bx}-{ax})+(0.0::DOUBLE-{ay})*({y2}-{ay}))/{sq})) END)"
    return f"sqrt(pow({ax}+{t}*({bx}-{ax}),2)+pow({ay}+{t}*({y2}-{ay}),2))"


_SEGMENTS = ",".join(f"({r},{i},{D(a[0])},{D(a[1])},{D(b[0])},{D(b[1])})" for r, ring in enumerate(RINGS) for i, (a, b) in enumerate(zip(ring, ring[1:], strict=False)))
BASE = f"""WITH RECURSIVE nodes AS (SELECT p_partkey AS node, p_partkey%40 AS gx, p_partkey//40 AS gy, 116.0::DOUBLE+(p_partkey%40)*0.01::DOUBLE AS lng, 39.6::DOUBLE+(p_partkey//40)*0.01::DOUBLE AS lat FROM part),
edges AS (SELECT e.edge_id, e.u, e.v, a.lng AS ulng, a.lat AS ulat, b.lng AS vlng, b.lat AS vlat, 500000+(e.edge_id*7919%1000)*1000 AS len_mm, CASE WHEN e.edge_id%13=0 THEN 'motorway' WHEN e.edge_id%7=0 THEN 'motorway_link' WHEN e.edge_id%3=0 THEN 'primary' ELSE 'residential' END AS road_class, e.edge_id%7=0 AS is_link, e.edge_id%17<>4 AS car_access, a.gx, a.gy
 FROM (SELECT 2*node AS edge_id, node AS u, node+1 AS v FROM nodes WHERE gx<39 UNION ALL SELECT 2*node+1, node, node+40 FROM nodes) e JOIN nodes a ON a.node=e.u JOIN nodes b ON b.node=e.v),
ekeys AS (SELECT 2*edge_id AS key, edge_id, u AS from_node, v AS to_node, len_mm FROM edges WHERE car_access UNION ALL SELECT 2*edge_id+1, edge_id, v, u, len_mm FROM edges WHERE car_access AND edge_id%5<>0),
turns AS (SELECT DISTINCT a.edge_id AS from_edge, a.to_node AS via_node, b.edge_id AS to_edge FROM ekeys a JOIN ekeys b ON b.from_node=a.to_node WHERE a.edge_id=b.edge_id OR (a.edge_id*31+b.edge_id)%17=0),
pts AS (SELECT c_custkey AS point_id, 116.0::DOUBLE+(c_custkey*37%1000)*0.0004::DOUBLE AS lng, 39.6::DOUBLE+(c_custkey*91%1000)*0.0005::DOUBLE AS lat FROM customer),
cls AS (SELECT *, CASE WHEN gx BETWEEN 5 AND 19 AND gy BETWEEN 5 AND 29 THEN 'INNER' WHEN gx<30 THEN 'SECOND' ELSE 'OUTSIDE' END AS zone, road_class='motorway' AND car_access AS mainline, road_class='motorway' AND car_access AND NOT (gx BETWEEN 5 AND 19 AND gy BETWEEN 5 AND 29) AS exempt, road_class='motorway' AND car_access AND gx BETWEEN 5 AND 19 AND gy BETWEEN 5 AND 29 AS forbidden FROM edges),
segs(ring,seq,ax,ay,bx,y2) AS (VALUES {_SEGMENTS}),
near AS (SELECT * FROM (SELECT p.point_id, e.edge_id, e.exempt, {seg("p.lng", "p.lat", "e.ulng", "e.ulat", "e.vlng", "e.vlat")} AS dist_m FROM pts p JOIN cls e ON e.car_access AND p.lng BETWEEN least(e.ulng,e.vlng)-0.001 AND greatest(e.ulng,e.vlng)+0.001 AND p.lat BETWEEN least(e.ulat,e.vlat)-0.001 AND greatest(e.ulat,e.vlat)+0.001) WHERE dist_m<=50),
blk AS (SELECT edge_id, count(*) AS n_points, min(dist_m) AS min_m FROM near WHERE NOT exempt GROUP BY 1),
raw AS (SELECT c_custkey AS i, CASE WHEN c_custkey%37=3 THEN '"junk"' ELSE '{{'||CASE WHEN c_custkey%23=0 THEN '' ELSE '"Id":"P'||CAST(c_custkey-CASE WHEN c_custkey%19=5 THEN 1 ELSE 0 END AS VARCHAR)||'",' END||CASE WHEN c_custkey%29=0 THEN '"Lng":200.5' WHEN c_custkey%41=0 THEN '"Lng":"abc"' ELSE '"Lng":116.'||lpad(CAST((c_custkey*37%1000)*4 AS VARCHAR),4,'0') END||',"Lat":"'||CAST((396000+(c_custkey*91%1000)*5)//10000 AS VARCHAR)||'.'||lpad(CAST((396000+(c_custkey*91%1000)*5)%10000 AS VARCHAR),4,'0')||'"'||CASE c_custkey%10 WHEN 0 THEN ',"IsSixRingOut":"1"' WHEN 1 THEN ',"IsSixRingOut":"0"' WHEN 2 THEN ',"IsSixRingOut":1' WHEN 3 THEN ',"IsSixRingOut":1.0' WHEN 4 THEN ',"IsSixRingOut":"x"' WHEN 5 THEN '' WHEN 6 THEN ',"IsSixRingOut":null' ELSE ',"IsSixRingOut":0' END||',"Address":"'||CASE WHEN c_custkey%43=0 THEN ' ' ELSE 'Road '||CAST(c_custkey%100 AS VARCHAR)||' [gate] ['||CASE WHEN c_custkey%2=0 THEN 'east' ELSE 'west' END||']' END||'"'||CASE WHEN c_custkey%31=0 THEN '' ELSE ',"CameraType":"fixed"' END||'}}' END AS j FROM customer),
rec AS (SELECT i, j LIKE '{{%' AS obj, coalesce(CAST(json_extract(j,'$.IsSixRingOut') AS VARCHAR) IN ('"1"','1','1.0'),false) AS gone, coalesce(CAST(json_extract(j,'$.IsSixRingOut') AS VARCHAR) IN ('"0"','0','0.0'),false) AS known, j->>'$.Id' AS id, TRY_CAST(j->>'$.Lng' AS DOUBLE) AS lng, TRY_CAST(j->>'$.Lat' AS DOUBLE) AS lat, j->>'$.Address' AS address, j->>'$.CameraType' AS kind FROM raw),
chk AS (SELECT *, CASE WHEN NOT obj THEN 'not an object' WHEN id IS NULL THEN 'missing id' WHEN i>first THEN 'duplicate id' WHEN lng IS NULL THEN 'bad lng' WHEN lat IS NULL THEN 'bad lat' WHEN lng NOT BETWEEN -180 AND 180 THEN 'out of range' WHEN trim(coalesce(address,''))='' THEN 'missing address' WHEN kind IS NULL THEN 'missing type' END AS reason FROM (SELECT *, min(i) OVER (PARTITION BY CASE WHEN obj AND id IS NOT NULL THEN id ELSE '#'||i END) AS first FROM rec WHERE NOT gone)),
tr AS (SELECT route_id, 2*s+half AS seq, CASE WHEN s%11=10 THEN -1 WHEN s%2=0 THEN 4*(y*40+x) ELSE 4*(y*40+x)+2 END AS edge_key, 116.0::DOUBLE+x*0.01::DOUBLE+half*0.004::DOUBLE AS lng, 39.6::DOUBLE+y*0.01::DOUBLE AS lat FROM (SELECT c_custkey AS route_id, s, c_custkey%8+(s+1)//2 AS x, c_custkey%5+s//2 AS y FROM customer, range(30) t(s)), range(2) h(half) WHERE x<40),
runs AS (SELECT route_id, run, edge_key, min(seq) AS first_seq, max(seq) AS last_seq, count(*) FILTER (NOT again) AS n_points FROM (SELECT *, coalesce(lng=lag(lng) OVER w AND lat=lag(lat) OVER w, false) AS again FROM (SELECT *, sum(new) OVER (PARTITION BY route_id ORDER BY seq) AS run FROM (SELECT *, CASE WHEN edge_key IS DISTINCT FROM lag(edge_key) OVER (PARTITION BY route_id ORDER BY seq) THEN 1 ELSE 0 END AS new FROM tr WHERE edge_key>=0)) WINDOW w AS (PARTITION BY route_id, run ORDER BY seq)) GROUP BY 1,2,3),
rp AS (SELECT r.request, s.stop, 2*r.request+s.stop AS place, CASE WHEN s.stop=0 THEN a.lng+0.0037::DOUBLE ELSE b.lng+0.0006::DOUBLE END AS lng, CASE WHEN s.stop=0 THEN a.lat+0.0006::DOUBLE ELSE b.lat+0.0062::DOUBLE END AS lat FROM (SELECT node, 2*node+v AS request, node+CASE v WHEN 0 THEN 125 ELSE 425 END AS other FROM nodes, range(2) t(v) WHERE node%50=0) r JOIN nodes a ON a.node=r.node JOIN nodes b ON b.node=r.other, range(2) s(stop)),
loc AS (SELECT kind, id, CASE WHEN b THEN 'BOUNDARY' WHEN n%2=1 THEN 'INSIDE' ELSE 'OUTSIDE' END AS location, m FROM (SELECT kind, id, bool_or(b) AS b, sum(CASE WHEN o THEN 1 ELSE 0 END) AS n, arg_min(m, (d, m)) AS m FROM (SELECT kind, id, b, o, pow(lng-nx,2)+pow(lat-ny,2) AS d, {hav("lng", "lat", "nx", "ny")} AS m FROM (SELECT *, ax+(bx-ax)*t AS nx, ay+(y2-ay)*t AS ny FROM (SELECT q.*, s.ax, s.ay, s.bx, s.y2, abs((bx-ax)*(lat-ay)-(y2-ay)*(lng-ax))<=1e-12 AND lng BETWEEN least(ax,bx) AND greatest(ax,bx) AND lat BETWEEN least(ay,y2) AND greatest(ay,y2) AS b, y2<>ay AND ((ay>lat)<>(y2>lat)) AND lng<(bx-ax)*(lat-ay)/(CASE WHEN y2=ay THEN 1 ELSE y2-ay END)+ax AS o, greatest(0.0::DOUBLE,least(1.0::DOUBLE,((lng-ax)*(bx-ax)+(lat-ay)*(y2-ay))/((bx-ax)*(bx-ax)+(y2-ay)*(y2-ay)))) AS t FROM (SELECT 'p' AS kind, point_id AS id, lng, lat FROM pts UNION ALL SELECT 'n', node, lng, lat FROM nodes UNION ALL SELECT 'r', place, lng, lat FROM rp) q, segs s))) GROUP BY 1,2)),
portal AS (SELECT edge_id, 2*edge_id AS key, 'P-'||edge_id||'-'||CAST(round(fraction*1e9) AS BIGINT) AS portal_id, fraction, ulng+(vlng-ulng)*fraction AS lng, ulat+(vlat-ulat)*fraction AS lat, ring, road_class, is_link, CASE WHEN l.location='INSIDE' THEN 'OUT' ELSE 'IN' END AS direction FROM (SELECT *, ((ax-ulng)*(y2-ay)-(ay-ulat)*(bx-ax))/det AS fraction, ((ax-ulng)*(vlat-ulat)-(ay-ulat)*(vlng-ulng))/det AS s FROM (SELECT e.*, g.*, (vlng-ulng)*(y2-ay)-(vlat-ulat)*(bx-ax) AS det FROM edges e, segs g) WHERE det<>0) x JOIN loc l ON l.kind='n' AND l.id=x.u WHERE fraction>=0 AND fraction<=1 AND s>=0 AND s<1),
adj AS (SELECT a.key, b.key AS next_key, b.len_mm AS next_mm FROM ekeys a JOIN ekeys b ON b.from_node=a.to_node WHERE NOT EXISTS (SELECT 1 FROM turns t WHERE t.from_edge=a.edge_id AND t.via_node=a.to_node AND t.to_edge=b.edge_id)),
ladj AS (SELECT * FROM adj WHERE key//2 NOT IN (SELECT edge_id FROM blk) AND next_key//2 NOT IN (SELECT edge_id FROM blk)),
lcomp(node, reach) AS (SELECT u, u FROM edges WHERE is_link UNION SELECT v, v FROM edges WHERE is_link UNION SELECT c.node, CASE WHEN e.u=c.reach THEN e.v ELSE e.u END FROM lcomp c JOIN edges e ON e.is_link AND (e.u=c.reach OR e.v=c.reach)),
comp AS (SELECT node, min(reach) AS component FROM lcomp GROUP BY 1),
touch AS (SELECT c.component, count(DISTINCT m.edge_id) AS mainlines, bool_or(n.gx>=30) AS outside FROM comp c JOIN nodes n USING (node) LEFT JOIN (SELECT u AS node, edge_id FROM cls WHERE mainline UNION ALL SELECT v, edge_id FROM cls WHERE mainline) m USING (node) GROUP BY 1),
both_ways AS (SELECT u, v, len_mm FROM edges UNION ALL SELECT v, u, len_mm FROM edges),
walk(request, node, d) AS (SELECT node, node, 0::BIGINT FROM nodes WHERE node%50=0 OR node=42 UNION SELECT w.request, b.v, w.d+b.len_mm FROM walk w JOIN both_ways b ON b.u=w.node WHERE w.d+b.len_mm<=3000000),
reach AS (SELECT request, node, min(d) AS dist_mm FROM walk GROUP BY 1,2),
simple(start, path, d) AS (SELECT node, [node], 0::BIGINT FROM nodes WHERE node%50=0 UNION ALL SELECT s.start, list_append(s.path, b.v), s.d+b.len_mm FROM simple s JOIN both_ways b ON b.u=s.path[-1] WHERE NOT list_contains(s.path, b.v) AND s.d+b.len_mm<=3000000),
sp(request, key, dist_mm) USING KEY (request, key) AS (SELECT from_node, key, len_mm FROM ekeys WHERE from_node%50=0 UNION SELECT s.request, a.next_key, min(s.dist_mm+a.next_mm) FROM sp s JOIN adj a ON a.key=s.key LEFT JOIN recurring.sp r ON r.request=s.request AND r.key=a.next_key WHERE r.key IS NULL OR s.dist_mm+a.next_mm<r.dist_mm GROUP BY 1,2),
lsp(request, key, dist_mm) USING KEY (request, key) AS (SELECT from_node, key, len_mm FROM ekeys WHERE from_node%50=0 UNION SELECT s.request, a.next_key, min(s.dist_mm+a.next_mm) FROM lsp s JOIN ladj a ON a.key=s.key LEFT JOIN recurring.lsp r ON r.request=s.request AND r.key=a.next_key WHERE r.key IS NULL OR s.dist_mm+a.next_mm<r.dist_mm GROUP BY 1,2),
goals AS (SELECT p.request, t.portal_id AS target, min(CAST(p.dist_mm-k.len_mm+floor(k.len_mm*t.fraction) AS BIGINT)) AS dist_mm FROM lsp p JOIN portal t ON t.key=p.key AND t.direction='OUT' JOIN ekeys k ON k.key=p.key GROUP BY 1,2),
tiers AS (SELECT request, target, dist_mm, CAST(greatest(1, ceil((dist_mm-best)/1000000.0)) AS INTEGER) AS tier FROM (SELECT *, min(dist_mm) OVER (PARTITION BY request) AS best FROM goals) WHERE dist_mm<=best+5000000)
"""

_fx, _fy = shift("lng", "lat")
_points = "SELECT point_id, lng, lat FROM pts"
_inverse = f"""SELECT point_id, round(x,7) AS lng, round(y,7) AS lat, round(2*lng-(lng+({_fx})),7) AS once_lng, round(2*lat-(lat+({_fy})),7) AS once_lat FROM (SELECT a.*, b.x, b.y FROM pts a JOIN inv b USING (point_id) WHERE b.k=12)"""
_ix, _iy = shift("x", "y")

SQL = {
    "blocked_edges": "SELECT edge_id, n_points, round(min_m,4) AS min_m FROM blk",
    "match_counters": "SELECT count(*) AS points, count(*) FILTER (b) AS matched, count(*) FILTER (NOT b) AS exempt_only, count(*) FILTER (b IS NULL) AS unmatched FROM pts LEFT JOIN (SELECT point_id, bool_or(NOT exempt) AS b FROM near GROUP BY 1) USING (point_id)",
    "match_rate_gate": "SELECT round(m/n,9) AS match_rate, m/n>=0.1 AS rate_ok, n>=100 AS count_ok, round(abs(n-1400)/1400.0::DOUBLE,9) AS change FROM (SELECT count(DISTINCT point_id)::DOUBLE AS m, (SELECT count(*) FROM pts)::DOUBLE AS n FROM near)",
    "points_ingest_valid": "SELECT i AS record_index, id, round(lng,7) AS lng, round(lat,7) AS lat, address, kind, CASE WHEN i%2=0 THEN 'east' ELSE 'west' END AS direction FROM chk WHERE reason IS NULL",
    "points_ingest_issues": "SELECT i AS record_index, CASE WHEN obj THEN id END AS id, reason FROM chk WHERE reason IS NOT NULL",
    "points_ingest_metrics": "SELECT (SELECT count(*) FROM rec) AS source_count, (SELECT count(*) FROM rec WHERE gone) AS excluded_count, (SELECT count(*) FROM rec WHERE NOT gone) AS retained_count, (SELECT count(*) FROM rec WHERE NOT gone AND NOT known) AS unrecognized_count, (SELECT count(*) FROM chk WHERE reason IS NULL) AS valid_count, (SELECT count(*) FROM chk WHERE reason IS NOT NULL) AS issue_count",
    "haversine_pairs": f"SELECT edge_id, round({hav('ulng', 'ulat', 'vlng', 'vlat')},4) AS metres FROM edges",
    "bearing_deltas": f"SELECT point_id, round(b,6) AS bearing, round({delta('b', '350.0::DOUBLE')},6) AS delta FROM (SELECT point_id, {brg('lng', 'lat', '116.17::DOUBLE', '39.795::DOUBLE')} AS b FROM pts)",
    "crs_forward": f"SELECT point_id, round(lng+({_fx}),7) AS lng, round(lat+({_fy}),7) AS lat FROM pts",
    "crs_inverse": _inverse,
    "bbox_points": "SELECT box, point_id FROM pts JOIN (VALUES (1,116.05::DOUBLE,116.15::DOUBLE,39.65::DOUBLE,39.75::DOUBLE),(2,116.1::DOUBLE,116.3::DOUBLE,39.9::DOUBLE,40.0::DOUBLE)) b(box,a,c,d,e) ON lng BETWEEN a AND c AND lat BETWEEN d AND e",
    "bbox_limit_guard": "SELECT point_id, round(lng,7) AS lng, round(lat,7) AS lat FROM pts WHERE lng BETWEEN 116.0::DOUBLE AND 116.02::DOUBLE AND lat BETWEEN 39.6::DOUBLE AND 39.7::DOUBLE",
    "point_location": "SELECT id AS point_id, location, round(CASE WHEN location='OUTSIDE' THEN m ELSE 0 END,4) AS outside_m FROM loc WHERE kind='p'",
    "scope_filter": "SELECT id AS point_id FROM loc WHERE kind='p' AND (location<>'OUTSIDE' OR m<=500)",
    "points_within_radius": f"SELECT node, point_id, round(d,4) AS dist_m FROM (SELECT n.node, p.point_id, {hav('p.lng', 'p.lat', 'n.lng', 'n.lat')} AS d FROM pts p JOIN nodes n ON abs(p.lat-n.lat)<0.02) WHERE d<=2000",
    "nearest_edge": f"SELECT p.point_id, arg_min(e.edge_id,(round(d,6),e.edge_id)) AS edge_id, round(min(d),4) AS dist_m FROM pts p LEFT JOIN (SELECT * FROM (SELECT q.point_id, x.edge_id, {seg('q.lng', 'q.lat', 'x.ulng', 'x.ulat', 'x.vlng', 'x.vlat')} AS d FROM pts q JOIN edges x ON true)) e USING (point_id) GROUP BY 1",
    "facility_mapping": f"SELECT facility_id, node, shared_ways, round(d,3) AS dist_m FROM (SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY shared_ways DESC, round(d,6), node) AS k FROM (SELECT f.facility_id, n.node, CASE WHEN len(f.ways)=0 THEN 0 ELSE CASE WHEN f.ways[1]//2=n.node THEN 1 ELSE 0 END END AS shared_ways, len(f.ways) AS own, {hav('f.x', 'f.y', 'n.lng', 'n.lat')} AS d FROM (SELECT s_suppkey AS facility_id, 116.0::DOUBLE+(s_suppkey%40)*0.01::DOUBLE+(s_suppkey%3)*0.00001::DOUBLE AS x, 39.6::DOUBLE+(s_suppkey%50)*0.01::DOUBLE AS y, CASE WHEN s_suppkey%4=0 THEN []::BIGINT[] ELSE [(s_suppkey%40+(s_suppkey%50)*40)*2] END AS ways FROM supplier) f JOIN nodes n ON abs(n.lng-f.x)<0.001 AND abs(n.lat-f.y)<0.001) WHERE d<=3 AND (own=0 OR shared_ways>0)) WHERE k=1",
    "edge_classification": "SELECT edge_id, zone, mainline, exempt, forbidden, is_link FROM cls",
    "classification_audit": "SELECT zone, count(*) AS edges, count(*) FILTER (mainline) AS mainlines, count(*) FILTER (is_link) AS links, count(*) FILTER (forbidden) AS forbidden, CAST(sum(len_mm) AS BIGINT) AS total_mm FROM cls GROUP BY 1",
    "forbidden_turns": "SELECT from_edge, via_node, to_edge FROM turns",
    "illegal_access_turns": "SELECT m.edge_id AS from_edge, m.node AS via_node, p.edge_id AS to_edge FROM inc m JOIN inc p USING (node) WHERE m.mainline AND NOT p.mainline AND NOT p.is_link UNION ALL SELECT p.edge_id, m.node, m.edge_id FROM inc m JOIN inc p USING (node) WHERE m.mainline AND NOT p.mainline AND NOT p.is_link",
    "link_components": "SELECT node, component FROM comp",
    "component_touches": "SELECT component, mainlines, outside FROM touch",
    "released_connectors": "SELECT e.edge_id, c.component FROM edges e JOIN comp c ON c.node=e.u JOIN touch t USING (component) WHERE e.is_link AND (t.mainlines>=2 OR (t.mainlines>=1 AND t.outside))",
    "reach_3km": "SELECT request, node, dist_mm FROM reach",
    "sssp_edge_keyed": "SELECT request, key, dist_mm FROM sp",
    "sssp_blocked": "SELECT request, key, dist_mm FROM lsp",
    "crossings": "SELECT portal_id, edge_id, ring, round(fraction,7)+0.0 AS fraction, round(lng,7) AS lng, round(lat,7) AS lat, direction FROM portal",
    "crossing_dedup": "SELECT edge_id, portal_id FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY fraction, portal_id) AS k FROM portal) WHERE k=1",
    "release_points": "SELECT portal_id, direction FROM portal WHERE road_class<>'motorway' AND NOT is_link",
    "multi_target_tier": "SELECT request, target, dist_mm, tier FROM tiers",
    "exit_selection": f"SELECT request, target, score, dist_mm FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score, dist_mm, target) AS k FROM (SELECT t.request, t.target, t.dist_mm, round({delta('a', 'b')},6) AS score FROM (SELECT t.*, {brg('n.lng', 'n.lat', 'p.lng', 'p.lat')} AS a, {brg('n.lng', 'n.lat', '116.35::DOUBLE', '39.95::DOUBLE')} AS b FROM tiers t JOIN (SELECT portal_id, any_value(lng) AS lng, any_value(lat) AS lat FROM portal GROUP BY 1) p ON p.portal_id=t.target JOIN nodes n ON n.node=t.request) t)) WHERE k=1",
    "simple_paths": "SELECT start, array_to_string(path,'-') AS path, d AS dist_mm FROM simple WHERE len(path)>1",
    "simple_paths_whole": "SELECT start, array_to_string(path,'-') AS path, d AS dist_mm FROM whole WHERE len(path)>1",
    "edge_runs": "SELECT route_id, CAST(run AS BIGINT) AS run, edge_key, first_seq, last_seq, n_points FROM runs",
    "cumulative_distance": f"SELECT route_id, seq, round(s,4) AS step_m, round(sum(s) OVER (PARTITION BY route_id ORDER BY seq),3) AS cum_m FROM (SELECT route_id, seq, coalesce(CASE WHEN plng IS NULL THEN NULL ELSE {hav('plng', 'plat', 'lng', 'lat')} END,0) AS s FROM (SELECT *, lag(lng) OVER w AS plng, lag(lat) OVER w AS plat FROM tr WINDOW w AS (PARTITION BY route_id ORDER BY seq)))",
    "resample_20m": f"SELECT route_id, seq, k, round(plng+(lng-plng)*(k/n::DOUBLE),7) AS lng, round(plat+(lat-plat)*(k/n::DOUBLE),7) AS lat FROM (SELECT *, unnest(range(1,n+1)) AS k FROM (SELECT *, CAST(greatest(1,ceil({hav('plng', 'plat', 'lng', 'lat')}/20)) AS INTEGER) AS n FROM (SELECT *, lag(lng) OVER w AS plng, lag(lat) OVER w AS plat FROM tr WINDOW w AS (PARTITION BY route_id ORDER BY seq)) WHERE plng IS NOT NULL))",
    "corridor_match": "SELECT route_id, corridor_id, CAST(first_run AS BIGINT) AS first_run FROM (SELECT r.route_id, c.corridor_id, r.run-c.pos AS first_run, count(*) AS n FROM runs r JOIN (SELECT route_id AS corridor_id, run-3 AS pos, edge_key FROM runs WHERE route_id%50=0 AND run BETWEEN 3 AND 6) c USING (edge_key) GROUP BY 1,2,3) m JOIN (SELECT route_id AS corridor_id, count(*) AS size FROM runs WHERE route_id%50=0 AND run BETWEEN 3 AND 6 GROUP BY 1) z USING (corridor_id) WHERE n=size",
    "first_last_crossing": "SELECT route_id, arg_min(portal_id,(run,first_seq,portal_id)) AS first_portal, arg_max(portal_id,(run,first_seq,portal_id)) AS last_portal FROM runs r JOIN portal p ON p.key=r.edge_key GROUP BY 1",
    "route_conflicts": f"SELECT t.route_id, count(v.point_id) AS conflicts, coalesce(min(v.min_m), 'Infinity'::DOUBLE) AS least_m FROM (SELECT DISTINCT route_id FROM tr) t LEFT JOIN (SELECT route_id, point_id, round(min(d),4) AS min_m FROM (SELECT s.route_id, p.point_id, {seg('p.lng', 'p.lat', 's.a', 's.b', 's.lng', 's.lat')} AS d FROM (SELECT *, lag(lng) OVER w AS a, lag(lat) OVER w AS b, lag(edge_key) OVER w AS before FROM tr WINDOW w AS (PARTITION BY route_id ORDER BY seq)) s JOIN pts p ON p.lat BETWEEN s.lat-0.001 AND s.lat+0.001 AND p.lng BETWEEN least(s.a,s.lng)-0.001 AND greatest(s.a,s.lng)+0.001 WHERE s.edge_key>=0 AND s.before=s.edge_key) WHERE d<=50 GROUP BY 1,2) v USING (route_id) GROUP BY 1",
    "canonical_fingerprint": "SELECT sha256('blocked='||coalesce(string_agg(edge_id||',', '' ORDER BY edge_id),'')||'|') AS fingerprint FROM blk",
    "corridor_blocks": "SELECT m.route_id, m.corridor_id, CAST(m.first_run AS BIGINT) AS first_run FROM (SELECT r.route_id, c.corridor_id, r.run-c.pos AS first_run, count(*) AS n FROM runs r JOIN (SELECT route_id AS corridor_id, run-3 AS pos, edge_key FROM runs WHERE route_id%50=0 AND run BETWEEN 3 AND 6) c USING (edge_key) GROUP BY 1,2,3) m JOIN (SELECT route_id AS corridor_id, count(*) AS size FROM runs WHERE route_id%50=0 AND run BETWEEN 3 AND 6 GROUP BY 1) z USING (corridor_id) JOIN runs p ON p.route_id=m.corridor_id AND p.run=2 JOIN runs q ON q.route_id=m.corridor_id AND q.run=7 JOIN runs a ON a.route_id=m.route_id AND a.run=m.first_run-1 AND a.edge_key=p.edge_key JOIN runs b ON b.route_id=m.route_id AND b.run=m.first_run+z.size AND b.edge_key=q.edge_key WHERE n=size",
    "route_validation": f"SELECT route_id, point_id, round(min(d),4) AS min_m FROM (SELECT s.route_id, p.point_id, {seg('p.lng', 'p.lat', 's.a', 's.b', 's.lng', 's.lat')} AS d FROM (SELECT *, lag(lng) OVER w AS a, lag(lat) OVER w AS b, lag(edge_key) OVER w AS before FROM tr WINDOW w AS (PARTITION BY route_id ORDER BY seq)) s JOIN pts p ON p.lat BETWEEN s.lat-0.001 AND s.lat+0.001 AND p.lng BETWEEN least(s.a,s.lng)-0.001 AND greatest(s.a,s.lng)+0.001 WHERE s.edge_key>=0 AND s.before=s.edge_key) WHERE d<=50 GROUP BY 1,2",
    "poi_top1": f"SELECT point_id, node, kind, dist_m FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY kind, dist_m, node) AS k FROM (SELECT p.point_id, n.node, n.kind, round({hav('n.lng', 'n.lat', 'p.lng', 'p.lat')},4) AS dist_m, {hav('n.lng', 'n.lat', 'p.lng', 'p.lat')} AS d FROM pts p JOIN (SELECT nodes.*, CASE WHEN regexp_matches(p_type,'BRASS|STEEL') THEN 0 WHEN regexp_matches(p_type,'COPPER') THEN 1 ELSE 2 END AS kind FROM nodes JOIN part ON p_partkey=node) n ON abs(n.lat-p.lat)<0.015 ) WHERE d<=1500) WHERE k=1",
    "sample_evenly": "SELECT point_id FROM (SELECT point_id, row_number() OVER (ORDER BY point_id)-1 AS k, count(*) OVER () AS n FROM pts) WHERE n<=1200 OR k IN (SELECT (i*(SELECT count(*) FROM pts))//1200 FROM range(1200) t(i))",
    "second_largest_ring": "SELECT ring, round(area,9) AS area FROM (SELECT *, row_number() OVER (ORDER BY area DESC, ring) AS k FROM (SELECT ring, abs(sum(ax*y2-bx*ay))/2 AS area FROM segs GROUP BY 1)) WHERE k=2",
    "set_union_keys": "SELECT edge_id FROM blk UNION SELECT edge_id FROM cls WHERE forbidden",
    "set_intersect_nodes": "SELECT node FROM reach WHERE request=0 INTERSECT SELECT node FROM reach WHERE request=42",
    "set_diff_points": "SELECT point_id FROM pts EXCEPT SELECT point_id FROM near",
    "blocked_fingerprint": "SELECT sha256(coalesce(string_agg(h, ',' ORDER BY c),'')) AS fingerprint FROM (SELECT edge_id//4096 AS c, sha256(string_agg(CAST(edge_id AS VARCHAR), ',' ORDER BY edge_id)) AS h FROM blk GROUP BY 1)",
    "latency_nearest_rank": "SELECT event_type, min(value) FILTER (k>=ceil(n*0.5)) AS p50, min(value) FILTER (k>=ceil(n*0.95)) AS p95, max(value) AS max FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY 1",
    "location_throttle": "SELECT user_id, drawn, last_drawn, usable FROM (SELECT user_id, count(*) AS drawn, max(event_id) AS last_drawn FROM (SELECT user_id, arg_min(event_id,(ts,event_id)) AS event_id FROM (SELECT *, epoch_ms(ts)//750 AS slot FROM events) GROUP BY user_id, slot) GROUP BY 1) JOIN (SELECT user_id, count(*) FILTER (value<=150) AS usable FROM events GROUP BY 1) USING (user_id)",
    "location_drawings": "SELECT user_id, CAST(ms AS BIGINT) AS drawn_ms, sequence FROM drawn",
    "outer_walk": f"SELECT portal_id, k, clearance, CAST(floor(least(200.0,greatest(0.0,clearance-25))) AS INTEGER) AS radius FROM (SELECT *, row_number() OVER (PARTITION BY portal_id ORDER BY clearance DESC, k) AS z FROM (SELECT portal_id, k, coalesce(round(min(CASE WHEN m<=250 THEN m END),4),250.0::DOUBLE) AS clearance FROM (SELECT w.portal_id, w.k, CASE WHEN p.point_id IS NULL THEN NULL ELSE {hav('p.lng', 'p.lat', 'w.x', 'w.y')} END AS m FROM (SELECT portal_id, k, lng+(vlng-lng)*least(1.0::DOUBLE,k*20/greatest(length,0.001::DOUBLE)) AS x, lat+(vlat-lat)*least(1.0::DOUBLE,k*20/greatest(length,0.001::DOUBLE)) AS y FROM (SELECT *, unnest(range(1,1+CAST(greatest(1,ceil(least(length,500.0::DOUBLE)/20)) AS INTEGER))) AS k FROM (SELECT portal_id, lng, lat, vlng, vlat, {hav('lng', 'lat', 'vlng', 'vlat')} AS length FROM portal JOIN (SELECT edge_id, vlng, vlat FROM edges) USING (edge_id) WHERE direction='OUT'))) w LEFT JOIN pts p ON abs(p.lat-w.y)<0.004 AND abs(p.lng-w.x)<0.004) GROUP BY 1,2)) WHERE z=1",
}

_MORE = {
    # updates that are the latest of their user by sequence when they come; from each drawing the next: the first update after it, at
    # once or when 750 ms have passed, and then the latest of those that came meanwhile
    "location_drawings": """, ups AS (SELECT user_id, ms, sequence, row_number() OVER (PARTITION BY user_id ORDER BY ms, sequence) AS n FROM (SELECT user_id, epoch_us(ts)//1000 AS ms, event_id AS sequence, max(event_id) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)//1000, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL) WHERE before IS NULL OR sequence>before),
drawn(user_id, ms, n, sequence) AS (SELECT user_id, ms, n, sequence FROM ups WHERE n=1 UNION ALL SELECT d.user_id, greatest(u.ms, d.ms+750), k.n, k.sequence FROM drawn d JOIN ups u ON u.user_id=d.user_id AND u.n=d.n+1
  CROSS JOIN LATERAL (SELECT max(x.n) AS n, max(x.sequence) AS sequence FROM ups x WHERE x.user_id=d.user_id AND x.n>d.n AND (x.n=u.n OR x.ms<greatest(u.ms, d.ms+750))) k) """,
    "simple_paths_whole": ", whole(start, path, d) AS (SELECT node, [node], 0::BIGINT FROM nodes UNION ALL SELECT w.start, list_append(w.path, b.v), w.d+b.len_mm FROM whole w JOIN both_ways b ON b.u=w.path[-1] WHERE NOT list_contains(w.path, b.v) AND w.d+b.len_mm<=3000000) ",
    "illegal_access_turns": ", inc AS (SELECT u AS node, edge_id, mainline, is_link FROM cls WHERE car_access UNION ALL SELECT v, edge_id, mainline, is_link FROM cls WHERE car_access) ",
    "crs_inverse": f", inv(point_id, k, lng, lat, x, y) AS (SELECT point_id, 0, lng, lat, lng, lat FROM pts UNION ALL SELECT point_id, k+1, lng, lat, x-(x+({_ix})-lng), y-(y+({_iy})-lat) FROM inv WHERE k<12) ",
}


def oracle_sql() -> dict[str, str]:
    return {name: BASE + _MORE.get(name, "") + sql for name, sql in SQL.items()}
