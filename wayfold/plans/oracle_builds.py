"""SQL of catalog_builds' queries: name -> one statement, over the common tables of oracle.py."""

from __future__ import annotations

from wayfold.functions.text import ERROR_CODES
from wayfold.plans.oracle import BASE, D, brg, delta, hav, seg, shift

_MPS = "CASE road_class WHEN 'motorway' THEN 25 WHEN 'motorway_link' THEN 12 WHEN 'primary' THEN 15 ELSE 8 END"
#: Stretches of edges between crossings, the side of their middles, and how far these are from the boundary.
_SIDES = f""", places AS (SELECT edge_id, f FROM (SELECT edge_id, unnest([0.0::DOUBLE,1.0::DOUBLE]) AS f FROM edges UNION SELECT edge_id, fraction FROM portal)),
cuts AS (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY f) AS k FROM (SELECT edge_id, f, lead(f) OVER (PARTITION BY edge_id ORDER BY f) AS g FROM places) WHERE g-f>1e-9),
mids AS (SELECT c.edge_id, c.k, c.f, c.g, e.ulng+(e.vlng-e.ulng)*((f+g)/2) AS lng, e.ulat+(e.vlat-e.ulat)*((f+g)/2) AS lat FROM cuts c JOIN edges e USING (edge_id)),
sides AS (SELECT edge_id, k, any_value(f) AS f, any_value(g) AS g, CASE WHEN bool_or(b) THEN 'BOUNDARY' WHEN sum(CASE WHEN o THEN 1 ELSE 0 END)%2=1 THEN 'INSIDE' ELSE 'OUTSIDE' END AS side, min(sqrt(pow(lng-(ax+(bx-ax)*t),2)+pow(lat-(ay+(y2-ay)*t),2))) AS near_deg FROM (SELECT q.*, s.*, abs((bx-ax)*(lat-ay)-(y2-ay)*(lng-ax))<=1e-12 AND lng BETWEEN least(ax,bx) AND greatest(ax,bx) AND lat BETWEEN least(ay,y2) AND greatest(ay,y2) AS b, y2<>ay AND ((ay>lat)<>(y2>lat)) AND lng<(bx-ax)*(lat-ay)/(CASE WHEN y2=ay THEN 1 ELSE y2-ay END)+ax AS o, greatest(0.0::DOUBLE,least(1.0::DOUBLE,((lng-ax)*(bx-ax)+(lat-ay)*(y2-ay))/((bx-ax)*(bx-ax)+(y2-ay)*(y2-ay)))) AS t FROM mids q, segs s) GROUP BY 1,2),
flags AS (SELECT edge_id, bool_and(side<>'OUTSIDE' OR near_deg<=1e-5) AS stays_within, NOT bool_or(side='INSIDE' AND near_deg>1e-5) AS avoids_interior FROM sides GROUP BY 1),
trav AS (SELECT key, edge_id, side, CASE WHEN key%2=1 THEN -k ELSE k END AS k, CASE WHEN key%2=1 THEN 1-g ELSE f END AS f FROM sides JOIN ekeys USING (edge_id)),
dirp AS (SELECT key, edge_id, CASE WHEN before='INSIDE' THEN 'OUT' ELSE 'IN' END AS direction, CASE WHEN prev='BOUNDARY' THEN 'OVERLAP' ELSE 'INTERIOR' END AS kind, f AS fraction FROM (SELECT *, last_value(CASE WHEN side<>'BOUNDARY' THEN side END IGNORE NULLS) OVER (PARTITION BY key ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, lag(side) OVER (PARTITION BY key ORDER BY k) AS prev FROM trav) WHERE (before='INSIDE' AND side='OUTSIDE') OR (before='OUTSIDE' AND side='INSIDE')) """
#: Edges by geometry; the second area is a box, which covers an edge whose ends it covers.
_CLASSES = (
    _SIDES
    + """, gz AS (SELECT e.*, coalesce(s.i, false) AS in_inner, NOT coalesce(s.i, false) AND least(ulng,vlng)>=116.205::DOUBLE AND greatest(ulng,vlng)<=116.375::DOUBLE AND least(ulat,vlat)>=39.695::DOUBLE AND greatest(ulat,vlat)<=40.055::DOUBLE AS in_second, edge_id%39=0 AS identity, road_class='motorway' AND NOT is_link AS mainline, road_class='motorway' AND is_link AS link
 FROM edges e LEFT JOIN (SELECT edge_id, bool_or(side='INSIDE' AND near_deg>1e-9) AS i FROM sides GROUP BY 1) s USING (edge_id)),
gcls AS (SELECT *, mainline AND identity AS ring, identity AND NOT mainline AS mismatch, mainline AND (identity OR in_second) AS exempt, mainline AND NOT identity AND in_inner AS forbidden, mainline AND NOT identity AND in_second AS second_main FROM gz) """
)
_NEAREST = f", nearest AS (SELECT point_id, arg_min(edge_id,(round(d,6),edge_id)) AS edge_id FROM (SELECT p.point_id, e.edge_id, {seg('p.lng', 'p.lat', 'e.ulng', 'e.ulat', 'e.vlng', 'e.vlat')} AS d FROM pts p, edges e) GROUP BY 1) "
#: The nearest edge of every point that cars may use.
_SNAP = f", snapd AS (SELECT p.point_id, p.lng, p.lat, e.edge_id, e.ulng, e.ulat, e.vlng, e.vlat, x.d FROM (SELECT point_id, arg_min(edge_id,(round(d,6),edge_id)) AS edge_id, arg_min(d,(round(d,6),edge_id)) AS d FROM (SELECT p.point_id, e.edge_id, {seg('p.lng', 'p.lat', 'e.ulng', 'e.ulat', 'e.vlng', 'e.vlat')} AS d FROM pts p, edges e WHERE e.car_access) GROUP BY 1) x JOIN pts p USING (point_id) JOIN edges e ON e.edge_id=x.edge_id) "
#: Routes between places: first parts of keys are keys of their own, -2-key, with the turns of the key.
_PLACES = (
    f""", tkey AS (SELECT k.key, k.edge_id, k.len_mm, k.len_mm//({_MPS.replace("road_class", "e.road_class")}) AS ms FROM ekeys k JOIN edges e USING (edge_id)),
snapk AS (SELECT n.request, n.stop, n.edge_id, n.t, e.ulng+(e.vlng-e.ulng)*n.t AS x, e.ulat+(e.vlat-e.ulat)*n.t AS y FROM (SELECT s.request, s.stop, s.edge_id, round(greatest(0.0::DOUBLE,least(1.0::DOUBLE,((s.lng-ulng)*(vlng-ulng)+(s.lat-ulat)*(vlat-ulat))/((vlng-ulng)*(vlng-ulng)+(vlat-ulat)*(vlat-ulat)))),9) AS t FROM (SELECT request, stop, any_value(lng) AS lng, any_value(lat) AS lat, arg_min(edge_id,(round(d,6),edge_id)) AS edge_id FROM (SELECT p.request, p.stop, p.lng, p.lat, e.edge_id, {seg("p.lng", "p.lat", "e.ulng", "e.ulat", "e.vlng", "e.vlat")} AS d FROM rp p, edges e WHERE e.car_access) GROUP BY 1,2) s JOIN edges e USING (edge_id)) n JOIN edges e USING (edge_id)),
onk AS (SELECT request, stop, key, CAST(len_mm-floor(len_mm*t) AS BIGINT) AS mm, CAST(ms-floor(ms*t) AS BIGINT) AS ms FROM (SELECT s.request, s.stop, k.key, k.len_mm, k.ms, CASE WHEN k.key%2=1 THEN 1-s.t ELSE s.t END AS t FROM snapk s JOIN tkey k USING (edge_id) WHERE k.edge_id NOT IN (SELECT edge_id FROM blk))),
padj AS (SELECT * FROM ladj UNION ALL SELECT -2-key, next_key, next_mm FROM ladj WHERE key IN (SELECT key FROM onk WHERE stop=0)),
pl(request, key, w) USING KEY (request, key) AS (SELECT request, -2-key, mm*100000000::BIGINT+ms FROM onk WHERE stop=0 UNION SELECT s.request, a.next_key, min(s.w+a.next_mm*100000000::BIGINT+t.ms) FROM pl s JOIN padj a ON a.key=s.key JOIN tkey t ON t.key=a.next_key LEFT JOIN recurring.pl r ON r.request=s.request AND r.key=a.next_key WHERE r.key IS NULL OR s.w+a.next_mm*100000000::BIGINT+t.ms<r.w GROUP BY 1,2),
pgoal AS (SELECT p.request, p.w-(o.mm*100000000::BIGINT+o.ms) AS w FROM pl p JOIN onk o ON o.request=p.request AND o.stop=1 AND (o.key=p.key OR -2-o.key=p.key) WHERE p.w//100000000>=o.mm) """
)
_fx, _fy = shift("lng", "lat")
_ax, _ay = shift("ax", "ay")
_codes = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(ERROR_CODES.values()))
_TOLL = """, tk AS (SELECT e.*, c.mainline AS barrier, c.mainline AND c.zone='SECOND' AS ring FROM ekeys e JOIN cls c USING (edge_id)),
booth AS (SELECT s_suppkey AS request, s_suppkey*7 AS node FROM supplier JOIN nodes ON node=s_suppkey*7),
fwd(request, key, d) USING KEY (request, key) AS (SELECT request, key, CASE WHEN barrier THEN 0 ELSE len_mm END FROM booth JOIN tk ON from_node=node WHERE barrier OR len_mm<=5000000 UNION SELECT f.request, b.key, min(f.d+CASE WHEN b.barrier THEN 0 ELSE b.len_mm END) FROM fwd f JOIN tk a ON a.key=f.key AND NOT a.barrier JOIN tk b ON b.from_node=a.to_node LEFT JOIN turns t ON t.from_edge=a.edge_id AND t.via_node=a.to_node AND t.to_edge=b.edge_id LEFT JOIN recurring.fwd r ON r.request=f.request AND r.key=b.key WHERE t.from_edge IS NULL AND f.d+CASE WHEN b.barrier THEN 0 ELSE b.len_mm END<=5000000 AND (r.key IS NULL OR f.d+CASE WHEN b.barrier THEN 0 ELSE b.len_mm END<r.d) GROUP BY 1,2),
rev(request, key, d) USING KEY (request, key) AS (SELECT request, key, CASE WHEN barrier THEN 0 ELSE len_mm END FROM booth JOIN tk ON to_node=node WHERE barrier OR len_mm<=5000000 UNION SELECT f.request, b.key, min(f.d+CASE WHEN b.barrier THEN 0 ELSE b.len_mm END) FROM rev f JOIN tk a ON a.key=f.key AND NOT a.barrier JOIN tk b ON b.to_node=a.from_node LEFT JOIN turns t ON t.from_edge=b.edge_id AND t.via_node=a.from_node AND t.to_edge=a.edge_id LEFT JOIN recurring.rev r ON r.request=f.request AND r.key=b.key WHERE t.from_edge IS NULL AND f.d+CASE WHEN b.barrier THEN 0 ELSE b.len_mm END<=5000000 AND (r.key IS NULL OR f.d+CASE WHEN b.barrier THEN 0 ELSE b.len_mm END<r.d) GROUP BY 1,2),
ent AS (SELECT f.request, f.key, f.d AS dist_mm FROM fwd f JOIN tk USING (key) WHERE tk.ring),
ext AS (SELECT request, min(d) AS dist_mm FROM (SELECT f.request, f.d FROM rev f JOIN tk ON tk.key=f.key AND NOT tk.barrier JOIN nodes n ON n.node=tk.from_node AND n.gx>=30 UNION ALL SELECT b.request, 0 FROM booth b JOIN nodes n ON n.node=b.node AND n.gx>=30) GROUP BY 1) """
#: Predecessors of the searches above, the smallest of the best (-1: a start), and the keys on ways to the ends.
_TOLL_KEYS = (
    _TOLL
    + """, fpre AS (SELECT x.request, x.key, min(x.pred) AS pred FROM (SELECT f.request, f.key, -1::BIGINT AS pred FROM fwd f JOIN booth USING (request) JOIN tk k ON k.key=f.key AND k.from_node=booth.node WHERE f.d=CASE WHEN k.barrier THEN 0 ELSE k.len_mm END
  UNION ALL SELECT f.request, f.key, p.key FROM fwd f JOIN tk k ON k.key=f.key JOIN tk a ON a.to_node=k.from_node AND NOT a.barrier JOIN fwd p ON p.request=f.request AND p.key=a.key AND p.d+CASE WHEN k.barrier THEN 0 ELSE k.len_mm END=f.d WHERE NOT EXISTS (SELECT 1 FROM turns t WHERE t.from_edge=a.edge_id AND t.via_node=a.to_node AND t.to_edge=k.edge_id)) x GROUP BY 1,2),
rpre AS (SELECT x.request, x.key, min(x.pred) AS pred FROM (SELECT f.request, f.key, -1::BIGINT AS pred FROM rev f JOIN booth USING (request) JOIN tk k ON k.key=f.key AND k.to_node=booth.node WHERE f.d=CASE WHEN k.barrier THEN 0 ELSE k.len_mm END
  UNION ALL SELECT f.request, f.key, p.key FROM rev f JOIN tk k ON k.key=f.key JOIN tk a ON a.from_node=k.to_node AND NOT a.barrier JOIN rev p ON p.request=f.request AND p.key=a.key AND p.d+CASE WHEN k.barrier THEN 0 ELSE k.len_mm END=f.d WHERE NOT EXISTS (SELECT 1 FROM turns t WHERE t.from_edge=k.edge_id AND t.via_node=k.to_node AND t.to_edge=a.edge_id)) x GROUP BY 1,2),
rend AS (SELECT f.request, arg_min(f.key,(f.d,f.key)) AS key FROM rev f JOIN tk ON tk.key=f.key AND NOT tk.barrier JOIN nodes n ON n.node=tk.from_node AND n.gx>=30 GROUP BY 1),
ftr(request, key) AS (SELECT request, key FROM ent UNION SELECT p.request, p.pred FROM ftr f JOIN fpre p ON p.request=f.request AND p.key=f.key WHERE p.pred>=0),
rtr(request, key) AS (SELECT request, key FROM rend UNION SELECT p.request, p.pred FROM rtr f JOIN rpre p ON p.request=f.request AND p.key=f.key WHERE p.pred>=0),
tollk AS (SELECT DISTINCT role, key FROM (SELECT 'ENTRY' AS role, key FROM ftr UNION ALL SELECT 'EXIT', key FROM rtr) JOIN tk USING (key) WHERE NOT barrier) """
)
_LINKS = (
    _TOLL_KEYS
    + """, lnk AS (SELECT k.* FROM ekeys k JOIN cls USING (edge_id) WHERE is_link), mn AS (SELECT k.* FROM ekeys k JOIN cls USING (edge_id) WHERE mainline),
lp(start_key, from_edge, last, node, keys, path, d) AS (SELECT key, edge_id, edge_id, to_node, []::BIGINT[], [to_node], 0::BIGINT FROM mn
  UNION ALL SELECT s.start_key, s.from_edge, b.edge_id, b.to_node, list_append(s.keys, b.key), list_append(s.path, b.to_node), s.d+b.len_mm FROM lp s JOIN lnk b ON b.from_node=s.node WHERE NOT list_contains(s.path, b.to_node) AND s.d+b.len_mm<=3000000 AND NOT EXISTS (SELECT 1 FROM turns t WHERE t.from_edge=s.last AND t.via_node=s.node AND t.to_edge=b.edge_id)),
ich AS (SELECT s.from_edge, s.path, s.keys, b.edge_id AS to_edge, s.d AS dist_mm, list_bool_or(list_transform(s.path, lambda x: x%35=0)) AS toll, EXISTS (SELECT 1 FROM tollk WHERE list_contains(s.keys, tollk.key)) AS overlap FROM lp s JOIN mn b ON b.from_node=s.node AND b.edge_id<>s.from_edge WHERE len(s.keys)>0 AND NOT EXISTS (SELECT 1 FROM turns t WHERE t.from_edge=s.last AND t.via_node=s.node AND t.to_edge=b.edge_id)),
mc(node, reach) AS (SELECT u, u FROM edges WHERE is_link AND car_access UNION SELECT v, v FROM edges WHERE is_link AND car_access UNION SELECT c.node, CASE WHEN e.u=c.reach THEN e.v ELSE e.u END FROM mc c JOIN edges e ON e.is_link AND e.car_access AND (e.u=c.reach OR e.v=c.reach)),
mcomp AS (SELECT node, min(reach) AS component FROM mc GROUP BY 1),
mt AS (SELECT component, count(DISTINCT m.edge_id) AS mains, bool_or(i.node IS NOT NULL) AS solved FROM mcomp c LEFT JOIN (SELECT u AS node, edge_id FROM cls WHERE mainline UNION ALL SELECT v, edge_id FROM cls WHERE mainline) m USING (node) LEFT JOIN (SELECT DISTINCT path[1] AS node FROM ich) i USING (node) GROUP BY 1) """
)
_WALK = f""", ways AS (SELECT edge_id, u AS a, v AS b, ulng AS ax, ulat AS ay, vlng AS bx, vlat AS y2 FROM cls WHERE car_access AND (zone<>'INNER' OR road_class<>'motorway') UNION ALL SELECT edge_id, v, u, vlng, vlat, ulng, ulat FROM cls WHERE car_access AND (zone<>'INNER' OR road_class<>'motorway')),
w0 AS (SELECT p.portal_id, 0 AS hop, p.edge_id, p.lng AS ax, p.lat AS ay, w.bx, w.y2, w.b, 0.0::DOUBLE AS m0, {hav("p.lng", "p.lat", "w.bx", "w.y2")} AS m FROM portal p JOIN edges e USING (edge_id) JOIN ways w ON w.edge_id=p.edge_id AND w.b=e.v WHERE p.direction='OUT'),
w1 AS (SELECT w0.portal_id, 1 AS hop, w.edge_id, w.ax, w.ay, w.bx, w.y2, w.b, w0.m AS m0, {hav("w.ax", "w.ay", "w.bx", "w.y2")} AS m FROM w0 JOIN ways w ON w.a=w0.b AND w.edge_id<>w0.edge_id WHERE w0.m<500),
spots AS (SELECT portal_id, hop, edge_id, k, m0+least(m,k*20.0::DOUBLE) AS along, ax+(bx-ax)*least(1.0::DOUBLE,k*20/greatest(m,0.001::DOUBLE)) AS lng, ay+(y2-ay)*least(1.0::DOUBLE,k*20/greatest(m,0.001::DOUBLE)) AS lat FROM (SELECT *, unnest(range(1,1+CAST(greatest(1,ceil(least(m,500.0::DOUBLE-m0)/20)) AS INTEGER))) AS k FROM (SELECT * FROM w0 UNION ALL SELECT * FROM w1))),
walked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY portal_id ORDER BY clearance DESC, hop, edge_id, k) AS z FROM (SELECT s.portal_id, s.hop, s.edge_id, s.k, any_value(s.along) AS along, coalesce(round(min(CASE WHEN d<=250 THEN d END),4),250.0::DOUBLE) AS clearance FROM (SELECT s.*, CASE WHEN p.point_id IS NULL THEN NULL ELSE {hav("p.lng", "p.lat", "s.lng", "s.lat")} END AS d FROM spots s LEFT JOIN pts p ON abs(p.lat-s.lat)<0.004 AND abs(p.lng-s.lng)<0.004 WHERE s.along<=500) s GROUP BY 1,2,3,4)) WHERE z=1) """

#: Legs between inner places and release points, forward and against the direction of travel, with tiers and angles.
_MODES = (
    _PLACES
    + _SIDES
    + f""", modes AS (SELECT a.request, a.place AS sp, b.place AS tp, CASE WHEN x.location='BOUNDARY' OR y.location='BOUNDARY' THEN 'AMBIGUOUS' WHEN x.location='INSIDE' AND y.location='INSIDE' THEN 'INTERNAL' WHEN x.location='OUTSIDE' AND y.location='OUTSIDE' THEN 'EXTERNAL' WHEN x.location='INSIDE' THEN 'OUTBOUND' ELSE 'INBOUND' END AS mode FROM rp a JOIN rp b ON b.request=a.request AND b.stop=1 JOIN loc x ON x.kind='r' AND x.id=a.place JOIN loc y ON y.kind='r' AND y.id=b.place WHERE a.stop=0),
ctl AS (SELECT edge_id FROM flags JOIN cls USING (edge_id) WHERE NOT mainline AND NOT is_link AND stays_within AND car_access AND edge_id NOT IN (SELECT edge_id FROM blk)),
rel AS (SELECT 'R-'||d.key||'-'||CAST(round(d.fraction*1e6) AS BIGINT) AS target, d.key, d.direction, d.f9, k.len_mm, k.ms, e.ulng+(e.vlng-e.ulng)*d.t AS lng, e.ulat+(e.vlat-e.ulat)*d.t AS lat FROM (SELECT *, round(fraction,9) AS f9, CASE WHEN key%2=1 THEN 1-fraction ELSE fraction END AS t FROM dirp) d JOIN edges e ON e.edge_id=d.edge_id AND e.car_access AND e.road_class<>'motorway' AND NOT e.is_link JOIN tkey k ON k.key=d.key WHERE d.edge_id NOT IN (SELECT edge_id FROM blk)),
fadj AS (SELECT a.key, a.next_key, a.next_mm AS mm, t.ms FROM ladj a JOIN tkey t ON t.key=a.next_key WHERE a.key//2 IN (SELECT edge_id FROM ctl) AND (a.next_key//2 IN (SELECT edge_id FROM ctl) OR a.next_key IN (SELECT key FROM rel WHERE direction='OUT'))),
badj AS (SELECT a.next_key AS key, a.key AS next_key, t.len_mm AS mm, t.ms FROM ladj a JOIN tkey t ON t.key=a.key WHERE a.next_key//2 IN (SELECT edge_id FROM ctl) AND (a.key//2 IN (SELECT edge_id FROM ctl) OR a.key IN (SELECT key FROM rel WHERE direction='IN'))),
legadj AS (SELECT 'OUT' AS d, key, next_key, mm, ms FROM fadj UNION ALL SELECT 'OUT', -2-key, next_key, mm, ms FROM fadj UNION ALL SELECT 'IN', key, next_key, mm, ms FROM badj UNION ALL SELECT 'IN', -2-key, next_key, mm, ms FROM badj),
lego AS (SELECT o.request, CASE WHEN o.stop=0 THEN 'OUT' ELSE 'IN' END AS d, o.key, CASE WHEN o.stop=0 THEN o.mm ELSE k.len_mm-o.mm END AS mm, CASE WHEN o.stop=0 THEN o.ms ELSE k.ms-o.ms END AS ms FROM onk o JOIN tkey k USING (key) JOIN modes m USING (request) WHERE k.edge_id IN (SELECT edge_id FROM ctl) AND (m.mode='OUTBOUND' AND o.stop=0 OR m.mode='INBOUND' AND o.stop=1)),
leg(request, d, key, w) USING KEY (request, d, key) AS (SELECT request, d, -2-key, mm*100000000::BIGINT+ms FROM lego UNION SELECT s.request, s.d, a.next_key, min(s.w+a.mm*100000000::BIGINT+a.ms) FROM leg s JOIN legadj a ON a.d=s.d AND a.key=s.key LEFT JOIN recurring.leg r ON r.request=s.request AND r.d=s.d AND r.key=a.next_key WHERE r.key IS NULL OR s.w+a.mm*100000000::BIGINT+a.ms<r.w GROUP BY 1,2,3),
legb AS (SELECT *, CASE WHEN direction='OUT' THEN len_mm-CAST(floor(len_mm*f9) AS BIGINT) ELSE CAST(floor(len_mm*f9) AS BIGINT) END AS mm, CASE WHEN direction='OUT' THEN ms-CAST(floor(ms*f9) AS BIGINT) ELSE CAST(floor(ms*f9) AS BIGINT) END AS t FROM rel),
legg AS (SELECT l.request, r.target, min(l.w-r.mm*100000000::BIGINT-r.t) AS w, any_value(r.lng) AS lng, any_value(r.lat) AS lat FROM leg l JOIN legb r ON r.direction=l.d AND (r.key=l.key OR -2-r.key=l.key) WHERE l.w//100000000>=r.mm GROUP BY 1,2),
legt AS (SELECT *, CAST(greatest(1, ceil((d-best)/1000000.0)) AS INTEGER) AS tier FROM (SELECT *, w//100000000 AS d, min(w//100000000) OVER (PARTITION BY request) AS best FROM legg) WHERE d<=best+5000000),
legs AS (SELECT t.*, round({delta("a", "b")},6) AS score FROM (SELECT t.*, {brg("i.lng", "i.lat", "t.lng", "t.lat")} AS a, {brg("i.lng", "i.lat", "o.lng", "o.lat")} AS b FROM legt t JOIN modes m USING (request) JOIN rp i ON i.place=CASE WHEN m.mode='OUTBOUND' THEN m.sp ELSE m.tp END JOIN rp o ON o.place=CASE WHEN m.mode='OUTBOUND' THEN m.tp ELSE m.sp END) t),
legc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY CASE WHEN score<=60 THEN 0 ELSE 1 END, CASE WHEN score<=60 THEN tier ELSE 0 END, score, d, target) AS k FROM legs) WHERE k=1) """
)
#: The border of chosen squares, as unit steps (place, direction: 0 right, 1 up, 2 left, 3 down) with the inside on the left; at a
#: corner where two squares touch a step turns left if it can.
_SQUARES = """, sq AS (SELECT gx, gy FROM nodes JOIN part ON p_partkey=node WHERE p_size>=20),
stp AS (SELECT a.gx AS x, a.gy AS y, 0 AS d FROM sq a WHERE NOT EXISTS (SELECT 1 FROM sq b WHERE b.gx=a.gx AND b.gy=a.gy-1) UNION ALL SELECT a.gx+1, a.gy, 1 FROM sq a WHERE NOT EXISTS (SELECT 1 FROM sq b WHERE b.gx=a.gx+1 AND b.gy=a.gy)
 UNION ALL SELECT a.gx+1, a.gy+1, 2 FROM sq a WHERE NOT EXISTS (SELECT 1 FROM sq b WHERE b.gx=a.gx AND b.gy=a.gy+1) UNION ALL SELECT a.gx, a.gy+1, 3 FROM sq a WHERE NOT EXISTS (SELECT 1 FROM sq b WHERE b.gx=a.gx-1 AND b.gy=a.gy)),
stq AS (SELECT *, x*1000000+y*10+d AS h, x+[1,0,-1,0][d+1] AS x2, y+[0,1,0,-1][d+1] AS y2 FROM stp),
nxt AS (SELECT a.h, arg_min(b.h, (a.d-b.d+5)%4) AS n FROM stq a JOIN stq b ON b.x=a.x2 AND b.y=a.y2 AND (b.d-a.d+4)%4<>2 GROUP BY 1),
cyc(h, reach) AS (SELECT h, h FROM nxt UNION SELECT c.h, n.n FROM cyc c JOIN nxt n ON n.h=c.reach),
rng AS (SELECT h, min(reach) AS ring FROM cyc GROUP BY 1) """

#: name -> (further common tables, query)
_QUERIES = {
    "edge_costs": ("", f"SELECT edge_id, CASE WHEN car_access THEN (len_mm//({_MPS}))/1000.0::DOUBLE END AS time_cost, CASE WHEN car_access THEN len_mm/1000.0::DOUBLE END AS distance_cost, len_mm//({_MPS})//1000 AS seconds, CAST(round(len_mm/1000.0::DOUBLE/16.67::DOUBLE*1000) AS BIGINT) AS handover_ms, edge_id AS base FROM edges"),
    "timed_paths": (f", tkey AS (SELECT k.*, len_mm//({_MPS.replace('road_class', 'e.road_class')}) AS ms FROM (SELECT key, edge_id, from_node FROM ekeys) k JOIN edges e USING (edge_id)), tp(key, w) USING KEY (key) AS (SELECT key, len_mm*1000000000000000::HUGEINT+ms FROM tkey JOIN (SELECT key, len_mm FROM ekeys) USING (key) WHERE from_node=0 UNION SELECT a.next_key, min(s.w+a.next_mm*1000000000000000::HUGEINT+t.ms) FROM tp s JOIN adj a ON a.key=s.key JOIN tkey t ON t.key=a.next_key LEFT JOIN recurring.tp r ON r.key=a.next_key WHERE r.key IS NULL OR s.w+a.next_mm*1000000000000000::HUGEINT+t.ms<r.w GROUP BY 1) ", "SELECT key, CAST(w//1000000000000000 AS BIGINT) AS dist_mm, CAST(w%1000000000000000 AS BIGINT) AS ms FROM tp"),
    "planned_routes": (_PLACES, "SELECT q.request, CASE WHEN i.request IS NULL THEN 'INVALID' WHEN w.w IS NULL THEN 'NO_ROUTE' ELSE 'ROUTE' END AS outcome, w.w//100000000 AS dist_mm, w.w%100000000 AS ms, CASE WHEN w.w IS NOT NULL THEN true END AS sound, CASE WHEN w.w IS NOT NULL THEN round(a.x,6) END AS start_lng, CASE WHEN w.w IS NOT NULL THEN round(a.y,6) END AS start_lat, CASE WHEN w.w IS NOT NULL THEN round(b.x,6) END AS end_lng, CASE WHEN w.w IS NOT NULL THEN round(b.y,6) END AS end_lat FROM (SELECT DISTINCT request FROM rp) q LEFT JOIN (SELECT request FROM onk GROUP BY 1 HAVING count(DISTINCT stop)=2) i USING (request) LEFT JOIN (SELECT request, min(w) AS w FROM pgoal GROUP BY 1) w USING (request) JOIN snapk a ON a.request=q.request AND a.stop=0 JOIN snapk b ON b.request=q.request AND b.stop=1"),
    "mode_plans": (_MODES, "SELECT m.request, m.mode, CASE WHEN m.mode='AMBIGUOUS' THEN 'AMBIGUOUS' WHEN u.request IS NULL THEN 'INVALID' WHEN coalesce(c.w, w.w) IS NULL THEN 'NO_ROUTE' ELSE 'ROUTE' END AS outcome, c.target, c.tier, coalesce(c.w, w.w)//100000000 AS dist_mm, coalesce(c.w, w.w)%100000000 AS ms FROM modes m LEFT JOIN (SELECT request FROM onk JOIN modes USING (request) WHERE mode IN ('INTERNAL','EXTERNAL') GROUP BY 1 HAVING count(DISTINCT stop)=2 UNION SELECT request FROM lego) u USING (request) LEFT JOIN (SELECT request, min(w) AS w FROM pgoal JOIN modes USING (request) WHERE mode IN ('INTERNAL','EXTERNAL') GROUP BY 1) w USING (request) LEFT JOIN legc c USING (request)"),
    "snapped_points": (_SNAP, "SELECT point_id, edge_id, round(t,7)+0.0 AS fraction, round(ulng+(vlng-ulng)*t,7) AS on_lng, round(ulat+(vlat-ulat)*t,7) AS on_lat, round(d,4) AS dist_m, edge_id IS NOT NULL AS valid FROM pts LEFT JOIN (SELECT point_id, edge_id, d, ulng, ulat, vlng, vlat, round(greatest(0.0::DOUBLE,least(1.0::DOUBLE,((lng-ulng)*(vlng-ulng)+(lat-ulat)*(vlat-ulat))/((vlng-ulng)*(vlng-ulng)+(vlat-ulat)*(vlat-ulat)))),9) AS t FROM snapd WHERE d<=150) USING (point_id)"),
    "restricted_endpoints": (f", snap AS (SELECT node, arg_min(edge_id,(round(d,6),edge_id)) AS edge_id FROM (SELECT n.node, e.edge_id, {seg('n.lng', 'n.lat', 'e.ulng', 'e.ulat', 'e.vlng', 'e.vlat')} AS d FROM nodes n JOIN edges e ON n.lng BETWEEN e.ulng-0.02 AND e.vlng+0.02 AND n.lat BETWEEN e.ulat-0.02 AND e.vlat+0.02) GROUP BY 1) ", f"SELECT s.node, coalesce(h.near,false) AND NOT c.exempt AS restricted FROM snap s JOIN cls c USING (edge_id) LEFT JOIN (SELECT DISTINCT n.node, true AS near FROM nodes n JOIN pts p ON abs(p.lat-n.lat)<0.001 AND {hav('p.lng', 'p.lat', 'n.lng', 'n.lat')}<=50) h USING (node)"),
    "area_constraints": (_SIDES, "SELECT edge_id, stays_within, avoids_interior, NOT mainline AND NOT is_link AND stays_within AS controlled_ok FROM flags JOIN cls USING (edge_id)"),
    "geometric_classes": (_CLASSES, "SELECT edge_id, in_inner, in_second, link, mainline, ring, mismatch, exempt, forbidden, second_main FROM gcls"),
    "geometric_audit": (_CLASSES, "SELECT *, CASE WHEN least(relation_edges,ring_edges,ring_ways,ring_directions)<=0 THEN 'no ring' WHEN mismatches>0 THEN 'relation and class differ' WHEN least(second_edges,second_ways,second_directions)<=0 THEN 'no second mainline' END AS problem FROM (SELECT count(*) FILTER (identity) AS relation_edges, count(*) FILTER (ring) AS ring_edges, count(DISTINCT CASE WHEN ring THEN edge_id//4 END) AS ring_ways, CAST(coalesce(sum(CASE WHEN ring AND car_access THEN CASE WHEN edge_id%5<>0 THEN 2 ELSE 1 END ELSE 0 END),0) AS BIGINT) AS ring_directions, count(*) FILTER (mismatch) AS mismatches, count(*) FILTER (second_main) AS second_edges, count(DISTINCT CASE WHEN second_main THEN edge_id//4 END) AS second_ways, CAST(coalesce(sum(CASE WHEN second_main AND car_access THEN CASE WHEN edge_id%5<>0 THEN 2 ELSE 1 END ELSE 0 END),0) AS BIGINT) AS second_directions, count(*) FILTER (link AND in_second) AS second_links FROM gcls)"),
    "released_phase": (_SIDES, "SELECT edge_id, CASE WHEN zone='INNER' AND mainline THEN false WHEN edge_id%11=0 OR mainline THEN true WHEN is_link THEN zone<>'INNER' ELSE avoids_interior END AS released_ok FROM flags JOIN cls USING (edge_id)"),
    "edge_side_intervals": (_SIDES, 'SELECT edge_id, CAST(k AS INTEGER) AS k, round(f,7)+0.0 AS start, round(g,7) AS stop, side FROM sides'),
    "directed_portals": (_SIDES, "SELECT key, direction, kind, round(fraction,7)+0.0 AS fraction FROM dirp"),
    "portal_audit": (_SIDES, "SELECT (SELECT count(*) FROM (SELECT edge_id FROM sides GROUP BY 1 HAVING count(*)>1 OR bool_or(side='BOUNDARY'))) AS intersecting, (SELECT count(DISTINCT edge_id) FROM sides WHERE side='BOUNDARY') AS overlapping, (SELECT count(*) FROM (SELECT key, direction FROM dirp GROUP BY 1,2 HAVING count(*)>1)) AS ambiguous, (SELECT count(*) FROM (SELECT DISTINCT CAST(round((ulng+(vlng-ulng)*(CASE WHEN key%2=1 THEN 1-fraction ELSE fraction END))*1e8) AS BIGINT), CAST(round((ulat+(vlat-ulat)*(CASE WHEN key%2=1 THEN 1-fraction ELSE fraction END))*1e8) AS BIGINT) FROM dirp JOIN edges USING (edge_id))) AS crossings, (SELECT count(*) FROM dirp WHERE direction='OUT') AS outbound, (SELECT count(*) FROM dirp WHERE direction='IN') AS inbound"),
    "border_release_points": ("", "SELECT portal_id, direction FROM portal p WHERE road_class<>'motorway' AND NOT is_link AND (direction='OUT' OR NOT EXISTS (SELECT 1 FROM (SELECT *, greatest(0.0::DOUBLE,least(1.0::DOUBLE,((p.lng-ax)*(bx-ax)+(p.lat-ay)*(y2-ay))/((bx-ax)*(bx-ax)+(y2-ay)*(y2-ay)))) AS t FROM segs WHERE ring=0 AND seq=1) s WHERE sqrt(pow(p.lng-(ax+(bx-ax)*t),2)+pow(p.lat-(ay+(y2-ay)*t),2))<=60.0::DOUBLE/111320))"),
    "connector_exits": (", lnk AS (SELECT u, v, len_mm FROM edges WHERE is_link UNION ALL SELECT v, u, len_mm FROM edges WHERE is_link), od(node, d) USING KEY (node) AS (SELECT DISTINCT u, 0::BIGINT FROM lnk JOIN nodes ON node=u AND gx>=30 UNION SELECT l.v, min(o.d+l.len_mm) FROM od o JOIN lnk l ON l.u=o.node LEFT JOIN recurring.od r ON r.node=l.v WHERE r.node IS NULL OR o.d+l.len_mm<r.d GROUP BY 1) ", "SELECT edge_id, CASE WHEN b<a THEN 2*edge_id ELSE 2*edge_id+1 END AS key FROM (SELECT edge_id, coalesce(x.d,9223372036854775807) AS a, coalesce(y.d,9223372036854775807) AS b FROM edges e LEFT JOIN od x ON x.node=e.u LEFT JOIN od y ON y.node=e.v WHERE is_link) WHERE a<>b"),
    "outer_walk_hops": (_WALK, "SELECT portal_id, hop, edge_id, CAST(k AS INTEGER) AS k, round(along,4) AS along_m, clearance FROM walked"),
    "toll_entries": (_TOLL, "SELECT request, key, dist_mm FROM ent"),
    "toll_exits": (_TOLL, "SELECT request, dist_mm FROM ext"),
    "toll_audit": (_TOLL, "SELECT (SELECT count(*) FROM supplier) AS source, count(*) AS mapped, count(*) FILTER (a) AS entry, count(*) FILTER (b) AS exit, count(*) FILTER (a OR b) AS related, count(*) FILTER (a<>b) AS unresolved FROM (SELECT request, request IN (SELECT request FROM ent) AS a, request IN (SELECT request FROM ext) AS b FROM booth)"),
    "toll_corridor_keys": (_TOLL_KEYS, "SELECT role, key FROM tollk"),
    "interchanges": (_LINKS, "SELECT from_edge, array_to_string(path,'-') AS path, to_edge, dist_mm, overlap AS toll_overlap FROM ich WHERE NOT toll"),
    "interchange_audit": (_LINKS, "SELECT * FROM (SELECT count(*) AS components, count(*) FILTER (mains>=1) AS touching, count(*) FILTER (mains>=2) AS candidates, count(*) FILTER (mains>=2 AND NOT solved) AS unresolved FROM mt), (SELECT count(*) AS drives, count(*) FILTER (toll) AS excluded_nodes, count(*) FILTER (NOT toll AND overlap) AS excluded_keys, count(*) FILTER (NOT toll AND NOT overlap) AS kept, count(DISTINCT CASE WHEN NOT toll AND NOT overlap THEN (least(from_edge,to_edge),greatest(from_edge,to_edge)) END) AS pairs, coalesce(max(dist_mm) FILTER (NOT toll AND NOT overlap),0) AS longest_mm FROM ich)"),
    "merged_border": (_SQUARES, "SELECT 116000000000+x*10000000 AS x1, 39600000000+y*10000000 AS y1, 116000000000+x2*10000000 AS x2, 39600000000+y2*10000000 AS y2 FROM stq"),
    "merged_rings": (_SQUARES, "SELECT round(116.0::DOUBLE+min(x)*0.01::DOUBLE,6) AS lng, round(39.6::DOUBLE+arg_min(y,(x,y))*0.01::DOUBLE,6) AS lat, count(*) AS points, round(sum(x*y2-x2*y)/2*0.0001::DOUBLE,9) AS area FROM stq JOIN rng USING (h) GROUP BY ring"),
    "split_edges": (_NEAREST + ", cutat AS (SELECT point_id, k.key, k.from_node, k.to_node, k.len_mm, CAST(floor(k.len_mm*CASE WHEN key%2=1 THEN 1-fraction ELSE fraction END) AS BIGINT) AS first FROM (SELECT n.point_id, n.edge_id, round(greatest(0.0::DOUBLE,least(1.0::DOUBLE,((p.lng-ulng)*(vlng-ulng)+(p.lat-ulat)*(vlat-ulat))/((vlng-ulng)*(vlng-ulng)+(vlat-ulat)*(vlat-ulat)))),9) AS fraction FROM nearest n JOIN pts p USING (point_id) JOIN edges e ON e.edge_id=n.edge_id) s JOIN ekeys k USING (edge_id)) ", "SELECT point_id, key AS orig_key, 1 AS part, from_node, -1-point_id AS to_node, first AS len_mm FROM cutat UNION ALL SELECT point_id, key, 2, -1-point_id, to_node, len_mm-first FROM cutat"),
    "link_chains": (", lr AS (SELECT r.route_id, r.run, r.edge_key, e.is_link FROM runs r JOIN edges e ON e.edge_id=r.edge_key//2), lc AS (SELECT *, lag(edge_key) OVER w AS prev_key, lead(edge_key) OVER w AS next_key, sum(CASE WHEN is_link AND NOT before THEN 1 ELSE 0 END) OVER w AS chain FROM (SELECT *, coalesce(lag(is_link) OVER (PARTITION BY route_id ORDER BY run),false) AS before FROM lr) WINDOW w AS (PARTITION BY route_id ORDER BY run)) ", "SELECT route_id, CAST(min(run) AS BIGINT) AS first_run, CAST(max(run) AS BIGINT) AS last_run, first(prev_key ORDER BY run) AS prev_key, first(next_key ORDER BY run DESC) AS next_key FROM lc WHERE is_link GROUP BY route_id, chain"),
    "turn_costs": ("", "SELECT a.key, b.key AS next_key, CASE WHEN a.edge_id%19<>3 AND b.edge_id%19=3 THEN 1000000000::BIGINT ELSE 0::BIGINT END AS seconds FROM ekeys a JOIN ekeys b ON b.from_node=a.to_node WHERE a.edge_id<>b.edge_id AND NOT EXISTS (SELECT 1 FROM turns t WHERE t.from_edge=a.edge_id AND t.via_node=a.to_node AND t.to_edge=b.edge_id)"),
    "search_audit": ("", "SELECT q.request, count(s.key) AS settled, CAST(coalesce(sum(c.checks),0) AS BIGINT) AS checks, CAST(coalesce(sum(c.banned),0) AS BIGINT) AS banned, CAST(coalesce(sum(c.blocked),0) AS BIGINT) AS blocked, CASE WHEN any_value(q.most) IS NOT NULL AND any_value(q.far)>any_value(q.most) THEN 'TOLERANCE_SETTLED' ELSE 'EXHAUSTED' END AS outcome FROM (SELECT request, max(dist_mm) AS far, any_value(g.best)+5000000 AS most FROM lsp LEFT JOIN (SELECT request, min(dist_mm) AS best FROM goals GROUP BY 1) g USING (request) GROUP BY 1) q JOIN lsp s ON s.request=q.request AND (q.most IS NULL OR s.dist_mm<=q.most) LEFT JOIN (SELECT a.key, count(*) AS checks, count(*) FILTER (t.from_edge IS NOT NULL) AS banned, count(*) FILTER (t.from_edge IS NULL AND b.edge_id IN (SELECT edge_id FROM blk)) AS blocked FROM ekeys a JOIN ekeys b ON b.from_node=a.to_node LEFT JOIN turns t ON t.from_edge=a.edge_id AND t.via_node=a.to_node AND t.to_edge=b.edge_id WHERE a.edge_id NOT IN (SELECT edge_id FROM blk) GROUP BY 1) c ON c.key=s.key GROUP BY q.request"),
    "tier_choice": ("", f"SELECT request, target, tier FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY CASE WHEN score<=60 THEN 0 ELSE 1 END, CASE WHEN score<=60 THEN tier ELSE 0 END, score, dist_mm, target) AS k FROM (SELECT t.request, t.target, t.dist_mm, t.tier, round({delta('a', 'b')},6) AS score FROM (SELECT t.*, {brg('n.lng', 'n.lat', 'p.lng', 'p.lat')} AS a, {brg('n.lng', 'n.lat', '116.35::DOUBLE', '39.95::DOUBLE')} AS b FROM tiers t JOIN (SELECT portal_id, any_value(lng) AS lng, any_value(lat) AS lat FROM portal GROUP BY 1) p ON p.portal_id=t.target JOIN nodes n ON n.node=t.request) t)) WHERE k=1"),
    "first_alternatives": ("", "SELECT request, route, dist_m, CAST(place AS INTEGER) AS place FROM (SELECT o_custkey AS request, o_orderkey AS route, CAST(floor(o_totalprice) AS BIGINT) AS dist_m, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice), o_orderkey) AS place FROM orders) WHERE place<=3"),
    "text_forms": ("", f"SELECT p_partkey, CASE WHEN m<1000 THEN CAST(CAST(floor(m+0.5) AS BIGINT) AS VARCHAR)||' 米' WHEN m/1000<10 THEN printf('%.1f', CASE WHEN m/250=floor(m/250) AND CAST(floor(m/250) AS BIGINT)%2=1 THEN floor(m/100+0.5)/10 ELSE m/1000 END)||' 公里' ELSE CAST(CAST(floor(m/1000+0.5) AS BIGINT) AS VARCHAR)||' 公里' END AS distance, CASE WHEN q<60 THEN CAST(q AS VARCHAR)||' 分钟' WHEN q%60=0 THEN CAST(q//60 AS VARCHAR)||' 小时' ELSE CAST(q//60 AS VARCHAR)||' 小时 '||CAST(q%60 AS VARCHAR)||' 分钟' END AS duration, CASE WHEN contains(p_brand||' A', p_type) THEN p_brand||' A' WHEN contains(p_type, p_brand||' A') THEN p_type ELSE p_brand||' A'||p_type END AS described, CASE p_partkey%8 {_codes} ELSE 'NO_COMPLIANT_ROUTE' END AS code FROM (SELECT *, p_partkey*7.5::DOUBLE AS m, greatest(1,CAST(floor(p_partkey*31.0::DOUBLE/60+0.5) AS BIGINT)) AS q FROM part)"),
    "edge_projections": ("", f"SELECT point_id, edge_id, round(t,7)+0.0 AS share, round(x,7) AS end_lng, round(y,7) AS end_lat, round({hav('ulng', 'ulat', 'x', 'y')},3) AS metres FROM (SELECT *, ulng+(vlng-ulng)*t AS x, ulat+(vlat-ulat)*t AS y FROM (SELECT p.point_id, e.edge_id, p.lng, p.lat, ulng, ulat, vlng, vlat, greatest(0.0::DOUBLE,least(1.0::DOUBLE,((lng-ulng)*(vlng-ulng)+(lat-ulat)*(vlat-ulat))/((vlng-ulng)*(vlng-ulng)+(vlat-ulat)*(vlat-ulat)))) AS t FROM pts p JOIN edges e ON p.lng BETWEEN ulng-0.001 AND vlng+0.001 AND p.lat BETWEEN ulat-0.001 AND vlat+0.001)) WHERE {hav('lng', 'lat', 'x', 'y')}<=2"),
    "trace_lines": ("", f"SELECT route_id, round(sum(s),3) AS metres, CAST(1+count(*) FILTER (s>0)+CASE WHEN any_value(ends) THEN 0 ELSE 1 END+count(*) FILTER (s>0) AS INTEGER) AS joined, round(min(lng),7) AS min_lng, round(max(lng),7) AS max_lng, round(min(lat),7) AS min_lat, round(max(lat),7) AS max_lat, round(arg_max(lng,seq),7) AS last_lng FROM (SELECT *, false AS ends, coalesce(CASE WHEN plng IS NULL THEN NULL ELSE {hav('plng', 'plat', 'lng', 'lat')} END,0) AS s FROM (SELECT *, lag(lng) OVER w AS plng, lag(lat) OVER w AS plat FROM tr WINDOW w AS (PARTITION BY route_id ORDER BY seq))) GROUP BY 1"),
    "bbox_shifted": ("", f"SELECT point_id, round(x,7) AS lng, round(y,7) AS lat FROM (SELECT point_id, lng+({_fx}) AS x, lat+({_fy}) AS y FROM pts) WHERE x BETWEEN 116.05::DOUBLE AND 116.15::DOUBLE AND y BETWEEN 39.65::DOUBLE AND 39.75::DOUBLE"),
    "control_area": ("", f"SELECT ring, seq, round(ax+({_ax}),7) AS lng, round(ay+({_ay}),7) AS lat FROM segs"),
    "response_checks": ("", "SELECT response_id, violation FROM (SELECT k AS response_id, CASE WHEN mode='EXTERNAL_ONLY' AND inside THEN 'external route with an inside leg' WHEN mode='EXTERNAL_ONLY' AND reference THEN 'external route with a reference' WHEN mode<>'EXTERNAL_ONLY' AND NOT inside THEN 'no inside leg' WHEN crossing AND NOT handover THEN 'no handover' WHEN NOT crossing AND handover THEN 'handover without a crossing' WHEN crossing AND radius<>floor(least(200.0,greatest(0.0,clearance-25))) THEN 'radius does not follow from the clearance' WHEN n_points<2 THEN 'line too short' END AS violation FROM (SELECT o_orderkey AS k, ['INTERNAL','EXTERNAL_ONLY','OUTBOUND','INBOUND'][o_orderkey%4+1] AS mode, o_orderkey%4>=2 AS crossing, o_orderkey%3<>0 AS inside, o_orderkey%5=0 AS reference, o_orderkey%7<>0 AS handover, o_orderkey%250 AS clearance, o_orderkey%9*25 AS radius, o_orderkey%4+2 AS n_points FROM orders)) WHERE violation IS NOT NULL"),
    "routing_modes": ("", "SELECT a.id AS node, CASE WHEN a.location='BOUNDARY' OR b.location='BOUNDARY' THEN 'AMBIGUOUS' WHEN a.location='INSIDE' AND b.location='INSIDE' THEN 'INTERNAL' WHEN a.location='OUTSIDE' AND b.location='OUTSIDE' THEN 'EXTERNAL' WHEN a.location='INSIDE' THEN 'OUTBOUND' ELSE 'INBOUND' END AS mode FROM loc a JOIN loc b ON a.kind='n' AND b.kind='n' AND a.id=b.id+37"),
    "through_corridors": ("", "SELECT n.node, a.key AS entry_id, b.key AS exit_id FROM (SELECT DISTINCT s_suppkey*7 AS node FROM supplier JOIN nodes ON node=s_suppkey*7) n JOIN ekeys a ON a.to_node=n.node JOIN ekeys b ON b.from_node=n.node WHERE NOT EXISTS (SELECT 1 FROM turns t WHERE t.from_edge=a.edge_id AND t.via_node=n.node AND t.to_edge=b.edge_id)"),
    "reference_spots": ("", "SELECT route_id, along_m, clearance FROM (SELECT l_orderkey AS route_id, CAST(l_linenumber AS DOUBLE) AS along_m, l_quantity*8 AS clearance, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_quantity*8>=250 THEN 0 ELSE 1 END, CASE WHEN l_quantity*8>=250 THEN 0 ELSE -l_quantity END, l_linenumber, l_quantity) AS k FROM lineitem) WHERE k=1"),
    "closest_spots": ("", "SELECT route_id, along_m FROM (SELECT l_orderkey AS route_id, l_quantity*10+l_linenumber AS along_m, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(l_quantity*10+l_linenumber-300), l_quantity*10+l_linenumber) AS k FROM lineitem) WHERE k=1"),
    "moved_views": ("", "SELECT session, seq FROM (SELECT *, lag(zoom) OVER w AS z, lag(lng) OVER w AS x, lag(lat) OVER w AS y FROM (SELECT user_id AS session, event_id AS seq, event_id%3 AS zoom, value/1000 AS lng, event_id%100/100 AS lat FROM events) WINDOW w AS (PARTITION BY session ORDER BY seq)) WHERE z IS NULL OR coalesce(zoom<>z OR abs(lng-x)>0.08::DOUBLE OR abs(lat-y)>0.08::DOUBLE, true)"),
    "trace_phases": (", ph AS (SELECT r.route_id, r.run, c.mainline, c.zone='INNER' AS inside, c.edge_id%29=0 AS released FROM runs r JOIN cls c ON c.edge_id=r.edge_key//2) ", "SELECT route_id, CAST(run AS BIGINT) AS run FROM (SELECT p.*, coalesce(run>=f.first,false) AS after FROM ph p LEFT JOIN (SELECT route_id, min(run) AS first FROM ph WHERE released GROUP BY 1) f USING (route_id)) WHERE CASE WHEN after THEN inside AND mainline ELSE mainline OR NOT inside END"),
    "latest_updates": ("", "SELECT user_id, max(event_id) AS sequence, arg_max(value, event_id) AS accuracy, arg_max(coalesce(value<=150 AND ts>=(SELECT max(ts) FROM events)-INTERVAL 30 SECOND, false), event_id) AS usable FROM (SELECT user_id, event_id, coalesce(value, NULL) AS value, ts FROM events) GROUP BY 1"),
    "legal_turn_count": ("", "SELECT count(*) AS turns, CAST(sum(next_mm) AS BIGINT) AS total_mm FROM ladj"),
    "anchored_paths": (", first AS (SELECT from_node AS request, min(key) AS first_key FROM ekeys WHERE from_node%50=0 GROUP BY 1), ap(request, key, d) USING KEY (request, key) AS (SELECT f.request, k.key, k.len_mm FROM first f JOIN ekeys k ON k.key=f.first_key UNION SELECT s.request, a.next_key, min(s.d+a.next_mm) FROM ap s JOIN adj a ON a.key=s.key LEFT JOIN recurring.ap r ON r.request=s.request AND r.key=a.next_key WHERE r.key IS NULL OR s.d+a.next_mm<r.d GROUP BY 1,2) ", "SELECT a.request, a.d AS dist_mm FROM ap a JOIN (SELECT from_node+25 AS request, max(key) AS last_key FROM ekeys GROUP BY 1) w ON w.request=a.request AND w.last_key=a.key"),
}


def oracle_sql() -> dict[str, str]:
    return {name: BASE + more + sql for name, (more, sql) in _QUERIES.items()}
