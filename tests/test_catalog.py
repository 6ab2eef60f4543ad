"""Every catalog query against its SQL, run by DuckDB over the same tables."""

import os

import duckdb
import pytest

from wayfold.plans import oracle, oracle_builds
from wayfold.plans.catalog_builds import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


def oracle_sql():
    return oracle.oracle_sql() | oracle_builds.oracle_sql()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(r[i], 9) + 0.0 if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = canonical([tuple(r) for r in df.collect()], df.columns)
    duck.execute(oracle_sql()[name])
    assert canonical(duck.fetchall(), [c[0] for c in duck.description]) == found


def test_every_query_but_the_fold_has_sql():
    assert set(QUERIES) - set(oracle_sql()) == {"route_dedup"}


def test_route_dedup_keeps_the_first_of_alike_routes(spark):
    orders = duckdb.connect().execute(f"select o_custkey, o_orderkey, floor(o_totalprice/2000) from '{SF}/orders.parquet' order by 2").fetchall()
    kept = {}
    for request, k, dist in orders:
        own = (dist // 200, (k % 3) * 0.00008, (k % 2) * 0.00008)
        if not any(o[0] == own[0] and abs(o[1] - own[1]) <= 1e-4 and abs(o[2] - own[2]) <= 1e-4 for o, _ in kept.get(request, [])):
            kept.setdefault(request, []).append((own, k))
    expected = {(r, k) for r, v in kept.items() for _, k in v}
    assert {tuple(r) for r in QUERIES["route_dedup"](spark, SF).collect()} == expected


def test_timed_paths_over_more_than_a_day(spark, tmp_path):
    """Times of over 10^8 ms don't run over into the distance that the SQL keeps beside them."""
    con = duckdb.connect()
    con.execute(f"copy (select 40*r+c as p_partkey from range(1500) a(r), range(4) b(c)) to '{tmp_path}/part.parquet' (format parquet)")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{tmp_path if t == 'part' else SF}/{t}.parquet'")
    df = QUERIES["timed_paths"](spark, str(tmp_path))
    found = canonical([tuple(r) for r in df.collect()], df.columns)
    assert max(r[df.columns.index("ms")] for r in df.collect()) > 10**8
    con.execute(oracle_sql()["timed_paths"])
    assert canonical(con.fetchall(), [c[0] for c in con.description]) == found


def test_points_within_radius_starts_from_every_node(spark):
    near = {(r["node"], r["point_id"]) for r in QUERIES["points_within_radius"](spark, SF).collect()}
    con = duckdb.connect()
    for t in ("part", "customer"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    # by the same sphere, without cells
    far = "2*6371008.8*asin(sqrt(least(1, pow(sin(radians(p.lat-n.lat)/2),2)+cos(radians(n.lat))*cos(radians(p.lat))*pow(sin(radians(p.lng-n.lng)/2),2))))"
    rows = con.execute(f"select n.node, p.id, {far} from (select p_partkey as node, 116+(p_partkey%40)*0.01 as lng, 39.6+(p_partkey//40)*0.01 as lat from part) n, (select c_custkey as id, 116+(c_custkey*37%1000)*0.0004 as lng, 39.6+(c_custkey*91%1000)*0.0005 as lat from customer) p").fetchall()
    assert {(n, p) for n, p, d in rows if d <= 1990} <= near <= {(n, p) for n, p, d in rows if d <= 2010}
    assert any(n % 50 for n, _ in near)


@pytest.mark.parametrize("name", ["bbox_limit_guard", "bbox_shifted"])
def test_boxes_of_more_points_than_one_answer_holds(spark, tmp_path, name):
    """6,000 points at one place of the box: no box is small enough to hold fewer."""
    k = QUERIES[name](spark, "/root/testdata/sf0.1").first()["point_id"] % 1000
    duckdb.connect().execute(f"copy (select {k}+1000*i as c_custkey from range(6000) r(i)) to '{tmp_path}/customer.parquet' (format parquet)")
    rows = QUERIES[name](spark, str(tmp_path)).collect()
    assert {r["point_id"] for r in rows} == {k + 1000 * i for i in range(6000)} and len(rows) == 6000
