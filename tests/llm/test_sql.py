"""Queries of the subpackage against their SQL."""

import duckdb
import pytest

from wayfold.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in con.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, con.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*columns).collect())
