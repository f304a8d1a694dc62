"""The SQL of the training-data queries against the queries, at the smallest scale."""

import duckdb
import pytest

from quillmesh.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    wanted = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == sorted(map(repr, wanted))
