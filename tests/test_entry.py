"""The driver's contract: queries and SQL agree at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from quillmesh.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL_QUERIES = sorted(registry.ORACLE_SQL)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def normal(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("name", SQL_QUERIES)
def test_query_equals_its_sql(spark, db, name):
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    wanted = db.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert normal(tuple(r) for r in got.select(*columns).collect()) == normal(wanted)


def test_every_oracle_has_its_query(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_search_messages_indexes_whole_bodies(spark, monkeypatch):
    """A word after character 200 of a full message is found."""
    from quillmesh.plans import registry

    row = ("m", "a", "x@y.z", "me@y.z", None, "s" * 200, "s" * 200 + " invoice", None)
    one = spark.createDataFrame([row, ("n", "b", "x@y.z", "me@y.z", None, "other", None, None)], "gmail_message_id string, subject string, from_addr string, to_addr string, cc_addr string, snippet string, body_text string, summary_text string")
    monkeypatch.setattr(registry, "mailbox", lambda *_: one)
    assert [r["docid"] for r in registry.search_messages(spark, "").collect()] == ["m"]
