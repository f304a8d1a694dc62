"""The registered source: the listing contract, pruned partitions, streams that go on from their offset."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan

from quillmesh.sources import datasource as D
from quillmesh.sources.provider import TableSource
from quillmesh.streaming.ingest import VersionedTable, merge_batches

DAY = 86_400_000
SCHEMA = "account string, gmail_message_id string, internal_date long, from_addr string, labels array<string>, body_state string, body_text string, direction string"
ROWS = [("ab"[i % 2], f"m{i:02}", i * 10 * DAY if i % 7 else None, f"N{i} <p{i % 3}@x.org>", ["INBOX"] if i % 3 else ["SENT"], "meta", None, "received") for i in range(20)]


@pytest.fixture()
def archive(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/mail")
    merge_batches(table)(spark.createDataFrame(ROWS, SCHEMA), 0)
    D.register(spark)
    return table


def load(spark, table, **options):
    return spark.read.format(D.FORMAT).option("path", table.path).options(**options).load()


def test_a_read_is_the_table(spark, archive):
    got = load(spark, archive)
    assert sorted(map(tuple, got.select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect())) == sorted(ROWS)
    assert load(spark, archive, columns="gmail_message_id, internal_date").columns == ["gmail_message_id", "internal_date"]
    nothing = got.where(F.col("internal_date") > 10**15)
    assert nothing.count() == 0 and got.where("internal_date IS NULL").count() == 3


@pytest.mark.parametrize("test", ["internal_date >= 864000000 AND internal_date < 4320000000", "account = 'a'", "gmail_message_id IN ('m03', 'm04', 'zz')", "internal_date = 864000000 OR account = 'b'", "NOT internal_date > 864000000", "internal_date IN (864000000, 1728000000)", "internal_date <= 0 AND direction = 'received'"])
def test_filters_give_what_they_give_on_the_table(spark, archive, test):
    assert sorted(r[0] for r in load(spark, archive).where(test).select("gmail_message_id").collect()) == sorted(r[0] for r in spark.createDataFrame(ROWS, SCHEMA).where(test).select("gmail_message_id").collect())


def test_the_date_prunes_partitions(spark, archive):
    reader = D.MailReader(load(spark, archive).schema, {"path": archive.path})
    every = {p.path.split("__month=")[1][:7].rstrip("/") for p in reader.partitions()}
    kept = list(reader.pushFilters([IsNotNull((D.DATE,)), GreaterThanOrEqual((D.DATE,), 40 * DAY), LessThan((D.DATE,), 80 * DAY)]))
    assert len(kept) == 3
    assert {p.path.split("__month=")[1][:7] for p in reader.partitions()} == {"1970-02", "1970-03"} < every
    assert all(p.tests == [(D.DATE, ">=", 40 * DAY), (D.DATE, "<", 80 * DAY)] for p in reader.partitions())
    list(reader.pushFilters([In((D.DATE,), (40 * DAY, None))]))
    assert {p.path.split("__month=")[1][:7] for p in reader.partitions()} == {"1970-02"}
    list(reader.pushFilters([EqualTo(("subject",), "x")]))
    assert reader.tests == []
    assert load(spark, archive).where(f"internal_date < {40 * DAY}").rdd.getNumPartitions() < load(spark, archive).rdd.getNumPartitions()


@pytest.mark.parametrize("ms", [0, 31 * DAY - 1, 31 * DAY, 59 * DAY])
def test_months_hold_their_own_milliseconds(ms):
    month = dt.datetime.fromtimestamp(ms / 1000, dt.UTC).strftime("%Y-%m")
    low, high = D.month_bounds(month)
    assert low <= ms < high and D.month_bounds("none") is None
    for op in ("==", ">=", "<="):
        assert D.may_hold(month, [(D.DATE, op, ms)])
    assert not D.may_hold("none", [(D.DATE, "==", ms)]) and D.may_hold("none", [("account", "==", "a")]) and not D.may_hold(month, [(D.DATE, ">", high - 1)]) and not D.may_hold(month, [(D.DATE, "<", low)])


def test_the_listing_contract_over_the_source(spark, archive):
    """Newest first, within a scope; metadata in the order asked for, without bodies and unknown ids; whole messages or none."""
    source = TableSource(load(spark, archive), "me@x.org", 200 * DAY)
    ids = [r["gmail_message_id"] for r in source.list_ids("in:inbox").collect()]
    dated = {r[1]: r[2] for r in ROWS if "INBOX" in r[4]}
    assert ids == sorted(dated, key=lambda k: (-(dated[k] if dated[k] is not None else -1), k))
    wanted = spark.createDataFrame([("m05", 1), ("nope", 2), ("m01", 3)], "gmail_message_id string, position int")
    meta = source.metadata(wanted)
    assert [r["gmail_message_id"] for r in meta.collect()] == ["m05", "m01"] and "body_text" not in meta.columns
    assert source.full("m05")["account"] == "b" and source.full("nope") is None


def test_versions_and_missing_archives(spark, archive, tmp_path):
    merge_batches(archive)(spark.createDataFrame([("a", "new", 5 * DAY, None, [], "meta", None, "sent")], SCHEMA).withColumn("added", F.lit(1)), 1)
    assert load(spark, archive).count() == 21 and load(spark, archive, version="1").count() == 20
    with pytest.raises(Exception, match="no version 9"):
        load(spark, archive, version="9").count()
    with pytest.raises(Exception, match="no archive"):
        spark.read.format(D.FORMAT).option("path", f"file://{tmp_path}/none").load().count()


def test_a_stream_goes_on_from_its_offset(spark, archive, tmp_path):
    seen = []

    def run():
        before = len(seen)
        keep = lambda batch, _: seen.append(sorted(r[0] for r in batch.select("gmail_message_id").collect()))
        spark.readStream.format(D.FORMAT).option("path", archive.path).load().writeStream.foreachBatch(keep).option("checkpointLocation", f"file://{tmp_path}/ck").trigger(once=True).start().awaitTermination(120)
        return sorted(x for batch in seen[before:] for x in batch)

    assert run() == sorted(r[1] for r in ROWS)
    assert run() == []
    merge_batches(archive)(spark.createDataFrame([("a", "new", 5 * DAY, None, [], "meta", None, "sent")], SCHEMA), 1)
    assert run() == ["m01", "m02", "m03", "new"]  # January, which was written again
    assert run() == []
