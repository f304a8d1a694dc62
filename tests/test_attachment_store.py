"""The attachment store: contents once, keys by batch, replays, runs that broke off."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillmesh.sources.attachment_store import AttachmentStore, import_attachments
from quillmesh.streaming.kept_feed import KeptFeed

STORABLE = "id string, attachment_id string, filename string, mime_type string, size_bytes long, status string, stored_name string, storage_key string, content binary, extra string"


def storable(spark, rows):
    """(id, content, status): a row of payload.storable each; the key follows from the id."""
    made = [(i, "p", "f.txt", "text/plain", len(c or b""), s, "f.txt", f"crm/a/{i}/p-f.txt" if s == "stored" and i else None, c if s == "stored" else None, "x") for i, c, s in rows]
    return spark.createDataFrame(made, STORABLE)


@pytest.fixture
def store(spark, tmp_path):
    return AttachmentStore(spark, str(tmp_path / "store"))


def held(store):
    return {r["storage_key"]: (bytes(r["content"]), r["object_batch"]) for r in store.read().collect()}


def test_contents_are_kept_once_and_read_back(spark, store):
    logo, long = b"\x00\xff logo", bytes(range(256)) * 5000
    first = storable(spark, [(f"m{i}", logo, "stored") for i in range(50)] + [("long", long, "stored"), ("exe", b"x", "rejected_by_policy"), ("gone", None, "unavailable"), (None, b"no key", "stored"), ("m0", logo, "stored")])
    assert store.put(first, "a", "1") and not store.put(first, "a", "1")
    assert store.put(storable(spark, [("n", logo, "stored"), ("new", b"new", "stored")]), "a", "2")
    assert store.objects().groupBy("digest").count().where("count > 1").isEmpty() and store.objects().count() == 3
    got = held(store)
    assert len(got) == 53 and got["crm/a/long/p-f.txt"] == (long, "1") and got["crm/a/n/p-f.txt"] == (logo, "1") and got["crm/a/new/p-f.txt"] == (b"new", "2")
    assert store.content("crm/a/long/p-f.txt") == long and store.content("crm/a/exe/p-f.txt") is None
    assert [bytes(r["content"]) for r in store.read(spark.createDataFrame([("crm/a/new/p-f.txt",), ("other",)], "storage_key string")).collect()] == [b"new"]
    assert store.damaged().isEmpty()
    plan = store.of_digest(hashlib.sha256(long).hexdigest())._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and "EqualTo(digest," in plan


def test_the_last_batch_of_a_key_counts(spark, store):
    store.put(storable(spark, [("m", b"old", "stored"), ("m", b"older", "stored")]), "a", "1")
    assert held(store)["crm/a/m/p-f.txt"][0] == max((b"old", b"older"), key=lambda x: hashlib.sha256(x).hexdigest())
    store.put(storable(spark, [("m", b"newer", "stored")]), "a", "2")
    assert held(store) == {"crm/a/m/p-f.txt": (b"newer", "2")}
    store.put(storable(spark, []), "a", "3")
    assert store.batches() == ["1", "2", "3"] and len(held(store)) == 1


def test_a_run_that_broke_off_is_made_good(spark, store, tmp_path):
    rows = storable(spark, [("m", b"one", "stored"), ("n", b"two", "stored"), ("exe", b"x", "rejected_by_policy"), ("gone", None, "unavailable")])
    left = rows.where("status = 'stored'").select(F.sha2("content", 256).alias("digest"), F.lit(3).cast("long").alias("size_bytes"), "content", F.lit("00").alias("shard"))
    left.write.partitionBy("shard").parquet(f"{store.path}/objects/1")  # contents without a manifest, in a shard that is not theirs
    assert store.batches() == [] and store.objects().isEmpty() and store.read().isEmpty()
    feed = KeptFeed(spark, str(tmp_path / "feed"))
    store.put(rows, "a", "1")  # as a run does that breaks off before its events
    for _ in range(2):
        assert import_attachments(store, feed, rows, "a", "1") == {"stored": 2, "skipped": 2, "last": 3}
    assert store.objects().count() == 2 and store.objects().where("shard <> left(digest, 2)").isEmpty() and feed.read().count() == 3
    named = feed.read().select(F.get_json_object("payload", "$.storageKey").alias("storage_key")).where("storage_key IS NOT NULL")
    assert named.join(store.manifest(), "storage_key").count() == 2
