"""The kept feed: numbers, pages that read their files, streams whose replays and late rows add nothing."""

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import feed
from quillmesh.streaming import kept_feed as K
from quillmesh.streaming.kept_feed import EVENT, KeptFeed


def events(spark, rows):
    """(account, key, dedupe_key, occurred_at) each."""
    return spark.createDataFrame([(a, "message", k, "upsert", None, "{}", d, t) for a, k, d, t in rows], EVENT)


def listed(rows):
    return [(r["sequence"], r["entity_key"]) for r in rows.orderBy("sequence").collect()]


def test_numbers_follow_the_order_and_batches(spark, tmp_path):
    kept = KeptFeed(spark, f"file://{tmp_path}/feed", rows_per_file=2)
    assert kept.last() == 0 and kept.page().count() == 0 and kept.read().count() == 0
    first = events(spark, [("a", "m3", "3", 30), ("b", "m1", "1", 10), ("a", "m2", "2", 20), ("a", "m2", "2", 20), ("a", "u2", None, None), ("a", "u1", None, None), ("a", "u1", None, None)])
    assert kept.append(first, "one") == 6
    assert listed(kept.read()) == [(1, "u1"), (2, "u1"), (3, "u2"), (4, "m1"), (5, "m2"), (6, "m3")]
    assert kept.append(first, "one") == 6  # a replay
    assert kept.append(events(spark, [("a", "m2", "2", 1), ("a", "m0", "0", 0)])) == 7  # a known key, and one that is late
    assert kept.append(events(spark, [])) == 7
    assert listed(kept.read())[-1] == (7, "m0")
    assert kept.index().groupBy("file").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] <= 2


def test_equal_to_the_feed_of_one_table(spark, tmp_path):
    rows = events(spark, [("ab"[i % 2], f"m{i:03}", f"d{i % 70}", (i * 7) % 50 if i % 5 else None) for i in range(100)])
    kept = KeptFeed(spark, f"file://{tmp_path}/feed", rows_per_file=9)
    kept.append(rows)
    whole = feed.append(rows.limit(0).withColumn("sequence", F.lit(0).cast("long")), rows)
    assert listed(kept.read()) == listed(whole)


@pytest.mark.parametrize("accounts", [None, ["a"], ["b", "c"], ["zz"]])
def test_pages_are_whole_and_read_only_their_files(spark, tmp_path, accounts):
    kept = KeptFeed(spark, f"file://{tmp_path}/feed", rows_per_file=5)
    kept.append(events(spark, [("abbb"[i % 4], f"m{i:03}", f"d{i}", i) for i in range(40)]))
    kept.append(events(spark, [("c", f"n{i:03}", f"e{i}", i) for i in range(10)]))
    wanted = [e for e in listed(kept.read() if accounts is None else kept.read().where(F.col("account").isin(accounts)))]
    got, cursor, more = [], None, True
    while more:
        page = kept.read_page(cursor, 7, accounts)
        got += [(e["sequence"], e["entity_key"]) for e in page["events"]]
        cursor, more = page["cursor"], page["has_more"]
    assert got == wanted
    if accounts is None:
        assert len(kept.files_of(12, 3)) <= 2 and len(kept.page(12, 3).inputFiles()) == len(kept.files_of(12, 3))


def test_a_batch_that_broke_off_is_written_again(spark, tmp_path):
    kept = KeptFeed(spark, f"file://{tmp_path}/feed")
    rows = events(spark, [("a", "m1", "1", 1)])
    rows.write.parquet(f"file://{tmp_path}/feed/data/one")  # data, but no index
    assert kept.read().count() == 0 and kept.append(rows, "one") == 1 and listed(kept.read()) == [(1, "m1")]


def test_a_deletion_needs_a_reason(spark, tmp_path):
    bad = events(spark, [("a", "m1", "1", 1)]).withColumn("operation", F.lit("delete"))
    with pytest.raises(Exception, match="needs a reason"):
        KeptFeed(spark, f"file://{tmp_path}/feed").append(bad)


def test_streams_add_a_key_once_over_restarts_and_lost_checkpoints(spark, tmp_path):
    kept, place = KeptFeed(spark, f"file://{tmp_path}/feed"), f"{tmp_path}/in"
    put = lambda rows: events(spark, rows).coalesce(1).write.mode("append").parquet(place)
    run = lambda ck: kept.follow(spark.readStream.schema(EVENT).parquet(place), f"{tmp_path}/{ck}").awaitTermination(180)
    put([("a", "m1", "1", 100), ("a", "m2", "2", 200), ("a", "u", None, 300)])
    run("ck")
    put([("a", "m1", "1", 100), ("a", "m0", "0", 5), ("a", "u", None, 400)])  # one again, one late, one without a key
    run("ck")
    wanted = [(1, "m1"), (2, "m2"), (3, "u"), (4, "m0"), (5, "u")]
    assert listed(kept.read()) == wanted
    (last,) = [b for b in kept.batches() if b.endswith("00000001")]
    kept.append(events(spark, [("a", "m1", "1", 100)]), last)  # the batch is delivered again
    run("ck")
    assert listed(kept.read()) == wanted
    run("fresh")  # another query: keys are compared with the feed, those without one are new
    assert [e for _, e in listed(kept.read())] == ["m1", "m2", "u", "m0", "u", "u", "u"]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != K.STATE_STORE


def test_rules_fire_once_a_message(spark, tmp_path):
    schema = "account string, gmail_message_id string, from_addr string, subject string, snippet string, body_text string, summary_text string, to_addr string, cc_addr string, labels array<string>, category string, is_list boolean, internal_date long"
    message = lambda account, key, sender, subject: (account, key, sender, subject, None, None, None, "me@x.org", None, ["INBOX"], "primary", False, 1)
    contacts = spark.createDataFrame([("a", "x@y.z", 2, "important")], "account string, address string, msgs_sent long, curation string")
    domains = spark.createDataFrame([], "account string, domain string, curation string")
    rules = {
        "known": {"account": "a", "conditions": [("correspondent", True)]},
        "words": {"account": None, "conditions": [("subject_fts", ["refund", "late fee"])]},
        "off": {"account": "a", "conditions": [("is_list", False)], "enabled": False},
    }
    place, kept = f"{tmp_path}/in", KeptFeed(spark, f"file://{tmp_path}/fired")
    put = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(place)

    def run():
        stream = spark.readStream.schema(schema).parquet(place)
        kept.follow(K.firing_events(K.firings(stream, rules, contacts, domains)), f"{tmp_path}/ck").awaitTermination(180)
        return sorted(r["entity_key"] for r in kept.read().collect())

    put(message("a", "1", "X <x@y.z>", "hello"), message("b", "2", "q@y.z", "Refunds for you"), message("a", "3", "q@y.z", "a late, long fee"))
    assert run() == ["known:1", "words:2"]
    put(message("a", "1", "X <x@y.z>", "now a late fee"), message("b", "2", "q@y.z", "refund"), message("a", "4", None, None))
    assert run() == ["known:1", "words:1", "words:2"]
    table = K.firings(spark.read.schema(schema).parquet(place), rules, contacts, domains).distinct()
    assert sorted(map(tuple, table.select("rule", "gmail_message_id").distinct().collect())) == [("known", "1"), ("words", "1"), ("words", "2")]
    assert K.firings(table.withColumn("internal_date", F.lit(0)), {}, contacts, domains).count() == 0
