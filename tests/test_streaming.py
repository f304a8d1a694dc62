"""Incremental ingest: micro-batches merge, replays change nothing."""

from pyspark.sql import functions as F

from quillmesh.streaming.ingest import VersionedTable, ingest, merge_batches, session_counts, windowed_counts

SCHEMA = "account string, gmail_message_id string, body_state string, body_text string, unread int"


def test_batches_merge_and_replays_are_idempotent(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t")
    assert table.read() is None
    rows = [[("a", "1", "full", "x", 1)], [("a", "1", "meta", None, 0), ("a", "2", "meta", None, 1)]]
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        seen = []
        ingest(stream, table, f"{tmp_path}/ck", lambda new, all_rows: seen.append((new.count(), all_rows.count()))).awaitTermination(120)
        assert seen == [(len(batch), i + 1)]
    wanted = {("1", "full", "x", 0), ("2", "meta", None, 1)}
    assert {tuple(r)[1:] for r in table.read().select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect()} == wanted
    merge_batches(table)(spark.createDataFrame(rows[1], SCHEMA), 1)
    assert {tuple(r)[1:] for r in table.read().select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect()} == wanted


def test_only_the_months_of_a_batch_are_written(spark, tmp_path):
    table, day = VersionedTable(spark, f"file://{tmp_path}/t"), 86_400_000
    rows = lambda *x: spark.createDataFrame(list(x), SCHEMA + ", internal_date long")
    merge = merge_batches(table)
    merge(rows(("a", "1", "full", "x", 1, 0), ("a", "2", "meta", None, 1, 40 * day), ("a", "3", "meta", None, 1, None)), 0)
    assert table.manifest() == {"1970-01": 1, "1970-02": 1, "none": 1}
    merge(rows(("a", "2", "full", "y", 0, 40 * day), ("b", "2", "meta", None, 1, 41 * day)), 1)
    assert table.manifest() == {"1970-01": 1, "1970-02": 2, "none": 1}
    got = {(r["account"], r["gmail_message_id"], r["body_state"], r["unread"]) for r in table.read().collect()}
    assert got == {("a", "1", "full", 1), ("a", "2", "full", 0), ("a", "3", "meta", 1), ("b", "2", "meta", 1)}
    assert table.read(["1970-02"]).count() == 2 and table.read(["2000-01"]) is None and table.read(version=1).count() == 3
    merge(rows(("a", "1", "meta", None, 0, 0), ("a", "3", "meta", None, 0, None)), 2)
    table.vacuum(keep=1)
    assert table.versions() == [3] and {tuple(r)[1:3] for r in table.read().select("account", "gmail_message_id", "body_state").collect()} == {("1", "full"), ("2", "full"), ("2", "meta"), ("3", "meta")}
    merge(rows().limit(0), 3)
    assert table.versions() == [3]


def test_windows(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:10:00", "v"), (1, "2024-01-01 00:20:00", "v"), (1, "2024-01-02 05:00:00", "v")], "user_id int, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["n"] for r in windowed_counts(rows).collect()) == [1, 2]
    assert sorted(r["n"] for r in session_counts(rows).collect()) == [1, 2]


def test_kept_rollups_follow_batches(spark, tmp_path):
    """After each batch the kept tables equal the rollups of all messages so far, and only parts that the batch touches are written."""
    from pyspark.sql import functions as F

    from quillmesh.operators import rollups as R
    from quillmesh.operators.messages import upsert
    from quillmesh.streaming.kept import KeptRollups

    from test_operators import mail, random_mail

    rows = random_mail(7, 40)
    first, later = mail(spark, rows[:30]), mail(spark, rows).where("gmail_message_id >= 'm025'")  # five come again
    one = mail(spark, rows).where("gmail_message_id = 'm003'").withColumn("unread", 1 - F.col("unread")).withColumn("from_addr", F.lit("New Name <new@x.com>"))
    kept, stored = KeptRollups(spark, f"file://{tmp_path}/kept", parts=6), None
    plain = lambda df, names: sorted(map(repr, df.select(*names).collect()))
    for batch in (first, later, one, one):
        wrote = kept.apply(batch)
        stored = upsert(batch.limit(0) if stored is None else stored, batch.withColumn("batch", F.lit(0)))
        for name, whole in (("contacts", R.contacts_rollup(stored, with_bulk=True)), ("threads", R.threads_rollup(stored))):
            assert plain(getattr(kept, name).read(), sorted(whole.columns)) == plain(whole, sorted(whole.columns))
    assert len(wrote["mail"]) == 1 and len(set(kept.mail.manifest().values())) > 1
    assert kept.apply(first.limit(0)) == {}
