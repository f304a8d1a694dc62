"""A change feed that is kept: batches append files in the order of their events, pages read only the files they need.

data/<batch>/    events in order, without numbers: a file holds at most `rows_per_file` of them
index/<batch>/   for each file and account the number of events, and the file's first and last sequence

An event's sequence is its file's first one plus its row in the file, so a batch is written once and nothing is numbered in one
task: the rows are cut into ranges of their whole order (an hour with most of the events, or all events without a time, is many ranges),
and only the files' totals are added up. A batch counts once its index is complete; a batch of that name is then refused as a
replay. What a run that broke off left is overwritten. One writer at a time.

`follow` takes a stream. Its keyed state holds the dedupe keys, so a replayed or late event is dropped without looking at the feed;
only what other streams have written is compared by key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import all_of, cursor_column, decode_cursor, encode_cursor
from ..operators.feed import MAX_PAGE, checked, first_of_key

EVENT = "account string, entity_type string, entity_key string, operation string, reason string, payload string, dedupe_key string, occurred_at long"
COLUMNS = [c.split()[0] for c in EVENT.split(", ")]
ORDER = ("occurred_at", "account", "entity_type", "entity_key", "dedupe_key")
INDEX = "batch string, file string, account string, n long, first long, last long"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class KeptFeed:
    def __init__(self, spark: SparkSession, path: str, rows_per_file: int = 1_000_000) -> None:
        self.spark, self.path, self.rows_per_file = spark, path.rstrip("/"), rows_per_file

    def batches(self) -> list[str]:
        """The batches whose index is complete."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        root = path(f"{self.path}/index")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(root) if fs.exists(path(s.getPath(), "_SUCCESS"))) if fs.exists(root) else []

    def index(self) -> DataFrame:
        found = self.batches()
        return self.spark.read.schema(INDEX).parquet(*[f"{self.path}/index/{b}" for b in found]) if found else self.spark.createDataFrame([], INDEX)

    def last(self) -> int:
        return self.index().agg(F.coalesce(F.max("last"), F.lit(0))).first()[0]

    def _data(self, paths: list[str]) -> DataFrame:
        rows = self.spark.read.schema(EVENT).parquet(*paths)
        return rows.select(*COLUMNS, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))

    def append(self, events: DataFrame, batch: str | None = None, unique_within: str | None = None) -> int:
        """Append those events whose key is new; the number of the last event. A batch name that is already in the feed changes nothing.

        Events without a key are always new. unique_within: a prefix of batches whose keys the caller has already compared (a stream's own).
        """
        found = self.batches()
        batch = f"b{len(found):08d}" if batch is None else batch
        base = self.last()
        if batch in found:
            return base
        if "occurred_at" not in events.columns:
            events = events.withColumn("occurred_at", F.lit(None).cast("long"))
        rows = checked(events.select(*COLUMNS))
        keyed = first_of_key(rows.where("dedupe_key IS NOT NULL"))
        others = [f"{self.path}/data/{b}" for b in found if unique_within is None or not b.startswith(unique_within)]
        if others:
            keyed = keyed.join(self.spark.read.schema(EVENT).parquet(*others).select("dedupe_key"), "dedupe_key", "left_anti").select(*COLUMNS)
        fresh = keyed.unionByName(rows.where("dedupe_key IS NULL"))
        place = f"{self.path}/data/{batch}"
        fresh.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).write.mode("overwrite").option("maxRecordsPerFile", self.rows_per_file).parquet(place)
        counts = self._data([place]).groupBy("file", "account").agg(F.count("*").alias("n"))
        number = lambda pattern: F.regexp_extract("file", pattern, 1).cast("int")
        before = W.orderBy(number(r"^part-(\d+)"), number(r"-c(\d+)\.")).rowsBetween(W.unboundedPreceding, W.currentRow)  # one row a file
        files = counts.groupBy("file").agg(F.sum("n").alias("total")).withColumn("last", F.sum("total").over(before) + base)
        rows = counts.join(files.withColumn("first", F.col("last") - F.col("total") + 1), "file")
        rows.select(F.lit(batch).alias("batch"), "file", "account", "n", "first", "last").write.mode("overwrite").parquet(f"{self.path}/index/{batch}")
        return self.last()

    def read(self) -> DataFrame:
        """All events with their sequence."""
        found = self.batches()
        if not found:
            return self.spark.createDataFrame([], EVENT).withColumn("sequence", F.lit(0).cast("long"))
        starts = self.index().select("file", "first").distinct()
        return self._data([f"{self.path}/data/{b}" for b in found]).join(starts, "file").withColumn("sequence", F.col("first") + F.col("row")).select(*COLUMNS, "sequence")

    def files_of(self, after: int, limit: int, accounts: list[str] | None = None) -> list[tuple[str, int]]:
        """(path, first sequence) of the files that hold the next `limit` events after a sequence: at most limit + 1 of them are looked at."""
        rows = self.index().where(F.col("last") > after)
        if accounts:
            rows = rows.where(F.col("account").isin(accounts))
        rows = rows.groupBy("batch", "file", "first").agg(F.sum("n").alias("n")).orderBy("first").limit(limit + 1).collect()
        out, enough = [], 0
        for r in rows:
            if enough >= limit:
                break
            out.append((f"{self.path}/data/{r['batch']}/{r['file']}", r["first"]))
            enough += r["n"] if r["first"] > after else 0  # of the cursor's own file any number may be left
        return out

    def page(self, after: int | str = 0, limit: int = 100, accounts: list[str] | None = None) -> DataFrame:
        """Events after the cursor in order, at most limit (1 to 500) of them, each with its own cursor."""
        after = decode_cursor(after) if isinstance(after, str) else after
        return self._page(after, min(max(1, limit), MAX_PAGE), accounts)

    def _page(self, after: int, limit: int, accounts: list[str] | None) -> DataFrame:
        files = self.files_of(after, limit, accounts)
        if not files:
            return self.spark.createDataFrame([], EVENT + ", sequence long, cursor string")
        starts = F.create_map(*[F.lit(x) for path, first in files for x in (path.rsplit("/", 1)[1], first)])
        rows = self._data([path for path, _ in files]).withColumn("sequence", F.element_at(starts, F.col("file")) + F.col("row"))
        wanted = [F.col("sequence") > after, *([F.col("account").isin(accounts)] if accounts else [])]
        return rows.where(all_of(wanted)).orderBy("sequence").limit(limit).withColumn("cursor", cursor_column(F.col("sequence"))).select(*COLUMNS, "sequence", "cursor")

    def read_page(self, after: str | None = None, limit: int = 100, accounts: list[str] | None = None) -> dict:
        """A page as the API returns it: events, the cursor to go on with, whether more follow."""
        start, limit = decode_cursor(after) if after else 0, min(max(1, limit), MAX_PAGE)
        rows = self._page(start, limit + 1, accounts).collect()
        events = rows[:limit]
        return {"events": [r.asDict() for r in events], "cursor": encode_cursor(events[-1]["sequence"] if events else start), "has_more": len(rows) > limit}

    def follow(self, events: DataFrame, checkpoint: str):
        """Append a stream's events, each key once, and stop when all that is there now has been read. The state is kept for good: keys have no horizon."""
        keyed = events.where("dedupe_key IS NOT NULL").dropDuplicates(["dedupe_key"])

        def add(batch: DataFrame, batch_id: int) -> None:
            run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
            self.append(batch, f"{run}-{batch_id:08d}", unique_within=run)

        return start(keyed.unionByName(events.where("dedupe_key IS NULL")), add, checkpoint)


def start(rows: DataFrame, each, checkpoint: str):
    """Run a stream with keyed state over what is there now. The state store keeps keys on disk, beside the heap; the session's own setting comes back."""
    spark, name = rows.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    try:
        return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)


FIRING = ("rule", "account", "gmail_message_id")


def firings(messages: DataFrame, rules: dict[str, dict], contacts: DataFrame, domains: DataFrame) -> DataFrame:
    """(rule, account, gmail_message_id, occurred_at) of enabled rules ({account, conditions, enabled}) and the messages, a stream or a table, that match them; a rule without an account is for all.

    contacts and domains are tables: a stream meets them as they are when its batch runs.
    """
    from ..operators.messages import matching

    found = []
    for name, rule in sorted(rules.items()):
        if rule.get("enabled", True):
            rows = messages if rule.get("account") is None else messages.where(F.col("account") == rule["account"])
            found.append(matching(rows, contacts, domains, rule["conditions"]).select(F.lit(name).alias("rule"), "account", "gmail_message_id", F.col("internal_date").alias("occurred_at")))
    if not found:
        return messages.where("false").select(F.lit("").alias("rule"), "account", "gmail_message_id", F.col("internal_date").alias("occurred_at"))
    return reduce(DataFrame.unionByName, found)


def firing_events(fired: DataFrame) -> DataFrame:
    """Firings as events of a feed. A firing's key is its rule and message, so none comes twice."""
    key = F.to_json(F.array(*FIRING))
    none = F.lit(None).cast("string")
    return fired.select("account", F.lit("trigger").alias("entity_type"), F.concat_ws(":", "rule", "gmail_message_id").alias("entity_key"), F.lit("fire").alias("operation"), none.alias("reason"), F.to_json(F.struct(*FIRING)).alias("payload"), key.alias("dedupe_key"), "occurred_at")
