"""The change feed: events with a unique dedupe key, read page by page behind a cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import cursor_column, decode_cursor, encode_cursor

MAX_PAGE = 500


def message_changes(messages: DataFrame) -> DataFrame:
    """One candidate event per message version; its key changes when the content does."""
    content = F.to_json(F.struct("from_addr", "to_addr", "cc_addr", "internal_date", "direction"), {"ignoreNullFields": "false"})
    key = F.concat_ws(":", F.lit("message"), "account", "gmail_message_id", F.substring(F.sha2(content, 256), 1, 16))
    return messages.select("account", F.lit("message").alias("entity_type"), F.col("gmail_message_id").alias("entity_key"), F.lit("upsert").alias("operation"), F.lit(None).cast("string").alias("reason"), content.alias("payload"), key.alias("dedupe_key"), F.col("internal_date").alias("occurred_at"))


def checked(events: DataFrame) -> DataFrame:
    """The events; one that deletes without a reason is an error."""
    return events.withColumn("operation", F.when((F.col("operation") == "delete") & F.col("reason").isNull(), F.raise_error(F.lit("a tombstone needs a reason"))).otherwise(F.col("operation")))


def first_of_key(events: DataFrame) -> DataFrame:
    """Of events with one dedupe key that of the first account and entity."""
    rank = F.row_number().over(W.partitionBy("dedupe_key").orderBy("account", "entity_key"))
    return events.withColumn("__nth", rank).where("__nth = 1").drop("__nth")


def append(feed: DataFrame, events: DataFrame) -> DataFrame:
    """The feed and those events whose key is new, numbered on from its last sequence in the order of occurred_at (if there is one), account and keys; events without a key are always new. A tombstone (operation delete) without a reason is an error."""
    if "occurred_at" not in events.columns:
        events = events.withColumn("occurred_at", F.lit(None).cast("long"))
    rows = checked(events)
    keyed = rows.where("dedupe_key IS NOT NULL").join(feed.select("dedupe_key").distinct(), "dedupe_key", "left_anti")
    fresh = first_of_key(keyed).unionByName(rows.where("dedupe_key IS NULL"))
    last = feed.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("last"))
    return feed.unionByName(_numbered(fresh, ["occurred_at", "account", "entity_type", "entity_key", "dedupe_key"]).join(F.broadcast(last)).withColumn("sequence", F.col("last") + F.col("nth")).select(*feed.columns))


def _numbered(rows: DataFrame, order: list[str], span_ms: int = 3_600_000) -> DataFrame:
    """rows with nth = 1, 2, ... in the order given, whose first column is a time: the rows of each hour are counted and the counts added up first, so no task sorts everything."""
    hour = F.coalesce(F.floor(F.col(order[0]) / span_ms), F.lit(-(2**62))).cast("long").alias("__hour")
    timed = rows.select("*", hour)
    counts = timed.groupBy("__hour").agg(F.count("*").alias("c"))
    before = counts.withColumn("__before", F.sum("c").over(W.orderBy("__hour").rowsBetween(W.unboundedPreceding, -1))).select("__hour", F.coalesce("__before", F.lit(0)).alias("__before"))
    nth = F.row_number().over(W.partitionBy("__hour").orderBy(*order))
    return timed.withColumn("__nth", nth).join(before, "__hour").withColumn("nth", F.col("__before") + F.col("__nth")).drop("__hour", "__nth", "__before")


def page(feed: DataFrame, after: int | str = 0, limit: int = 100, accounts: list[str] | None = None) -> DataFrame:
    """Events after the cursor in order, at most limit (1 to 500) of them, each with its own cursor."""
    after = decode_cursor(after) if isinstance(after, str) else after
    rows = feed.where(F.col("sequence") > after)
    if accounts:
        rows = rows.where(F.col("account").isin(accounts))
    return rows.orderBy("sequence").limit(min(max(1, limit), MAX_PAGE)).withColumn("cursor", cursor_column(F.col("sequence")))


def read_page(feed: DataFrame, after: str | None = None, limit: int = 100, accounts: list[str] | None = None) -> dict:
    """A page as the API returns it: events, the cursor to go on with, whether more follow."""
    start = decode_cursor(after) if after else 0
    limit = min(max(1, limit), MAX_PAGE)
    rows = page(feed, start, MAX_PAGE, accounts).limit(limit + 1).collect() if limit < MAX_PAGE else page(feed, start, limit, accounts).collect()
    events = rows[:limit]
    return {"events": [r.asDict() for r in events], "cursor": encode_cursor(events[-1]["sequence"] if events else start), "has_more": len(rows) > limit}
