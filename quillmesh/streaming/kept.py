"""Rollups that are kept: a batch of messages changes only what its threads and their correspondents need.

mail      messages, in parts by a hash of the thread
threads   threads_rollup, in the same parts
shares    what each thread gives to each correspondent (rollups.contact_shares), in parts by a hash of the address
contacts  contacts_rollup with bulk_count, in the same parts as the shares

A batch reads and writes anew the parts that its threads and their correspondents, former ones too, fall into; the other parts stay as
they are (the tables are versioned, see ingest.VersionedTable). The replied and initiated counts depend on the order within a thread, so touched
threads are counted again from their messages; everything above them is a merge of states. A message's thread is set once by its provider.
A batch that is replayed changes nothing; if a run breaks off between two tables, replaying its batch makes them agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import blank_to_null
from ..operators import rollups as R
from ..operators.messages import upsert
from ..session import Stage
from .ingest import VersionedTable


def thread_key() -> Column:
    """A message's thread; one without is a thread of its own."""
    return F.coalesce(blank_to_null(F.col("thread_id")), F.concat(F.lit("\x00"), "gmail_message_id"))


class KeptRollups:
    def __init__(self, spark: SparkSession, path: str, parts: int = 64) -> None:
        spread = lambda *key: F.pmod(F.xxhash64(*key), F.lit(parts)).cast("string")
        by_thread = lambda df: spread("account", "thread" if "thread" in df.columns else thread_key())
        by_address = lambda df: spread("account", "address")
        table = lambda name, part: VersionedTable(spark, f"{path.rstrip('/')}/{name}", part)
        self.mail, self.threads = table("mail", by_thread), table("threads", lambda df: spread("account", "thread_id"))
        self.shares, self.contacts = table("shares", by_address), table("contacts", by_address)

    def apply(self, batch: DataFrame) -> dict[str, list[str]]:
        """Take in a batch (a message once); the parts of each table that were written."""
        stage = Stage(batch.sparkSession, "batch")  # what is read more than once is made once
        batch = stage.put("batch", batch.withColumn("thread", thread_key()))
        parts = _parts(self.mail, batch)
        if not parts:
            stage.drop("batch")
            return {}
        touched = stage.put("touched", batch.select("account", "thread").distinct())
        before = self.mail.read(parts)
        held = batch.limit(0) if before is None else before
        gone = R.contact_shares(held.join(touched, ["account", "thread"], "left_semi")).select("account", "address").distinct()
        former = _parts(self.shares, gone)  # known before the mail changes
        self.mail.write(upsert(held, batch.withColumn("batch", F.lit(0))), parts)
        ours = self.mail.read(parts).join(touched, ["account", "thread"], "left_semi")
        fresh = stage.put("fresh", R.contact_shares(ours))
        sides = sorted(set(former) | set(_parts(self.shares, fresh)))
        if sides:
            self.shares.write(_replaced(self.shares.read(sides), fresh, touched), sides)
            shares = self.shares.read(sides)
            self.contacts.write(R.contacts_of(fresh.limit(0) if shares is None else shares), sides)
        named = touched.withColumnRenamed("thread", "thread_id")
        rolled = R.threads_rollup(ours)
        self.threads.write(_replaced(self.threads.read(thread_parts := _parts(self.threads, named)), rolled, named), thread_parts)
        stage.drop("batch", "touched", "fresh")
        return {"mail": parts, "shares": sides, "contacts": sides, "threads": thread_parts}


def _parts(table: VersionedTable, rows: DataFrame) -> list[str]:
    """The parts of a table that rows fall into: at most as many as the table has."""
    return sorted(r[0] for r in rows.select(table.part(rows)).distinct().collect())


def _replaced(held: DataFrame | None, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """fresh in place of all that is held of touched threads."""
    return fresh if held is None else held.join(touched, touched.columns, "left_anti").unionByName(fresh, allowMissingColumns=True)
