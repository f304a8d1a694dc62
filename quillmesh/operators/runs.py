"""Sync runs and jobs as tables: the lock of an account, its mailbox's identity, what waits in the queue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STALE_RUN_MS = 6 * 3600 * 1000


class RunError(Exception):
    pass


def active_runs(runs: DataFrame, now_ms: int, except_id: int | None = None) -> DataFrame:
    """(account, id) of each account's live run: the newest that is unfinished and was started within six hours."""
    live = runs.where(F.col("finished_at").isNull() & (F.col("started_at") >= now_ms - STALE_RUN_MS))
    if except_id is not None:
        live = live.where(F.col("id") != except_id)
    return live.groupBy("account").agg(F.max_by("id", F.struct("started_at", "id")).alias("id"))


def acquire(runs: DataFrame, account: str, phase: str, now_ms: int, selector: str | None = None) -> tuple[DataFrame, int]:
    """The runs with a new one of the account, and its id. Refused while a run of the account is live. The caller stores the table; one writer at a time, as the table's commit is the lock."""
    if active_runs(runs.where(F.col("account") == account), now_ms).limit(1).collect():
        raise RunError(f"a run of {account!r} is in progress")
    number = (runs.agg(F.max("id")).first()[0] or 0) + 1
    row = runs.sparkSession.createDataFrame([(number, account, phase, selector, now_ms)], "id long, account string, phase string, selector string, started_at long")
    return runs.unionByName(row, allowMissingColumns=True), number


def finish(runs: DataFrame, run_id: int, now_ms: int, fetched: int = 0, indexed: int = 0, error: str | None = None) -> DataFrame:
    """The run closed, with or without an error."""
    hit = F.col("id") == run_id
    values = {"finished_at": F.lit(now_ms).cast("long"), "fetched": F.lit(fetched).cast("long"), "indexed": F.lit(indexed).cast("long"), "error": F.lit(error).cast("string")}
    return runs.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in values.items()})


def guard_identity(identities: dict[str, tuple[str, str]], account: str, address: str, provider: str) -> dict[str, tuple[str, str]]:
    """account -> (address, provider), with this account pinned to the mailbox it was first indexed from. Another provider is fine, another mailbox is refused."""
    known = identities.get(account)
    if known and known[0].lower() != address.lower():
        raise RunError(f"{account!r} holds the index of {known[0]}, not of {address}")
    return identities | {account: (known[0] if known else address, provider)}


def queue_status(jobs: DataFrame) -> DataFrame:
    """(account, queue_depth, last_sync): jobs that wait or run, and when the newest sync job was made."""
    waiting = F.count_if(F.col("status").isin("queued", "running"))
    return jobs.groupBy("account").agg(waiting.alias("queue_depth"), F.max(F.when(F.col("kind") == "sync", F.col("created_at"))).alias("last_sync"))


def discover_accounts(*tables: DataFrame) -> DataFrame:
    """(account): every account that any of the tables names."""
    return reduce(DataFrame.union, [t.select("account").distinct() for t in tables]).distinct()


def replace_labels(catalogue: DataFrame, account: str, listed: DataFrame) -> DataFrame:
    """The label catalogue with the account's labels replaced by those listed (id, name, type); an empty list changes nothing."""
    if listed.isEmpty():
        return catalogue
    return catalogue.where(F.col("account") != account).unionByName(listed.select(F.lit(account).alias("account"), "id", "name", "type"))
