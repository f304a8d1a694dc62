"""Background work as a table of jobs: leases, one live job of a kind per account, two queues, when each account is due.

jobs: (id, kind, account, params, status, created_at, started_at, finished_at, error, terminal), times in milliseconds.
All functions are plans over whole tables, so any number of requests is handled in one pass; the caller stores the
result, one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Leases, error texts and the kinds of the second queue.
RUNNING_LEASE_MS = 15 * 60_000
QUEUED_LEASE_MS = 50 * 60_000
RUNNING_EXPIRED = "stale Job lock expired after 15 minutes"
QUEUED_EXPIRED = "queued Job was never delivered"
SWEEP_KINDS = ("enrich_bulk", "retention", "backfill_slice", "graph")

KEY = ["kind", "account"]
SCHEMA = "id string, kind string, account string, params string, status string, created_at long, started_at long, finished_at long, error string, terminal boolean"


def queue_of(kind: Column) -> Column:
    """The queue of a job: bounded sweeps wait apart from syncs, which may hold theirs for long."""
    return F.when(kind.isin(*SWEEP_KINDS), "sweep").otherwise("sync")


def expired(jobs: DataFrame, now_ms: int) -> DataFrame:
    """The jobs, those closed as failed that run or wait for longer than their lease."""
    dead = (F.col("status") == "running") & (F.col("started_at") < now_ms - RUNNING_LEASE_MS)
    lost = (F.col("status") == "queued") & (F.col("created_at") < now_ms - QUEUED_LEASE_MS)
    over = F.coalesce(dead | lost, F.lit(False))
    values = {
        "error": F.when(F.col("status") == "running", RUNNING_EXPIRED).otherwise(QUEUED_EXPIRED),
        "finished_at": F.lit(now_ms).cast("long"),
        "terminal": F.lit(True),
        "status": F.lit("failed"),
    }
    return jobs.select(*[F.when(over, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in jobs.columns])


def enqueue(jobs: DataFrame, requests: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """requests (kind, account, params) -> the jobs with what was asked for, and (kind, account, id, is_new) of each request.

    Leases of the requested kinds and accounts are looked at first. While a job of the kind is live for the account its id is
    the answer (the newest one's); else there is a new job, one for requests that repeat (the smallest params).
    """
    wanted = requests.groupBy(*KEY).agg(F.min("params").alias("params"))
    asked = wanted.select(*KEY).withColumn("__asked", F.lit(True))
    seen = jobs.join(asked, KEY, "left")
    held = expired(seen.where("__asked"), now_ms).drop("__asked").select(*jobs.columns)
    rest = seen.where("__asked IS NULL").select(*jobs.columns)
    live = held.where(F.col("status").isin("queued", "running")).groupBy(*KEY).agg(F.max_by("id", F.struct("created_at", "id")).alias("live"))
    name = F.sha2(F.concat_ws("\x1f", "kind", "account", F.lit(str(now_ms))), 256).substr(1, 32)
    answers = wanted.join(live, KEY, "left").select(*KEY, "params", F.coalesce("live", name).alias("id"), F.col("live").isNull().alias("is_new"))
    values = {"status": F.lit("queued"), "created_at": F.lit(now_ms).cast("long"), "terminal": F.lit(False)}
    made = answers.where("is_new").select("id", *KEY, "params", *[v.alias(c) for c, v in values.items()])
    return rest.unionByName(held).unionByName(made, allowMissingColumns=True), answers.select(*KEY, "id", "is_new")


def started(jobs: DataFrame, now_ms: int, slots: int) -> DataFrame:
    """The jobs, of each queue the longest waiting set to running in as many slots as are free.

    Only the longest waiting can start, so the rank is a window top-k, pruned before the shuffle.
    """
    queue = queue_of(F.col("kind"))
    busy = jobs.where("status = 'running'").groupBy(queue.alias("queue")).agg(F.count("*").alias("busy"))
    rank = F.row_number().over(W.partitionBy("queue").orderBy("created_at", "id"))
    first = jobs.where("status = 'queued'").select("id", "created_at", queue.alias("queue")).withColumn("rank", rank).where(F.col("rank") <= slots)
    chosen = first.join(busy, "queue", "left").where(F.col("rank") <= slots - F.coalesce("busy", F.lit(0))).select("id", F.lit(True).alias("__go"))
    go = F.col("__go").isNotNull()
    values = {"status": F.lit("running"), "started_at": F.lit(now_ms).cast("long")}
    rows = jobs.join(F.broadcast(chosen), "id", "left")  # at most `slots` rows of each of two queues
    return rows.select(*[F.when(go, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in jobs.columns])


def finished(jobs: DataFrame, done: DataFrame, now_ms: int) -> DataFrame:
    """done (id, error) -> the jobs with these closed: done, or failed with an error. Closed jobs stay as they are: a late report changes nothing."""
    reports = done.groupBy("id").agg(F.max("error").alias("__error")).withColumn("__done", F.lit(True))
    hit = F.col("__done").isNotNull() & F.col("status").isin("queued", "running")
    values = {
        "error": F.col("__error"),
        "finished_at": F.lit(now_ms).cast("long"),
        "terminal": F.lit(True),
        "status": F.when(F.col("__error").isNull(), "done").otherwise("failed"),
    }
    rows = jobs.join(reports, "id", "left")
    return rows.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in jobs.columns])


def due_syncs(accounts: DataFrame, runs: DataFrame, floor_ms: int) -> DataFrame:
    """accounts (account, auth_error) -> (account, since): the last finish without an error, no earlier than the lookback's floor.

    Accounts whose grant was refused are left out until it is renewed.
    """
    clean = runs.where("finished_at IS NOT NULL AND error IS NULL")
    if "phase" in runs.columns:
        clean = clean.where("phase = 'sync'")
    last = clean.groupBy("account").agg(F.max("finished_at").alias("last"))
    able = accounts.where("auth_error IS NULL").select("account")
    return able.join(last, "account", "left").select("account", F.greatest(F.col("last"), F.lit(floor_ms).cast("long")).alias("since"))
