"""Incremental ingest with Structured Streaming: idempotent micro-batches into a versioned table.

The table is cut by the month of a message's internal date, which its provider sets once and for all. Each micro-batch is merged
with the stored messages of its months by the state lattice; only these months are written anew. A version is a
manifest that names, for each month, the folder that holds it. A batch that is replayed gives the same
table, so at-least-once delivery is enough; a reader of an older version keeps its files until `vacuum`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.messages import upsert

PART = "__month"


def month_of(df: DataFrame) -> Column:
    """The month of internal_date; `none` without a date."""
    if "internal_date" not in df.columns:
        return F.lit("none")
    return F.coalesce(F.date_format(F.timestamp_millis("internal_date"), "yyyy-MM"), F.lit("none"))


class VersionedTable:
    """<path>/data/<version>/__month=<m>: the parts (months, or what `part` names) a version wrote; <path>/manifest/v=<version>: part -> version that holds it. The highest manifest with _SUCCESS is current. One writer at a time; a second one that chose the same version is refused."""

    def __init__(self, spark: SparkSession, path: str, part: Callable[[DataFrame], Column] = month_of) -> None:
        self.spark, self.path, self.part = spark, path.rstrip("/"), part

    def _listed(self, folder: str) -> list:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [(fs, s.getPath()) for s in fs.listStatus(root)] if fs.exists(root) else []

    def versions(self) -> list[int]:
        done = [p for fs, p in self._listed("manifest") if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("v=")) for p in done)

    def manifest(self, version: int | None = None) -> dict[str, int]:
        """month -> version of its folder, of the current version or another; a row for each month."""
        found = self.versions()
        if not found:
            return {}
        return {r["month"]: r["version"] for r in self.spark.read.schema("month string, version int").json(f"{self.path}/manifest/v={version or found[-1]}").collect()}

    def read(self, months: list[str] | None = None, version: int | None = None) -> DataFrame | None:
        """The table, or its rows of some months; None if there are none."""
        held: dict[int, list[str]] = {}
        for month, at in self.manifest(version).items():
            if months is None or month in months:
                held.setdefault(at, []).append(f"{self.path}/data/{at}/{PART}={month}")
        parts = [self.spark.read.parquet(*sorted(paths)) for _, paths in sorted(held.items())]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def write(self, df: DataFrame, months: list[str] | None = None) -> int:
        """A new version in which df replaces these months (of all months without). df may be empty for some of them."""
        found = self.versions()
        version = (found or [0])[-1] + 1
        kept = {} if months is None else {m: v for m, v in self.manifest().items() if m not in months}
        if f"v={version}" in [p.getName() for _, p in self._listed("manifest")]:
            raise ValueError(f"version {version} of {self.path} has another writer")
        rows = df.withColumn(PART, self.part(df)).hint("rebalance", PART)  # a part's rows meet, so it is few files; a hot one is split
        rows.write.mode("overwrite").partitionBy(PART).parquet(f"{self.path}/data/{version}")
        written = [p.getName().removeprefix(PART + "=") for _, p in self._listed(f"data/{version}") if p.getName().startswith(PART + "=")]
        rows = [*kept.items(), *((m, version) for m in written)]
        self.spark.createDataFrame(rows, "month string, version int").coalesce(1).write.json(f"{self.path}/manifest/v={version}")
        return version

    def vacuum(self, keep: int = 2) -> None:
        """Delete all manifests but the newest few, and the folders that these do not name."""
        newest = self.versions()[-keep:]
        named = {at for v in newest for at in self.manifest(v).values()}
        for folder, wanted, cut in (("manifest", set(newest), "v="), ("data", named, "")):
            for fs, p in self._listed(folder):
                if int(p.getName().removeprefix(cut)) not in wanted:
                    fs.delete(p, True)


def merge_batches(table: VersionedTable, after: Callable[[DataFrame, DataFrame], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: upsert into the batch's months, then `after(batch, messages)` on the new rows only (rules, derived tables)."""

    def run(batch: DataFrame, batch_id: int) -> None:
        months = sorted(r[0] for r in batch.select(month_of(batch)).distinct().collect())
        if not months:
            return
        stored = table.read(months)
        rows = batch.withColumn("batch", F.lit(batch_id))
        table.write(upsert(batch.limit(0) if stored is None else stored, rows), months)
        if after:
            after(batch, table.read())

    return run


def ingest(stream: DataFrame, table: VersionedTable, checkpoint: str, after: Callable[[DataFrame, DataFrame], None] | None = None):
    """Process what is there now and stop."""
    return stream.writeStream.foreachBatch(merge_batches(table, after)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day", time: str = "ts", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Tumbling event-time counts with a watermark; an extension beyond the reference."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, size).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def session_counts(events: DataFrame, gap: str | Column = "30 minutes", late: str = "1 hour", time: str = "ts", keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Session windows per key; an extension beyond the reference."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
