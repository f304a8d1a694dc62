"""NDJSON export and import of the index: a header line, then a line per row of each table.

An export is a folder whose files, in the order of their paths, are that stream (`header/` sorts before `rows/`); an import takes such a
folder or a single file. Lines are ordered by file, by the split they were read in and by their place in it, so the order is that of the stream
without anything being numbered in one task; of repeated rows the last one wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.messages import upsert

SCHEMA_VERSION = 20
TABLES = ("messages", "contacts", "domains", "threads", "interest_profile", "labels", "sync_runs", "account_settings")


def export_lines(tables: dict[str, DataFrame], account: str | None = None) -> DataFrame:
    """(value): {"type", "row"} per row of the known tables, of one account if given."""
    parts = []
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"not an exported table: {name}")
        rows = df.where(F.col("account") == account) if account is not None and "account" in df.columns else df
        parts.append(rows.select(F.to_json(F.struct(F.lit(name).alias("type"), F.struct("*").alias("row")), {"ignoreNullFields": "false"}).alias("value")))
    return reduce(DataFrame.unionByName, parts)


def export(tables: dict[str, DataFrame], path: str, account: str | None = None) -> None:
    """A folder of text files; the header is a file of its own that sorts first in the folder `header`."""
    spark = next(iter(tables.values())).sparkSession
    spark.range(1).select(F.to_json(F.struct(F.lit("header").alias("type"), F.lit(SCHEMA_VERSION).alias("schema_version"))).alias("value")).coalesce(1).write.text(f"{path}/header")
    export_lines(tables, account).write.text(f"{path}/rows")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, type, value) of a file or a folder of files; `at` orders lines as the stream has them."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    return rows.select(at.alias("at"), F.get_json_object("value", "$.type").alias("type"), "value").where("trim(value) <> ''")


def import_rows(spark: SparkSession, path: str, schemas: dict) -> dict[str, DataFrame]:
    """The tables of an export whose first line is a header of our schema version; unknown types are an error. A row named by KEYS that comes again replaces the earlier one."""
    lines = read_lines(spark, path)
    first = lines.orderBy("at").select("type", F.get_json_object("value", "$.schema_version").cast("int").alias("v")).first()
    if not first or first["type"] != "header":
        raise ValueError("the first line is no header")
    if first["v"] != SCHEMA_VERSION:
        raise ValueError(f"schema version {first['v']}, expected {SCHEMA_VERSION}")
    unknown = lines.where(~F.col("type").isin("header", *TABLES) | F.col("type").isNull()).limit(1).collect()
    if unknown:
        raise ValueError(f"not an imported table: {unknown[0]['type']}")
    out = {}
    for name, schema in schemas.items():
        rows = lines.where(F.col("type") == name).select("at", F.from_json(F.get_json_object("value", "$.row"), schema).alias("r"))
        out[name] = last_rows(rows.select("at", "r.*"), KEYS.get(name))
    return out


def last_rows(rows: DataFrame, keys: list[str] | None) -> DataFrame:
    """Of rows with the same keys the one with the highest `at`; without keys all."""
    if not keys:
        return rows.drop("at")
    names = [c for c in rows.columns if c != "at"]
    last = rows.groupBy(*[F.col(k) for k in keys]).agg(F.max_by(F.struct(*names), "at").alias("__last"))
    return last.select("__last.*").select(*names)


#: What names a row of each table; rows of the others are known by all their columns.
KEYS = {
    "messages": ["account", "gmail_message_id"],
    "contacts": ["account", "address"],
    "domains": ["account", "domain"],
    "threads": ["account", "thread_id"],
    "labels": ["account", "id"],
    "account_settings": ["account"],
}


def merged(stored: dict[str, DataFrame], imported: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The stored tables with an import (of import_rows: a row of each key) in them: messages by the state lattice, so a body is never lost to a header nor a summary to a row without; else the imported row wins. Importing again, whole or from any line on, changes nothing more."""
    out = dict(stored)
    for name, rows in imported.items():
        if name not in stored:
            out[name] = rows
        elif name == "messages":
            out[name] = upsert(stored[name], rows.withColumn("batch", F.lit(0)))
        elif name in KEYS:
            out[name] = stored[name].join(rows.select(*KEYS[name]).distinct(), KEYS[name], "left_anti").unionByName(rows, allowMissingColumns=True)
        else:
            out[name] = stored[name].unionByName(rows, allowMissingColumns=True).distinct()
    return out


def watermarks(messages: DataFrame, runs: DataFrame) -> DataFrame:
    """A finished run at the newest message for each account without any finished run (a failed one counts) and with a dated message."""
    finished = runs.where("finished_at IS NOT NULL").select("account").distinct()
    newest = messages.where("internal_date <> 0").groupBy("account").agg(F.max("internal_date").alias("finished_at"))
    rows = newest.join(finished, "account", "left_anti")
    return rows.select("account", F.lit("sync").alias("phase"), F.col("finished_at").alias("started_at"), "finished_at", F.lit(None).cast("string").alias("error"))
