"""A Spark data source over a stored archive: `spark.read.format("quillmesh_mail")` and `spark.readStream`.

    register(spark)
    spark.read.format("quillmesh_mail").option("path", "file:///archive").load().where("internal_date >= 852076800000")
    spark.readStream.format("quillmesh_mail").option("path", "file:///archive").load()

The archive is what `streaming.ingest.VersionedTable` keeps: parts by month, and manifests. A read partition is one file.
Filters on the date prune months before files are listed; they, and those on account, id and direction, also go to the Parquet
reader, which skips row groups by their statistics. Spark evaluates every filter again, so pushing one only ever saves work.

A stream's offset is a version of the archive: a batch has the rows of the months that were written after the last version read, as
they are now in the new one. A month is written as a whole, so rows of it come again; what follows is an upsert or drops keys
that it knows. A stream starts with version 0 (everything), or with `startingVersion`.

Options: path; version (of a read: an older one, as long as vacuum has not taken it); startingVersion; columns (comma-separated;
the reader cannot see a query's projection, so this names the columns that are read; default all).
Files are read by pyarrow on executors, so path must be one that its file systems know (file, hdfs, s3, gs).
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from ..streaming.ingest import PART

FORMAT = "quillmesh_mail"
DATE = "internal_date"
PUSHED = (DATE, "account", "gmail_message_id", "thread_id", "direction")
BATCH_ROWS = 8192


@dataclass
class FilePartition(InputPartition):
    path: str
    tests: list[tuple[str, str, object]] = field(default_factory=list)


class Manifests:
    """The manifests of a VersionedTable, read without Spark: a data source lives in Python workers of its own."""

    def __init__(self, path: str) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(path) if "://" in path else pafs.FileSystem.from_uri("file://" + path)

    def versions(self) -> list[int]:
        names = [f.base_name for f in self.fs.get_file_info(pafs.FileSelector(f"{self.root}/manifest", allow_not_found=True)) if f.base_name.startswith("v=")]
        done = self.fs.get_file_info([f"{self.root}/manifest/{n}/_SUCCESS" for n in names]) if names else []
        return sorted(int(n.removeprefix("v=")) for n, f in zip(names, done) if f.type == pafs.FileType.File)

    def months(self, version: int) -> dict[str, int]:
        """month -> the version that wrote its folder."""
        out = {}
        for f in self.fs.get_file_info(pafs.FileSelector(f"{self.root}/manifest/v={version}")):
            if f.base_name.endswith(".json"):
                with self.fs.open_input_stream(f.path) as s:
                    rows = [json.loads(line) for line in s.read().decode().splitlines()]
                out |= {r["month"]: r["version"] for r in rows}
        return out

    def files(self, month: str, at: int) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/data/{at}/{PART}={month}"))
        return sorted(f.path for f in found if f.base_name.endswith(".parquet"))


def month_bounds(month: str) -> tuple[int, int] | None:
    """The first millisecond of a month and of the next one; None for the part of messages without a date, or parts that are no months."""
    try:
        first = dt.datetime.strptime(month, "%Y-%m").replace(tzinfo=dt.UTC)
    except ValueError:
        return None
    after = (first.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
    return int(first.timestamp() * 1000), int(after.timestamp() * 1000)


OPS = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}


def test_of(f: Filter) -> tuple[str, str, object] | None:
    """A filter as (column, operation, value), if it is one that files can be tested by."""
    name = ".".join(f.attribute) if type(f) in OPS else None
    return (name, OPS[type(f)], f.value) if name in PUSHED and f.value is not None else None


def may_hold(month: str, tests: list[tuple[str, str, object]]) -> bool:
    """Whether a month may have a row that passes; a message without a date passes no test of it."""
    dated = [(op, v) for name, op, v in tests if name == DATE]
    if not dated:
        return True
    if month == "none":
        return False
    bounds = month_bounds(month)
    if bounds is None:
        return True
    low, high = bounds
    fits = {"==": lambda v: low <= v < high, ">": lambda v: v < high - 1, ">=": lambda v: v < high, "<": lambda v: low < v, "<=": lambda v: low <= v, "in": lambda v: any(x is not None and low <= x < high for x in v)}
    return all(fits[op](v) for op, v in dated)


def expression(tests: list[tuple[str, str, object]], known: set[str]) -> pc.Expression | None:
    made = {"==": lambda c, v: c == v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, "in": lambda c, v: c.isin([x for x in v if x is not None])}
    out = None
    for name, op, value in tests:
        if name in known:
            one = made[op](ds.field(name), value)
            out = one if out is None else out & one
    return out


def read_file(path: str, tests: list[tuple[str, str, object]], schema: StructType, root: str) -> Iterator[pa.RecordBatch]:
    """A file's rows that pass, in the schema's columns; a column that the file lacks is null."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fs = Manifests(root).fs
    wanted = to_arrow_schema(schema)
    data = ds.dataset(path, format="parquet", filesystem=fs)
    known = set(data.schema.names)
    for batch in data.to_batches(columns=[n for n in wanted.names if n in known], filter=expression(tests, known), batch_size=BATCH_ROWS):
        if batch.num_rows:
            held = [batch.column(f.name).cast(f.type) if f.name in known else pa.nulls(batch.num_rows, f.type) for f in wanted]
            yield pa.RecordBatch.from_arrays(held, schema=wanted)


class MailReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.root, self.at, self.tests = schema, options["path"], options.get("version"), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        self.tests = [t for t in map(test_of, filters) if t]
        yield from filters  # Spark tests all again

    def partitions(self) -> list[FilePartition]:
        archive = Manifests(self.root)
        found = archive.versions()
        if self.at is not None and int(self.at) not in found:
            raise ValueError(f"no version {self.at} of {self.root}")
        months = archive.months(int(self.at) if self.at is not None else found[-1]) if found else {}
        return [FilePartition(path, self.tests) for m, at in sorted(months.items()) if may_hold(m, self.tests) for path in archive.files(m, at)]

    def read(self, partition: FilePartition | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # an archive without a fitting file
            yield from read_file(partition.path, partition.tests, self.schema, self.root)


class MailStream(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.root, self.first = schema, options["path"], int(options.get("startingVersion", 0))

    def initialOffset(self) -> dict:
        return {"version": self.first}

    def latestOffset(self) -> dict:
        return {"version": max([self.first, *Manifests(self.root).versions()])}

    def partitions(self, start: dict, end: dict) -> list[FilePartition]:
        """Files of the months that were written after `start`, as version `end` has them."""
        archive = Manifests(self.root)
        if start["version"] >= end["version"]:
            return []
        return [FilePartition(path) for m, at in sorted(archive.months(end["version"]).items()) if at > start["version"] for path in archive.files(m, at)]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        yield from read_file(partition.path, [], self.schema, self.root)


class MailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        """That of the current version's files together, or the columns asked for."""
        archive = Manifests(self.options["path"])
        found = archive.versions()
        if not found:
            raise ValueError(f"no archive at {self.options['path']}: give a schema")
        heads = [ds.dataset(archive.files(m, at)[:1], format="parquet", filesystem=archive.fs).schema for m, at in sorted(archive.months(found[-1]).items())]
        whole = from_arrow_schema(pa.unify_schemas([h.remove_metadata() for h in heads]))
        asked = self.options.get("columns")
        return StructType([whole[c.strip()] for c in asked.split(",")]) if asked else whole

    def reader(self, schema: StructType) -> MailReader:
        return MailReader(schema, self.options)

    def streamReader(self, schema: StructType) -> MailStream:
        return MailStream(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MailSource)
