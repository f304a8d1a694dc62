"""The user's own marks as a stored, append-only overlay, merged on read.

A mark is (kind, account, key, item) -> value; null takes it back. Every change is one transaction with a sequence, all of it or
nothing; of several values the one with the highest sequence counts. Sessions that open the same path see the same marks.

log/<sequence>/     the marks of one transaction, moved there when complete
claims/<sequence>   who takes a sequence creates this file first; a second writer that chose the same one is refused
base/<sequence>/    all marks up to a sequence, folded; taken-back marks are gone

After `FOLD_AFTER` transactions the log is folded into a new base, so a read lists at most that many folders and its plan does not grow
with the number of edits. Folders that a fold replaces stay until the next one, for readers that still hold them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, MutableMapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .messages import with_labels

MARK = "kind string, account string, key string, item string, value string, seq long"
KEY = ("kind", "account", "key", "item")
FOLD_AFTER = 64
SYNC = "sync"  # label edits from before the last such mark are what the provider has by now

Mark = tuple[str, str, str, str, str | None]  # kind, account, key, item, value


class Overlays:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, *names: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def _fs(self):
        return self._at().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, folder: str) -> list[int]:
        fs, at = self._fs(), self._at(folder)
        return sorted(int(n) for s in (fs.listStatus(at) if fs.exists(at) else []) if (n := s.getPath().getName()).isdigit())

    def _bases(self) -> list[int]:
        fs = self._fs()
        return [n for n in self._numbers("base") if fs.exists(self._at("base", str(n), "_SUCCESS"))]

    def _pending(self) -> tuple[int, list[int]]:
        base = max(self._bases(), default=0)
        return base, [n for n in self._numbers("log") if n > base]

    # --- writing

    def put(self, marks: list[Mark]) -> int:
        """One transaction of a few marks; its sequence."""
        if not marks:
            return self.last()
        name = f"staged-{uuid.uuid4().hex}"
        out = self._fs().create(self._at(name, "part.json"))
        try:
            out.write(bytearray("".join(json.dumps(dict(zip((*KEY, "value"), m))) + "\n" for m in marks).encode()))
        finally:
            out.close()
        return self._commit(name)

    def put_rows(self, marks: DataFrame) -> int:
        """One transaction of a table of marks (kind, account, key, item, value), written by the executors."""
        name = f"staged-{uuid.uuid4().hex}"
        marks.select(*KEY, "value").write.option("ignoreNullFields", "false").json(f"{self.path}/{name}")
        return self._commit(name)

    def _commit(self, staged: str) -> int:
        fs = self._fs()
        base, pending = self._pending()
        seq = max([base, *pending, *self._numbers("claims")]) + 1
        if not fs.createNewFile(self._at("claims", str(seq))):
            raise ValueError(f"transaction {seq} of {self.path} has another writer")
        fs.mkdirs(self._at("log"))
        if not fs.rename(self._at(staged), self._at("log", str(seq))):
            raise OSError(f"transaction {seq} of {self.path} was not stored")
        if len(pending) + 1 >= FOLD_AFTER:
            self.fold()
        return seq

    def fold(self) -> None:
        """Fold the log into a new base, and delete what the fold before this one replaced."""
        base, pending = self._pending()
        if not pending:
            return
        whole, fs = self.read(), self._fs()
        whole.write.mode("overwrite").parquet(f"{self.path}/base/{pending[-1]}")
        for folder in ("log", "claims"):
            for n in self._numbers(folder):
                if n <= base:
                    fs.delete(self._at(folder, str(n)), True)
        for n in self._numbers("base"):
            if n < base:
                fs.delete(self._at("base", str(n)), True)

    # --- reading

    def last(self) -> int:
        base, pending = self._pending()
        return max([base, *pending])

    def read(self, *kinds: str) -> DataFrame:
        """The marks that stand (of some kinds): kind, account, key, item, value, seq."""
        base, pending = self._pending()
        rows = self.spark.createDataFrame([], MARK)
        if pending:
            log = self.spark.read.schema(MARK).json([f"{self.path}/log/{n}" for n in pending])
            rows = log.withColumn("seq", F.regexp_extract("_metadata.file_path", r"/log/(\d+)/[^/]+$", 1).cast("long"))
        if base:
            rows = rows.unionByName(self.spark.read.schema(MARK).parquet(f"{self.path}/base/{base}"))
        if kinds:
            rows = rows.where(F.col("kind").isin(*kinds))
        return rows.groupBy(*KEY).agg(F.max(F.struct("seq", "value")).alias("m")).where("m.value IS NOT NULL").select(*KEY, "m.value", "m.seq")

    def of(self, kind: str, key: str, column: str) -> DataFrame:
        """The marks of a kind, whose values are JSON strings, as (account, key, column)."""
        value = F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "v string")["v"]
        return self.read(kind).select("account", F.col("key").alias(key), value.alias(column))

    def on_messages(self, messages: DataFrame) -> DataFrame:
        """The messages with the label edits since the last sync and the saved summaries: one join, whatever the number of edits."""
        synced = self.read(SYNC).agg(F.coalesce(F.max("seq"), F.lit(0)).alias("synced"))
        marks = self.read("label", "summary").join(F.broadcast(synced))  # one row
        label = lambda on: F.sort_array(F.collect_list(F.when((F.col("kind") == "label") & (F.col("seq") > F.col("synced")) & (F.col("value") == on), F.col("item"))))
        said = lambda item: F.max(F.when((F.col("kind") == "summary") & (F.col("item") == item), F.col("value")))
        folded = marks.groupBy("account", F.col("key").alias("gmail_message_id")).agg(label("add").alias("__add"), label("remove").alias("__remove"), said("text").alias("__text"), said("at").cast("long").alias("__at"))
        rows = messages.join(folded, ["account", "gmail_message_id"], "left")
        empty = F.array().cast("array<string>")
        if "labels" in messages.columns:
            edited = F.size(F.coalesce("__add", empty)) + F.size(F.coalesce("__remove", empty)) > 0
            follow = [c for c in ("labels", "category", "unread", "starred", "important") if c in messages.columns]
            rows = rows.withColumns({f"__old_{c}": F.col(c) for c in follow})
            rows = with_labels(rows, F.array_union(F.array_except(F.coalesce("labels", empty), F.coalesce("__remove", empty)), F.coalesce("__add", empty)))
            rows = rows.withColumns({c: F.when(edited, F.col(c)).otherwise(F.col(f"__old_{c}")) for c in follow})
        for name, found in (("summary_text", F.col("__text")), ("summarized_at", F.col("__at"))):
            if name in messages.columns:
                rows = rows.withColumn(name, F.when(F.col("__text").isNotNull(), found.cast(messages.schema[name].dataType)).otherwise(F.col(name)))
        return rows.select(*messages.columns)


class Marks(MutableMapping):
    """The marks of one kind as a mapping; each assignment is a transaction. Keys are (account, key), or one name (`single`); values are JSON."""

    def __init__(self, store: Overlays, kind: str, single: bool = False) -> None:
        self.store, self.kind, self.single = store, kind, single

    def mark(self, key: Any, value: Any) -> Mark:
        account, name = (key, "") if self.single else key
        return (self.kind, account, name, "", None if value is None else json.dumps(value))

    def _held(self) -> DataFrame:
        return self.store.read(self.kind)

    def items(self, account: str | None = None) -> list[tuple[Any, Any]]:
        rows = self._held() if account is None else self._held().where(F.col("account") == account)
        return sorted(((r["account"] if self.single else (r["account"], r["key"]), json.loads(r["value"])) for r in rows.collect()), key=lambda kv: kv[0])

    def __getitem__(self, key: Any) -> Any:
        account, name = (key, "") if self.single else key
        found = self._held().where((F.col("account") == account) & (F.col("key") == name)).collect()
        if not found:
            raise KeyError(key)
        return json.loads(found[0]["value"])

    def __setitem__(self, key: Any, value: Any) -> None:
        self.store.put([self.mark(key, value)])

    def __delitem__(self, key: Any) -> None:
        self[key]
        self.store.put([self.mark(key, None)])

    def __iter__(self) -> Iterator:
        return iter([k for k, _ in self.items()])

    def __len__(self) -> int:
        return self._held().count()
