"""The attachment store: every content once, by its digest, and a manifest of the storage keys that the feed's events name.

objects/<batch>/shard=<two hex digits>/   (digest, size_bytes, content) of the contents that no earlier batch holds
manifest/<batch>/                         the batch's entries: what is stored under which key

Contents are rows of Parquet files, so many small attachments are few files, and Spark's own commit keeps what one attempt of a task has written,
however often it was tried. Files are sorted by digest: a read goes to one shard and, in it, to the row groups that can hold the digest. A batch
counts once its manifest is complete; one of that name is then a replay and changes nothing. What a run that broke off left is
overwritten. Of entries with one key that of the last batch counts (by name), of one batch that of the greatest digest. One writer at a time.

Edge cases: rows that are not stored, or without a key, have no entry; empty and null contents come as rows that are not stored; an empty batch
gives an empty manifest; repeated rows are one entry; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.kept_feed import KeptFeed
from .payload import attachment_events

OBJECT = "digest string, size_bytes long, content binary, shard string"
ENTRY = "storage_key string, digest string, size_bytes long, account string, message_id string, attachment_id string, filename string, mime_type string"
FIELDS = [c.split()[0] for c in ENTRY.split(", ")]


class AttachmentStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def batches(self) -> list[str]:
        """The batches whose manifest is complete."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        root = path(f"{self.path}/manifest")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(root) if fs.exists(path(s.getPath(), "_SUCCESS"))) if fs.exists(root) else []

    def _objects(self, batches: list[str]) -> DataFrame:
        """(digest, size_bytes, content, shard, batch); each batch's folder is a root of its own, so shard is read from the path."""
        rows = self.spark.createDataFrame([], OBJECT + ", batch string")
        for batch in batches:
            rows = rows.unionByName(self.spark.read.schema(OBJECT).parquet(f"{self.path}/objects/{batch}").withColumn("batch", F.lit(batch)))
        return rows

    def objects(self) -> DataFrame:
        return self._objects(self.batches())

    def put(self, stored: DataFrame, account: str, batch: str | None = None) -> bool:
        """Store a batch of `payload.storable` rows of an account; False if it is there already.

        A content that many rows share is reduced to one row within each task before the shuffle.
        """
        found = self.batches()
        batch = f"b{len(found):08d}" if batch is None else batch
        if batch in found:
            return False
        rows = stored.where("status = 'stored' AND storage_key IS NOT NULL")
        rows = rows.withColumns({"digest": F.sha2("content", 256), "size_bytes": F.octet_length("content").cast("long")})
        fresh = rows.groupBy("digest").agg(F.first("size_bytes").alias("size_bytes"), F.first("content").alias("content"))
        fresh = fresh.join(self._objects(found).select("digest"), "digest", "left_anti").withColumn("shard", F.substring("digest", 1, 2))
        placed = fresh.hint("rebalance", "shard").sortWithinPartitions("shard", "digest")
        placed.write.mode("overwrite").partitionBy("shard").parquet(f"{self.path}/objects/{batch}")
        entries = rows.select("storage_key", "digest", "size_bytes", F.lit(account).alias("account"), F.col("id").alias("message_id"), "attachment_id", "filename", "mime_type")
        entries = entries.groupBy("storage_key").agg(F.max(F.struct(*FIELDS[1:])).alias("e")).select("storage_key", "e.*")
        held = self._objects([*found, batch]).select("digest", F.lit(True).alias("held"))
        entries = entries.join(held, "digest", "left")
        lost = F.raise_error(F.concat(F.lit("no content was stored for "), "storage_key"))  # the rows came out otherwise when they were read again
        entries.withColumn("digest", F.when(F.col("held"), F.col("digest")).otherwise(lost)).select(*FIELDS).write.mode("overwrite").parquet(f"{self.path}/manifest/{batch}")
        return True

    def manifest(self) -> DataFrame:
        """The entries that stand, with the batch of each."""
        rows = self.spark.createDataFrame([], ENTRY + ", batch string")
        for batch in self.batches():
            rows = rows.unionByName(self.spark.read.schema(ENTRY).parquet(f"{self.path}/manifest/{batch}").withColumn("batch", F.lit(batch)))
        return rows.groupBy("storage_key").agg(F.max(F.struct("batch", *FIELDS[1:])).alias("e")).select("storage_key", "e.*")

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """Entries with their content and the batch that holds it (object_batch), all or those of some keys (storage_key). The contents are joined by digest; a content that many keys share is a hot key that AQE splits."""
        entries = self.manifest() if keys is None else self.manifest().join(keys.select("storage_key").distinct(), "storage_key", "left_semi")
        return entries.join(self.objects().select("digest", "content", F.col("batch").alias("object_batch")), "digest")

    def content(self, storage_key: str) -> bytes | None:
        """The bytes under one key, from the row groups of its shard that can hold its digest."""
        entry = self.manifest().where(F.col("storage_key") == storage_key).select("digest").first()
        return None if entry is None else bytes(self.of_digest(entry["digest"]).first()["content"])

    def of_digest(self, digest: str) -> DataFrame:
        return self.objects().where((F.col("shard") == digest[:2]) & (F.col("digest") == digest))

    def damaged(self) -> DataFrame:
        """Entries whose content is missing or has other bytes than its digest says; none in a sound store."""
        found = self.objects().select("digest", (F.sha2("content", 256) == F.col("digest")).alias("sound"))
        return self.manifest().join(found, "digest", "left").where("sound IS NOT true").drop("sound")


def import_attachments(store: AttachmentStore, feed: KeptFeed, stored: DataFrame, account: str, batch: str) -> dict:
    """Store a batch of `payload.storable` rows and append its events: how many are stored and skipped, and the feed's last sequence. A run that broke off between the two is made good by running it again."""
    store.put(stored, account, batch)
    last = feed.append(attachment_events(stored, account), batch)
    counts = {r["status"]: r["count"] for r in stored.groupBy("status").count().collect()}
    return {"stored": counts.get("stored", 0), "skipped": sum(n for status, n in counts.items() if status != "stored"), "last": last}
