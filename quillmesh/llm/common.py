"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; on a local master that names none (tests) a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillmesh-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


class Scratch:
    """Tables written to the shared folder that cut the lineage.

    Unlike a cached or locally checkpointed frame such a table survives the loss of any executor. It is
    deleted by `drop` as soon as all that reads it has been written itself.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """df written as Parquet and read again; a table that had the name goes."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        if name in self.paths:
            self.drop(name)
        self.paths[name] = path
        self.spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner drop the shuffle files of finished jobs
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again; it stays there."""
    return Scratch(df.sparkSession, name).put(df, "rows")


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) > 0, F.split(trimmed, BLANK_CLASS + "+")).otherwise(F.array().cast("array<string>"))


def barrier(value: Column) -> Column:
    """value, marked as not deterministic: the optimizer then neither inlines it into a lambda nor pushes a filter on it below its projection."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def of_documents(docs: DataFrame, ids: DataFrame, key: str, max_broadcast: int = 500_000) -> DataFrame:
    """The rows of docs whose key is in ids (one column, distinct). The ids are broadcast up to a counted number, else both sides are shuffled."""
    small = ids.count() <= max_broadcast
    return docs.join(F.broadcast(ids) if small else ids, key, "left_semi")


def doc_key(id_col: str, text_col: str) -> list[Column]:
    """k1, k2: 128 bits that name a document, an id and a text; either may be null."""
    return [F.xxhash64(id_col, text_col).alias("k1"), F.xxhash64(F.lit(5), F.col(text_col), F.col(id_col)).alias("k2")]
