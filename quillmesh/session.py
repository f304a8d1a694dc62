"""SparkSession defaults shared by the bench, the tests and interactive use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "quillmesh", cores: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session with the settings that every query of the library assumes (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see: below spark.checkpoint.dir; on a local master that names none (tests) a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillmesh-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Stage:
    """Tables of an iteration in a shared folder: each `put` cuts the lineage, survives lost executors, and deletes what had its name before."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.paths, self.count = spark, shared_folder(spark, name), {}, 0

    def put(self, name: str, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{name}-{self.count}"
        df.write.parquet(path)
        old, self.paths[name] = self.paths.get(name), path
        if old:
            self._delete(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.paths.pop(name))

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
