"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "driftgate", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; anything else comes from ``conf`` or the cluster."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context, for tasks that import it by name."""
    sc = spark.sparkContext
    if getattr(sc, "_driftgate_shipped", False):
        return
    here = Path(__file__).resolve().parent
    packed = Path(tempfile.mkdtemp(prefix="driftgate-")) / "driftgate.zip"
    with zipfile.ZipFile(packed, "w") as z:
        for source in sorted(here.rglob("*.py")):
            z.write(source, source.relative_to(here.parent))
    sc.addPyFile(str(packed))  # copied to the executors by Spark
    sc._driftgate_shipped = True


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class WorkArea:
    """Tables that cut lineage between dependent jobs.

    They live under ``spark.checkpoint.dir``, which every executor of a cluster can reach, so a lost
    executor costs a task retry and never a recomputation of earlier rounds. Only a local session
    without that setting gets a temporary folder.

    An area without a ``path`` of its own is deleted when the session's driver ends, since results returned from it
    are read lazily; ``close``, or leaving it as a context manager, deletes it as soon as its result has been written.
    """

    def __init__(self, spark: SparkSession, purpose: str, path: str | None = None):
        self.spark = spark
        self.path = path or f"{_checkpoint_root(spark)}/{purpose}-{uuid.uuid4().hex}"
        if path is None:
            fs, folder = self._files(".")
            fs.deleteOnExit(folder)

    def __enter__(self) -> "WorkArea":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.drop(".")

    def save(self, df: DataFrame, name: str, partition_by: str | None = None, release: bool = False) -> DataFrame:
        """Write ``df`` once and return it as a scan with the same schema.

        With ``release`` the write's shuffle files go when it has ended, and not when the driver next collects garbage.
        """
        target = f"{self.path}/{name}"
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        if not release:
            writer.parquet(target)
            return self.load(name, df.schema)
        before = self.spark.conf.get(_RELEASE)
        self.spark.conf.set(_RELEASE, "true")
        try:
            writer.parquet(target)
        finally:
            self.spark.conf.set(_RELEASE, before)
        return self.load(name, df.schema)

    def load(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema is not None else reader).parquet(f"{self.path}/{name}")

    def save_text(self, text: str, name: str) -> None:
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{self.path}/{name}"
        )

    def load_text(self, name: str) -> str:
        return self.spark.read.text(f"{self.path}/{name}").first()[0]

    def _files(self, name: str):
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.path if name == "." else f"{self.path}/{name}")
        return path.getFileSystem(sc._jsc.hadoopConfiguration()), path

    def exists(self, name: str) -> bool:
        fs, path = self._files(name)
        return fs.exists(path)

    def names(self, name: str) -> list[str]:
        """What lies directly below ``name``."""
        fs, path = self._files(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def complete(self, name: str) -> bool:
        """Has this table been written to the end?"""
        fs, path = self._files(f"{name}/_SUCCESS")
        return fs.exists(path)

    def drop(self, name: str) -> None:
        """Delete one of this area's own tables."""
        fs, path = self._files(name)
        fs.delete(path, True)


def _checkpoint_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="driftgate-")
    spark.sparkContext.setCheckpointDir(root)
    return root
