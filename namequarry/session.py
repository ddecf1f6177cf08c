"""Session settings, the shared work folder and durable cut points."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the library's defaults; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and Spark runs in one process (tests, local mode) a temporary folder is made and set for
    the session; elsewhere executors would each write to their own disk, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="namequarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/namequarry/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, path: str, **parts) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends at files that survive lost executors."""
    writer = df.write.mode("overwrite")
    if parts.get("partition_by"):
        writer = writer.partitionBy(*parts["partition_by"])
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame, label: str) -> DataFrame:
    """``written`` to a fresh path."""
    return written(df, work_dir(df.sparkSession, label))


class Files:
    """Small file operations through Hadoop's file system, so any shared store works."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        self._overwrite = spark.sparkContext._gateway.new_array(rename, 1)
        self._overwrite[0] = rename.OVERWRITE
        self._charset = jvm.java.nio.charset.StandardCharsets.UTF_8
        self._io = jvm.org.apache.commons.io.IOUtils

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path)))

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._io.toString(stream, self._charset)
        finally:
            stream.close()

    def put(self, path: str, text: str) -> None:
        """Write beside the target, then rename over it in one step: readers see the old text or the new one, and a crash leaves one of them."""
        aside = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
        stream = self._fs.create(self._path(aside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._context.rename(self._fs.makeQualified(self._path(aside)), self._fs.makeQualified(self._path(path)), self._overwrite)

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
