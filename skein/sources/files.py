"""Small files (manifests) in any file system Spark reaches, and the folder that driver and executors share."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only a local session may lack it and gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="skein-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fingerprint(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Bytes, files and time of the last change of a folder or file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = fs.getContentSummary(where)
    return whole.getLength(), whole.getFileCount(), fs.getFileStatus(where).getModificationTime()


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def read_json(self, name: str, default):
        fs, path = self._at(name)
        if not fs.exists(path):
            return default
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write_json(self, name: str, value) -> None:
        """Written beside and moved into place, so a reader sees the old or the new file whole."""
        fs, path = self._at(name)
        _, draft = self._at(name + ".new")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(value, indent=1).encode()))
        stream.close()
        if fs.exists(path):
            fs.delete(path, False)
        fs.rename(draft, path)

    def delete(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)
