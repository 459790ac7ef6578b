"""Small files and folders by Hadoop's file system interface, so that any store Spark can reach will do."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where it is unset and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is not set")
    made = f"file://{tempfile.mkdtemp(prefix='relspark-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self) -> list[str]:
        if not self._fs.exists(self._path("")):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """False if the file is there already: so one of several writers wins."""
        try:
            out = self._fs.create(self._path(name), False)
        except Exception as e:
            if "exist" in str(e).lower():
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._path(name), True)
