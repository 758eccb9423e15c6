"""Small files that say what a folder holds, on any file system Spark knows."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class Markers:
    """A folder of small JSON files; creating one is the step that makes a write visible."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def list(self, folder: str) -> list[str]:
        """Names in any folder of the same file system."""
        path = self._path(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def names(self) -> list[str]:
        return self.list(self.folder)

    def claim(self, name: str, content: dict) -> bool:
        """Creates a file that must not exist; False if it does."""
        path = self._path(f"{self.folder}/{name}")
        try:
            out = self._fs.create(path, False)
        except Exception as err:
            if self._fs.exists(path):
                return False
            raise err
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        return True

    def read(self, prefix: str = "") -> dict[str, dict]:
        """Contents by name, in one job; files that are still being written are left out."""
        if not any(n.startswith(prefix) for n in self.names()):
            return {}
        rows = self.spark.read.text(f"{self.folder}/{prefix}*", wholetext=True)
        found = rows.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value").collect()
        return {r.name: json.loads(r.value) for r in sorted(found, key=lambda r: r.name) if r.value}

    def delete(self, folder: str) -> None:
        self._fs.delete(self._path(folder), True)
