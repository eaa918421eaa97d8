"""A small JSON file that points at the current version of a folder, and is swapped in one step.

Writers make a new version beside the old one and move the pointer last, so readers and failed writes never see half a
version; the version before stays until the next swap for those who are still reading it.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Pointer:
    """The pointer file ``name`` below ``path``, on any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, path: str, name: str = "_current.json"):
        self.spark, self.path, self.name = spark, path.rstrip("/"), name

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def read(self) -> Any | None:
        """What was written last; None where nothing was."""
        fs, p = self._fs(f"{self.path}/{self.name}")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()

    def write(self, value: Any) -> None:
        """Replaces what was written; fails loudly, and then the old value stays."""
        fs, new = self._fs(f"{self.path}/{self.name}.{uuid.uuid4().hex}")
        fs.mkdirs(new.getParent())
        stream = fs.create(new, False)
        try:
            stream.write(bytearray(json.dumps(value).encode("utf-8")))
        finally:
            stream.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(new), fs.makeQualified(self._fs(f"{self.path}/{self.name}")[1]), options)

    def remove_others(self, keep: set[str]) -> None:
        """Deletes the folders below ``path`` that are not in ``keep`` (names); files stay."""
        fs, root = self._fs(self.path)
        for status in fs.listStatus(root):
            if status.isDirectory() and status.getPath().getName() not in keep:
                fs.delete(status.getPath(), True)
