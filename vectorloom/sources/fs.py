"""Files through Hadoop, so that a path may be on any file system that the cluster knows."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def children(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(p))) if self.exists(p) else []

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, p: str, text: str) -> bool:
        """Whole or not at all, and only if nothing is there yet: written under another name, then renamed without overwriting. Whether it was created."""
        part = f"{p}.{uuid.uuid4().hex}.part"
        out = self.fs.create(self.path(part), False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        try:
            context.rename(self.path(part), self.path(p), options)
        except Exception as e:  # noqa: BLE001 - of the JVM
            self.delete(part)
            if self.exists(p):
                return False
            raise OSError(f"can't create {p}: {e}") from e
        return True

    def write(self, p: str, text: str) -> None:
        """Write a file that is written once, or anew by a single writer."""
        if not self.create(p, text):
            self.delete(p)
            self.create(p, text)

    def rename(self, a: str, b: str) -> None:
        if not self.fs.rename(self.path(a), self.path(b)):
            raise OSError(f"can't rename {a} to {b}")

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)

    def copy(self, a: str, b: str) -> None:
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self.path(a), self.fs, self.path(b), False, self.conf)

    def bytes(self, p: str) -> int:
        return self.fs.getContentSummary(self.path(p)).getLength() if self.exists(p) else 0
