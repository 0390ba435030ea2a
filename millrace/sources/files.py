"""Small text files and folders on any file system that Hadoop knows."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """List, read, write and delete under any Hadoop path (local, HDFS, object store)."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def full(self, path: str) -> str:
        """The path with its scheme."""
        return self._fs(path).makeQualified(self._path(path)).toUri().toString()

    def names(self, path: str) -> list[str]:
        """Names in a folder, sorted; none if there is no such folder."""
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs(path).listStatus(self._path(path)))

    def size(self, path: str) -> int:
        """Bytes under a file or folder."""
        return self._fs(path).getContentSummary(self._path(path)).getLength()

    def read(self, path: str) -> str:
        stream = self._fs(path).open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Publish a new file in one step; False if somebody else already has.

        No reader sees half of it, and of several writers one wins. On a local disk the text is written beside its place and
        linked there, on HDFS renamed without replacing, both of which the file system carries out in one step; an object
        store shows a file only when it is closed, and refuses a second one as far as it supports conditional writes.
        """
        fs, target = self._fs(path), self._path(path)
        if fs.exists(target):
            return False
        fs.mkdirs(target.getParent())
        scheme = fs.getUri().getScheme()
        if scheme not in ("file", "hdfs", "viewfs"):
            return self._put(fs, target, text)
        side = self._path(f"{path}.{self._jvm.java.util.UUID.randomUUID()}.tmp")
        if not self._put(fs, side, text):
            return False
        try:
            if scheme == "file":
                nio = self._jvm.java.nio.file.Paths
                places = [nio.get(self._jvm.java.net.URI(f"file://{fs.makeQualified(p).toUri().getRawPath()}")) for p in (target, side)]
                self._jvm.java.nio.file.Files.createLink(*places)
                return True
            return bool(fs.rename(side, target))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            fs.delete(side, False)

    @staticmethod
    def _put(fs, path, text: str) -> bool:
        try:
            stream = fs.create(path, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)
