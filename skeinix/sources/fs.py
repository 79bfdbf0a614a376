"""Files of a session's file systems (local, HDFS, object stores) by Hadoop's interface."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..model import EngineError


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def modified(self, path: str) -> float:
        """Seconds since 1970 of the last change of a file, or of what a folder holds (one level)."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return 0.0
        own = fs.getFileStatus(p)
        return max([own.getModificationTime(), *(s.getModificationTime() for s in (fs.listStatus(p) if own.isDirectory() else ()))]) / 1000

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> None:
        """Write a file whole and then give it its name, which must be free: the one point at which a version becomes real."""
        fs, p = self._at(path)
        tmp = self.jvm.org.apache.hadoop.fs.Path(path + ".tmp")
        out = fs.create(tmp, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if fs.exists(p) or not fs.rename(tmp, p):
            fs.delete(tmp, False)
            raise EngineError("BUSY", f"{path} was written by another session")

    def copy(self, src: str, dst: str) -> None:
        a, p = self._at(src)
        b, q = self._at(dst)
        b.mkdirs(q.getParent())
        if not self.jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, self.conf):
            raise EngineError("IO", f"{src} can't be copied")
