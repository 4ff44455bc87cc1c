"""Files of any store that Hadoop reaches, from the driver: metadata, and finished parts that are to be one named file."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def full(self, path: str) -> str:
        """Absolute, local ones without a scheme."""
        fs, p = self._at(path)
        text = fs.makeQualified(p).toString()
        return "/" + text[5:].lstrip("/") if text.startswith("file:") else text

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def is_folder(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getFileStatus(p).getLen()

    def read(self, path: str) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, path: str, data: bytes, replace: bool = True) -> bool:
        """False, and nothing written, if the file is there already and not to be replaced."""
        fs, p = self._at(path)
        try:
            stream = fs.create(p, replace)
        except Py4JJavaError as e:
            if not replace and "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        return True

    def move(self, source: str, target: str) -> None:
        fs, p = self._at(source)
        to = self.jvm.org.apache.hadoop.fs.Path(target)
        fs.mkdirs(to.getParent())
        if fs.exists(to):
            fs.delete(to, False)
        if not fs.rename(p, to):
            raise OSError(f"cannot move {source} to {target}")

    def concatenate(self, sources: list[str], target: str) -> None:
        """One file of several, which stay; it appears under its name when it is whole."""
        fs, to = self._at(target + ".part")
        out = fs.create(to, True)
        try:
            for source in sources:
                own, p = self._at(source)
                stream = own.open(p)
                try:
                    self.jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out)
                finally:
                    stream.close()
        finally:
            out.close()
        self.move(target + ".part", target)

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def walk(self, path: str, suffix: str) -> list[str]:
        fs, p = self._at(path)
        out, it = [], fs.listFiles(p, True)
        while it.hasNext():
            text = it.next().getPath().toString()
            if text.endswith(suffix):
                out.append("/" + text[5:].lstrip("/") if text.startswith("file:") else text)
        return sorted(out)
