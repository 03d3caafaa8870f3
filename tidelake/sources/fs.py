"""Small file operations through Hadoop, so any shared store works."""

from __future__ import annotations

from pyspark.sql import SparkSession


class SharedFs:
    """Existence, listing, rename and small text files below one base path."""

    def __init__(self, spark: SparkSession, base: str):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(base).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path)))

    def sizes(self, path: str) -> dict[str, int]:
        """Length of every file directly inside a folder."""
        if not self.exists(path):
            return {}
        found = self._fs.listStatus(self._path(path))
        return {s.getPath().getName(): s.getLen() for s in found if s.isFile()}

    def rename(self, source: str, target: str) -> None:
        parent = self._path(target).getParent()
        self._fs.mkdirs(parent)
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"cannot rename {source} to {target}")

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def create_text(self, path: str, text: str) -> None:
        """Write a new small file as a whole; an existing one is an error."""
        if self.exists(path):
            raise FileExistsError(path)
        part = f"{path}.part"
        stream = self._fs.create(self._path(part), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        self.rename(part, path)

    def read_text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            size = self._fs.getFileStatus(self._path(path)).getLen()
            reader = self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(size))
            return bytes(reader).decode("utf-8")
        finally:
            stream.close()
