"""Small files of a folder that the driver creates, each name once, whoever is first."""

import os
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


class Marks:
    """Names in a folder with a short text each. create gives a name to one of several writers only.

    The text is written under another name first, so a mark is never seen half written. On a local or mounted file
    system the name is taken by a link, elsewhere by a rename, which on such file systems does not replace a file.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        if not self._files.exists(self._path):
            return []
        listed = (status.getPath().getName() for status in self._files.listStatus(self._path))
        return [name for name in listed if name[0] not in "._"]

    def numbers(self) -> list[int]:
        """Names that are numbers, in ascending order."""
        return sorted(int(name) for name in self.names() if name.isdigit())

    def text(self, name: str) -> str:
        stream = self._files.open(self._child(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whether the name was free; it then holds the text."""
        place, draft = self._child(name), self._child(f".{uuid.uuid4().hex}")
        self._files.mkdirs(self._path)
        if self._files.exists(place):
            return False
        if self._files.getUri().getScheme() == "file":
            hidden = Path(draft.toUri().getPath())
            hidden.write_text(text, encoding="utf-8")
            try:
                os.link(hidden, place.toUri().getPath())
            except FileExistsError:
                return False
            finally:
                hidden.unlink()
            return True
        stream = self._files.create(draft, False)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        if self._files.rename(draft, place):
            return True
        self._files.delete(draft, False)
        return False

    def _child(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._path, name)
