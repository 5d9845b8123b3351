"""Published versions of a table or document: whole or not there, and never without the one before.

A version is written to a folder of its own; a marker with the version's number, which only one writer can take, is
created last. Readers take the newest marked version, so one that is still being written, or was left by a job that failed,
is not seen. Of two writers at once the second gets the next number; one that built on the version before builds again.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kindred.sources.marks import Marks


def _marks(spark: SparkSession, path: str) -> Marks:
    return Marks(spark, f"{path}/published")


def number(spark: SparkSession, path: str) -> int:
    """Number of the newest published version, 0 if there is none."""
    return max(_marks(spark, path).numbers(), default=0)


def folder(spark: SparkSession, path: str, version: int) -> str:
    """Folder of a published version."""
    return f"{path}/versions/{_marks(spark, path).text(str(version))}"


def current(spark: SparkSession, path: str) -> str:
    """Folder of the newest published version; the path itself if it is a plain file, or nothing yet."""
    newest = number(spark, path)
    return folder(spark, path, newest) if newest else path


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> int:
    """Calls write with the folder of a new version and marks it with the next free number when that has ended."""
    name, marks = uuid.uuid4().hex, _marks(spark, path)
    write(f"{path}/versions/{name}")
    version = number(spark, path) + 1
    while not marks.create(str(version), name):
        version += 1
    return version


def publish_on(spark: SparkSession, path: str, write: Callable[[str, int], None]) -> int:
    """Like publish for a version that builds on the one before: write is called with the folder and that version's number (0
    for none), and again on top of the winner if another writer has published in between."""
    marks = _marks(spark, path)
    while True:
        base, name = number(spark, path), uuid.uuid4().hex
        write(f"{path}/versions/{name}", base)
        if marks.create(str(base + 1), name):
            return base + 1


def publish_rows(rows: DataFrame, path: str) -> int:
    return publish(rows.sparkSession, path, rows.write.parquet)
