"""Feature chunks, failure log and co-located catalogue tables."""

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.constants import ROWS_PER_FILE
from kindred.operators.positions import numbered_as_stored
from kindred.runtime import stored
from kindred.sources.features import existing_file_index

FILE_PREFIX = "efficientNet"


def write_feature_files(
    rows: DataFrame,
    path: str,
    start: int | None = None,
    per_file: int = ROWS_PER_FILE,
    shape: Callable[[DataFrame], DataFrame] = lambda stored_rows: stored_rows,
    count: int | None = None,
) -> int:
    """Append features in chunks of per_file rows, one folder per chunk, numbered after the existing ones: number of chunks.

    Rows are numbered as they lie in their stored files, so nothing is sorted or shuffled: each task writes the chunks of its
    rows, and a chunk that goes on in another task's rows has a file of either. rows is stored first, unless its row count is
    given, which says that it is a stored table; shape turns its columns into those of the feature files.
    """
    spark = rows.sparkSession
    if start is None:
        start = existing_file_index(spark, path)
    if count is None:
        rows = stored(rows, "features")
        count = rows.count()
    numbered = numbered_as_stored(rows)
    file_no = F.floor(F.col("position") / per_file) + start + 1
    named = numbered.withColumn("feature_file", F.format_string(f"{FILE_PREFIX}_%03d", file_no.cast("bigint")))
    shaped = shape(named.drop("position"))
    shaped.write.partitionBy("feature_file").mode("append").option("header", "true").option("escape", '"').csv(path)
    return math.ceil(count / per_file)


def write_failure_log(lines: DataFrame, path: str) -> bool:
    """Write the lines as text if there are any."""
    if lines.isEmpty():
        return False
    lines.write.mode("overwrite").text(path)
    return True


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Save as a table bucketed by key: joins of such tables on the key need no shuffle."""
    df.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(table)
