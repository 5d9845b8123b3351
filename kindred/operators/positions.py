"""Row numbers over a whole table without one task that sees all rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.runtime import checkpointed

# monotonically_increasing_id keeps the partition above this bit and the row below it.
PARTITION_SHIFT = 33


def numbered(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """df sorted by order with a column 0, 1, 2, ... in that order.

    Rows are sorted into ranges once and written; the number of a row is its place in its partition plus
    the sizes of the partitions before. Rows with equal keys may fall into several ranges, so many copies
    of one key do not gather in one task. Only one count per partition is gathered.
    """
    tie = F.monotonically_increasing_id()
    ranged = checkpointed(df.withColumn("_tie", tie).orderBy(*order, "_tie").drop("_tie"))
    placed = ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn(
        "_part", F.shiftright("_at", PARTITION_SHIFT)
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # One row per partition of the sort.
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.col("_at") - F.shiftleft(F.col("_part"), PARTITION_SHIFT)
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + within).drop(
        "_at", "_part", "_before"
    )


def numbered_as_stored(table: DataFrame, name: str = "position") -> DataFrame:
    """A stored parquet table with a column 0, 1, 2, ... in the order of its files and of the rows in them.

    Rows are neither sorted nor moved; only one count per file is gathered, from columns that the files' footers hold.
    """
    placed = table.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    sizes = placed.groupBy("_file").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_file", F.coalesce(before, F.lit(0)).alias("_before"))
    # One row per file, that is per task that has written the table.
    return placed.join(F.broadcast(offsets), "_file").withColumn(name, F.col("_before") + F.col("_row")).drop(
        "_file", "_row", "_before"
    )


def chunk_number(df: DataFrame, *order: str, start: int = 0, rows: int = 500, name: str = "file_no") -> DataFrame:
    """Number of the output file of each row: full files of the given size after start, the rest in the last."""
    file_no = (F.floor(F.col("_position") / rows) + start + 1).cast("bigint")
    return numbered(df, *order, name="_position").withColumn(name, file_no).drop("_position")


def smallest_share(df: DataFrame, group: str, key: Column, tie: str, ratio: float, name: str) -> DataFrame:
    """Flag the floor(rows * ratio) rows of each group with the smallest hexadecimal key.

    The key must be a hash text: its first digits split every group into even parts, so a group of any
    size is ranked in many tasks; the rank is the sizes of the parts before plus the place in the part.
    """
    keyed = df.withColumn("_key", key).withColumn("_part", F.substring("_key", 1, 3))
    parts = keyed.groupBy(group, "_part").agg(F.count("*").alias("_rows"))
    in_order = Window.partitionBy(group).orderBy("_part")
    earlier = F.sum("_rows").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    all_rows = F.sum("_rows").over(Window.partitionBy(group))
    # At most 4096 rows per group.
    offsets = parts.select(
        group, "_part", F.coalesce(earlier, F.lit(0)).alias("_before"), F.floor(all_rows * ratio).alias("_taken")
    )
    place = F.row_number().over(Window.partitionBy(group, "_part").orderBy("_key", tie))
    return (
        keyed.withColumn("_place", place)
        .join(offsets, [group, "_part"])
        .withColumn(name, F.col("_before") + F.col("_place") <= F.col("_taken"))
        .drop("_key", "_part", "_place", "_before", "_taken")
    )
