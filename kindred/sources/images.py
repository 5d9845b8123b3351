"""Image lists and image files."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred import schema
from kindred.operators import catalogue
from kindred.sources import files

# Columns that give the place of a row in its list: file by name, block of the file, row.
LIST_ORDER = ["file_name", "file_block", "row"]


SHORT_ROW = "_short_row"


def list_reader(reader, multi_line: bool = True):
    """A batch or stream reader of image lists; rows shorter than the list's columns carry their text in SHORT_ROW."""
    fields = T.StructType(schema.IMAGE_LIST.fields + [T.StructField(SHORT_ROW, T.StringType())])
    return (
        reader.schema(fields)
        .option("header", "true")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", str(multi_line).lower())
        .option("columnNameOfCorruptRecord", SHORT_ROW)
    )


def with_names(rows: DataFrame, *more: Column) -> DataFrame:
    """Rows of list_reader with their names: the uuid in files without that column; an empty name stays empty."""
    absent = F.col(SHORT_ROW).isNotNull() & F.col("image_original_name").isNull()
    name = F.when(absent, F.col("image_uuid")).otherwise(F.coalesce("image_original_name", F.lit("")))
    return rows.select("image_uuid", "image_url", name.alias("image_original_name"), *more)


def has_quoted_breaks(spark: SparkSession, pattern: str) -> bool:
    """Whether a list has a line break inside quotes: the line before it has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(pattern).filter(quotes % 2 == 1).isEmpty()


def read_image_list(spark: SparkSession, pattern: str, multi_line: bool | None = None) -> DataFrame:
    """Rows of all image lists with their place (LIST_ORDER).

    multi_line keeps line breaks inside quotes, but makes a file one task; without it large files are split over tasks. By default
    the lists are looked through for such breaks, as plain lines.
    """
    multi_line = has_quoted_breaks(spark, pattern) if multi_line is None else multi_line
    return with_names(
        list_reader(spark.read, multi_line).csv(pattern),
        files.metadata_text("file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("file_block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_image_meta(spark: SparkSession, pattern: str, multi_line: bool | None = None) -> DataFrame:
    """One row per uuid, the last one listed: image_uuid, image_url, category. No file is an error."""
    if not files.exists(spark, pattern):
        raise FileNotFoundError(f"no image list: {pattern}")
    return catalogue.image_meta(read_image_list(spark, pattern, multi_line), *LIST_ORDER)


def read_image_files(spark: SparkSession, pattern: str, recursive: bool = False) -> DataFrame:
    """Files by name: path, stem, ext."""
    name = files.file_name(F.col("path"))
    return files.list_files(spark, pattern, recursive).select(
        "path", files.stem(name).alias("stem"), files.extension(name).alias("ext")
    )
