"""Label files of the detection data."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred import schema
from kindred.sources import files


def read_labelme(spark: SparkSession, pattern: str) -> DataFrame:
    """One row per file: stem, file_name, imageWidth, imageHeight, shapes."""
    rows = spark.read.schema(schema.LABELME).option("multiLine", "true").json(pattern)
    name = files.metadata_text("file_name")
    return rows.select(files.stem(name).alias("stem"), name.alias("file_name"), "imageWidth", "imageHeight", "shapes")


def read_label_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """One row per label line: split (the folder), file_name, class_id, value."""
    lines = spark.read.text(pattern).filter(F.trim("value") != "")
    return lines.select(
        files.folder_name(files.metadata_text("file_path")).alias("split"),
        files.metadata_text("file_name").alias("file_name"),
        F.get(F.split(F.trim("value"), r"\s+"), F.lit(0)).cast("int").alias("class_id"),
        "value",
    )


def read_split_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below root/kind/split: split, kind, path."""
    folders = F.split("path", "/")
    return files.list_files(spark, root, recursive=True).select(
        F.element_at(folders, -2).alias("split"), F.element_at(folders, -3).alias("kind"), "path"
    )
