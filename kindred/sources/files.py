"""Helpers shared by the readers."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, pattern: str, recursive: bool = False) -> DataFrame:
    """Paths that match; the files are listed, their content is not read. Spark skips files of no bytes."""
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(pattern).select("path")


def exists(spark: SparkSession, pattern: str) -> bool:
    try:
        list_files(spark, pattern)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def metadata_text(field: str) -> Column:
    """A path or name of the _metadata column as it is on disk; Spark gives it percent-encoded."""
    return F.url_decode(F.replace(F.col(f"_metadata.{field}"), F.lit("+"), F.lit("%2B")))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder_name(path: Column) -> Column:
    """Name of the folder that holds the file."""
    return F.element_at(F.split(path, "/"), -2)


def stem(name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def extension(name: Column) -> Column:
    return F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)
