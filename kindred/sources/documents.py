"""Nested JSON documents as flat rows.

A document is one file that people exchange; the tables behind it are flat.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred import schema
from kindred.sinks import versions
from kindred.sources import files


def _document(spark: SparkSession, path: str, shape: T.DataType, lines: bool = False) -> DataFrame:
    """Parsed documents: one per file, or one per line as the sinks write tables without a size bound."""
    text = spark.read.text(versions.current(spark, path), wholetext=not lines)
    return text.select(F.from_json("value", shape).alias("doc"))


TEST_QUERY = (
    "query_id string, image_uuid string, image_url string, ground_truth_count int, ground_truth array<string>"
)


def read_test_queries(spark: SparkSession, path: str) -> DataFrame:
    """Ranked queries of a test-query document: category, rank and the columns of TEST_QUERY."""
    shape = T.MapType(T.StringType(), T.ArrayType(T.StructType.fromDDL(TEST_QUERY)))
    lists = _document(spark, path, shape).select(F.explode("doc").alias("category", "queries"))
    rows = lists.select("category", F.posexplode("queries").alias("place", "query"))
    return rows.select("category", (F.col("place") + 1).alias("rank"), "query.*")


def read_query_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Queries (query_id, category, image_uuid, image_url) and candidates (query_id, rank, image_uuid,
    image_url, similarity) of a query document."""
    if not files.exists(spark, path):
        raise FileNotFoundError(f"no query document: {path}; build the ground truth first")
    doc = _document(spark, path, schema.QUERY_DOCUMENT)
    per_query = doc.select(F.explode("doc.categories").alias("category", "entry")).select(
        "category", F.explode("entry.queries").alias("query")
    )
    queries = per_query.select("query.query_id", "category", "query.image_uuid", "query.image_url")
    candidates = per_query.select(
        "query.query_id", F.posexplode("query.candidates").alias("position", "candidate")
    ).select("query_id", (F.col("position") + 1).alias("rank"), "candidate.*")
    return queries, candidates


def _by_query(spark: SparkSession, path: str, shape: T.MapType, lines: bool) -> DataFrame:
    if not files.exists(spark, path):
        entry = T.StructType([T.StructField("query_id", T.StringType()), *shape.valueType.fields])
        rows = spark.createDataFrame([], entry)
    else:
        rows = _document(spark, path, shape, lines).select(F.explode("doc").alias("query_id", "entry"))
        rows = rows.select("query_id", "entry.*")
    return rows.withColumn("completed_at", F.col("completed_at").cast("timestamp_ntz"))


def read_selections(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """query_id, selected_image_ids, completed_at; a missing file has no rows."""
    return _by_query(spark, path, schema.SELECTION_DOCUMENT, lines)


def read_reviewed(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Selections with total_results."""
    return _by_query(spark, path, schema.REVIEWED_DOCUMENT, lines)


def read_evaluation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Details and summary of an evaluation document, by category."""
    doc = _document(spark, path, schema.EVALUATION_DOCUMENT)
    details = doc.select(F.explode("doc.details").alias("category", "rows")).select(
        "category", F.inline("rows")
    )
    summary = doc.select(F.explode("doc.summary").alias("category", "entry")).select("category", "entry.*")
    return details, summary
