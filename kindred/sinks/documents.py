"""Nested JSON documents, published as versions (see versions): whole, and never without the one before.

Lists in them are bounded by the operators that make them: candidates per query, queries per category,
named categories. Tables without such a bound are written as one JSON object per line.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.constants import CLASS_NAMES, EXPORTED_SELECTIONS_PER_QUERY
from kindred.sinks import versions
from kindred.sources import files


def _in_order(*fields: str) -> Column:
    """List of the rows' structs, ordered by their first field, which is then dropped."""
    first, *rest = fields
    listed = F.array_sort(F.collect_list(F.struct(*fields)))
    return F.transform(listed, lambda s: F.struct(*[s[f].alias(f) for f in rest]))


def nested_queries(queries: DataFrame, candidates: DataFrame, ordinal: str) -> DataFrame:
    """Per category its queries in order, each with its candidates in rank order: category, queries."""
    lists = candidates.groupBy("query_id").agg(
        _in_order("rank", "image_uuid", "image_url", "similarity").alias("candidates")
    )
    return (
        queries.join(lists, "query_id", "left")
        .groupBy("category")
        .agg(_in_order(ordinal, "query_id", "image_uuid", "image_url", "candidates").alias("queries"))
    )


def queries_document(
    queries: DataFrame,
    candidates: DataFrame,
    images_per_category: DataFrame,
    created_at: str,
    source: str,
    threshold: float,
    queries_per_category: int,
    candidates_per_query: int,
    ordinal: str = "ordinal",
) -> DataFrame:
    """The query document as one row of text: value. Categories without images do not occur.

    images_per_category: category, total_images.
    """
    entries = nested_queries(queries, candidates, ordinal).join(images_per_category, "category")
    place = F.array_position(F.array(*[F.lit(c) for c in CLASS_NAMES]), F.col("category"))
    entry = F.struct("category", F.struct("total_images", "queries").alias("entry"))
    gathered = entries.agg(
        F.sum("total_images").alias("total_images"),
        F.array_sort(F.collect_list(F.struct(place.alias("place"), entry.alias("item")))).alias("items"),
    )
    metadata = F.struct(
        F.lit(created_at).alias("created_at"),
        F.lit(source).alias("csv_dir"),
        "total_images",
        F.lit(threshold).alias("diversity_threshold"),
        F.lit(queries_per_category).alias("queries_per_category"),
        F.lit(candidates_per_query).alias("candidates_per_query"),
    )
    categories = F.map_from_entries(F.transform("items", lambda i: i["item"]))
    return gathered.select(
        F.to_json(F.struct(metadata.alias("metadata"), categories.alias("categories"))).alias("value")
    )


def test_query_document(ranked: DataFrame) -> DataFrame:
    """Ranked queries per category as one row of text; every named category occurs, also when empty."""
    fields = ["query_id", "image_uuid", "image_url", "ground_truth_count", "ground_truth"]
    lists = ranked.groupBy("category").agg(_in_order("rank", *fields).alias("queries"))
    shape = lists.schema["queries"].dataType
    gathered = lists.agg(F.map_from_entries(F.collect_list(F.struct("category", "queries"))).alias("m"))
    empty = F.array().cast(shape)
    entries = [F.coalesce(F.try_element_at("m", F.lit(c)), empty).alias(c) for c in CLASS_NAMES]
    return gathered.select(F.to_json(F.struct(*entries)).alias("value"))


def export_lines(rows: DataFrame) -> DataFrame:
    """One line of JSON per answered query with its relevant images in rank order: value."""
    keys = ["query_id", "category", "query_image_uuid", "query_image_url"]
    listed = F.collect_list(
        F.when(F.col("image_uuid").isNotNull(), F.struct("rank", "image_uuid", "image_url", "similarity"))
    )
    shaped = F.transform(
        F.array_sort(listed), lambda s: F.struct(s["image_uuid"], s["image_url"], s["similarity"])
    )
    lines = rows.groupBy(*keys).agg(shaped.alias("relevant_images"))
    return lines.select(F.to_json(F.struct(*keys, "relevant_images")).alias("value"))


def export_metadata(rows: DataFrame, created_at: str) -> DataFrame:
    """The export's metadata as one line of JSON: value."""
    return rows.agg(F.count_distinct("query_id").alias("total_queries")).select(
        F.to_json(
            F.struct(
                F.lit(created_at).alias("created_at"),
                "total_queries",
                F.lit(EXPORTED_SELECTIONS_PER_QUERY).alias("selections_per_query"),
            )
        ).alias("value")
    )


def selection_document(
    selections: DataFrame, columns: Sequence[str] = ("selected_image_ids", "completed_at")
) -> DataFrame:
    """One line of JSON per query of a selection table: value."""
    entry = F.struct(*[F.col(c) for c in columns])
    return selections.select(F.to_json(F.map_from_arrays(F.array("query_id"), F.array(entry))).alias("value"))


def write_text(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Publish lines as the current version; mode "ignore" keeps what is there."""
    spark = lines.sparkSession
    if mode == "ignore" and (versions.number(spark, path) or files.exists(spark, path)):
        return
    versions.publish(spark, path, lines.write.text)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the current version."""
    return spark.read.text(versions.current(spark, path))
