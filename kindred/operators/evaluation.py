"""Precision and recall of retrieval runs, and comparison of reviewed runs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import text


def _ratio(part: str, whole: str):
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def per_query(retrieved: DataFrame, relevant: DataFrame) -> DataFrame:
    """hit, retrieved, relevant, precision and recall (3 digits) of every query.

    Both inputs: query_id, image_uuid. Two shuffles: each pair is tagged, merged on (query, image) and
    counted per query, so a query with very many images is spread over tasks before its counts are added.
    """
    tagged = retrieved.select("query_id", "image_uuid", F.lit(1).alias("got"), F.lit(0).alias("right")).unionByName(
        relevant.select("query_id", "image_uuid", F.lit(0).alias("got"), F.lit(1).alias("right"))
    )
    pairs = tagged.groupBy("query_id", "image_uuid").agg(F.max("got").alias("got"), F.max("right").alias("right"))
    counts = pairs.groupBy("query_id").agg(
        F.sum(F.col("got") * F.col("right")).alias("hit"),
        F.sum("got").alias("retrieved"),
        F.sum("right").alias("relevant"),
    )
    return with_ratios(counts)


def with_ratios(counts: DataFrame) -> DataFrame:
    """Counts of hit, retrieved and relevant with precision and recall of 3 digits."""
    return counts.withColumn("precision", F.round(_ratio("hit", "retrieved"), 3)).withColumn(
        "recall", F.round(_ratio("hit", "relevant"), 3)
    )


def summary(evaluated: DataFrame) -> DataFrame:
    """Mean of the per-query values by category: category, query_count, avg_precision, avg_recall."""
    return evaluated.groupBy("category").agg(
        F.count("*").alias("query_count"),
        F.round(F.avg("precision"), 3).alias("avg_precision"),
        F.round(F.avg("recall"), 3).alias("avg_recall"),
    )


def reviewed_precision(reviewed: DataFrame) -> DataFrame:
    """Selected over shown, averaged by run and category; an empty selection counts 0.

    reviewed: run, query_id, selected_image_ids, total_results.
    """
    rate = F.when(F.col("total_results") > 0, F.size("selected_image_ids") / F.col("total_results")).otherwise(0.0)
    return (
        reviewed.withColumn("category", text.category_from_query_id(F.col("query_id")))
        .groupBy("run", "category")
        .agg(F.count("*").alias("query_count"), F.round(F.avg(rate), 3).alias("precision"))
    )


def compare_reviews(run_a: DataFrame, run_b: DataFrame) -> DataFrame:
    """Two reviewed runs query by query: shared, only_a, only_b, and which run has the query."""
    a = run_a.select("query_id", F.array_distinct("selected_image_ids").alias("a"))
    b = run_b.select("query_id", F.array_distinct("selected_image_ids").alias("b"))
    none = F.array().cast("array<string>")
    left, right = F.coalesce("a", none), F.coalesce("b", none)
    return a.join(b, "query_id", "full_outer").select(
        "query_id",
        F.col("a").isNotNull().alias("in_a"),
        F.col("b").isNotNull().alias("in_b"),
        F.size(F.array_intersect(left, right)).alias("shared"),
        F.size(F.array_except(left, right)).alias("only_a"),
        F.size(F.array_except(right, left)).alias("only_b"),
    )
