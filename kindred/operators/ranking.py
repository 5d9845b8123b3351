"""Queries with most answers per category."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.constants import TEST_QUERIES_PER_CATEGORY
from kindred.functions import text


def rank_queries(selections: DataFrame, queries: DataFrame, top_n: int = TEST_QUERIES_PER_CATEGORY) -> DataFrame:
    """Top queries by number of answers; the category comes from the id, ids of no category are left out.

    Only the ranked rows are joined with the query table, which may lack them.
    """
    answers = selections.select(
        text.category_from_query_id(F.col("query_id")).alias("category"),
        "query_id",
        F.size("selected_image_ids").alias("ground_truth_count"),
        F.col("selected_image_ids").alias("ground_truth"),
    ).filter(F.col("category").isNotNull())
    order = Window.partitionBy("category").orderBy(F.desc("ground_truth_count"), "query_id")
    ranked = answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)
    meta = queries.select("query_id", "image_uuid", "image_url")
    return ranked.join(meta, "query_id", "left").select(
        "category",
        "rank",
        "query_id",
        F.coalesce("image_uuid", F.lit("")).alias("image_uuid"),
        F.coalesce("image_url", F.lit("")).alias("image_url"),
        "ground_truth_count",
        "ground_truth",
    )


def rank_cutoff(selections: DataFrame, top_n: int = TEST_QUERIES_PER_CATEGORY) -> DataFrame:
    """Per category the number of queries and the answers of the last ranked one, null if all were ranked."""
    counts = selections.select(
        text.category_from_query_id(F.col("query_id")).alias("category"),
        "query_id",
        F.size("selected_image_ids").alias("answers"),
    ).filter(F.col("category").isNotNull())
    order = Window.partitionBy("category").orderBy(F.desc("answers"), "query_id")
    last = (
        counts.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top_n)
        .groupBy("category")
        .agg(F.min("answers").alias("last"))
    )
    return (
        counts.groupBy("category")
        .agg(F.count("*").alias("queries"))
        .join(last, "category")
        .select("category", "queries", F.when(F.col("queries") > top_n, F.col("last")).alias("cutoff"))
    )
