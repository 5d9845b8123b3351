"""Ground-truth build: metadata and features to diverse queries and their exact candidates."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.constants import (
    CANDIDATES_PER_QUERY,
    DIVERSITY_THRESHOLD,
    EMBEDDING_DIM,
    QUERIES_PER_CATEGORY,
)
from kindred.functions import text
from kindred.operators.catalogue import features_join_meta
from kindred.operators.diverse import diverse_queries
from kindred.operators.search import cosine_topk
from kindred.operators.skew import sent_if_small
from kindred.runtime import stored
from kindred.sinks.documents import queries_document, selection_document, write_text
from kindred.sources.features import read_features
from kindred.sources.images import read_image_meta


@dataclass(frozen=True)
class GroundTruth:
    """items: category, image_uuid, image_url, embedding. queries and candidates as the review reads them."""

    items: DataFrame
    queries: DataFrame
    candidates: DataFrame


def build(
    items: DataFrame,
    queries_per_category: int = QUERIES_PER_CATEGORY,
    candidates_per_query: int = CANDIDATES_PER_QUERY,
    threshold: float = DIVERSITY_THRESHOLD,
) -> GroundTruth:
    """Queries and candidates of a catalogue table (category, image_uuid, image_url, embedding)."""
    vectors = items.select(F.col("category").alias("group"), F.col("image_uuid").alias("id"), "embedding")
    picks = diverse_queries(vectors, queries_per_category, threshold)
    # Picks are local rows: categories times queries per category.
    rows = picks.count()
    few = sent_if_small(picks.select("group", "id"), rows)
    found = cosine_topk(vectors, vectors.join(few, ["group", "id"]), candidates_per_query)
    urls = items.select("image_uuid", "image_url")
    queries = (
        urls.join(sent_if_small(picks.withColumnRenamed("id", "image_uuid"), rows), "image_uuid")
        .withColumn("query_id", text.query_id(F.col("group"), F.col("ordinal")))
        .select(
            "query_id",
            F.col("group").alias("category"),
            "ordinal",
            "image_uuid",
            "image_url",
            "max_similarity",
            "over_threshold",
        )
    )
    keys = picks.select(F.col("id").alias("query"), text.query_id(F.col("group"), F.col("ordinal")).alias("query_id"))
    named = found.join(sent_if_small(keys, rows), "query").withColumnRenamed("id", "image_uuid")
    listed = sent_if_small(named, rows * candidates_per_query)
    candidates = urls.join(listed, "image_uuid").select("query_id", "rank", "image_uuid", "image_url", "similarity")
    return GroundTruth(items, queries, candidates)


def build_from_files(
    spark: SparkSession,
    image_lists: str,
    features: str,
    output: str,
    created_at: str,
    queries_per_category: int = QUERIES_PER_CATEGORY,
    candidates_per_query: int = CANDIDATES_PER_QUERY,
    threshold: float = DIVERSITY_THRESHOLD,
    dim: int = EMBEDDING_DIM,
) -> GroundTruth:
    """The same from image lists and feature chunks; writes queries.json and, if absent, selections.json.

    The joined catalogue is stored once, by category: the passes of the selection and the search read it.
    """
    meta = read_image_meta(spark, image_lists)
    joined = features_join_meta(read_features(spark, features), meta, dim)
    items = stored(joined.select("image_uuid", "image_url", "embedding", "category"), "catalogue", ("category",))
    truth = build(items, queries_per_category, candidates_per_query, threshold)
    document = queries_document(
        truth.queries,
        truth.candidates,
        items.groupBy("category").agg(F.count("*").alias("total_images")),
        created_at,
        image_lists,
        threshold,
        queries_per_category,
        candidates_per_query,
    )
    write_text(document, f"{output}/queries.json")
    nothing = spark.createDataFrame([], "query_id string, selected_image_ids array<string>, completed_at string")
    write_text(selection_document(nothing), f"{output}/selections.json", mode="ignore")
    return truth
