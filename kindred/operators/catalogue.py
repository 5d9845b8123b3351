"""Image list, metadata and features: dedup, joins, filters and load counts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.constants import CLASS_NAMES, EMBEDDING_DIM
from kindred.functions import text


def image_meta(images: DataFrame, *order: str) -> DataFrame:
    """One row per uuid, the last in order: image_uuid, image_url in English, category."""
    latest = Window.partitionBy("image_uuid").orderBy(*[F.desc(c) for c in order])
    return (
        images.withColumn("_place", F.row_number().over(latest))
        .filter(F.col("_place") == 1)
        .select(
            "image_uuid",
            text.url_to_english(F.col("image_url")).alias("image_url"),
            text.category_from_url(F.col("image_url")).alias("category"),
        )
    )


def dim_filter(features: DataFrame, dim: int = EMBEDDING_DIM) -> DataFrame:
    return features.filter(F.size("embedding") == dim)


def features_join_meta(features: DataFrame, meta: DataFrame, dim: int = EMBEDDING_DIM) -> DataFrame:
    """Features with url and category; unknown uuids, foreign categories and wrong widths are left out.

    The filters stand before the join, so only rows that can stay are shuffled.
    """
    known = meta.filter(F.col("category").isin(CLASS_NAMES))
    return dim_filter(features, dim).join(known, "image_uuid")


def load_stats(features: DataFrame, meta: DataFrame, dim: int = EMBEDDING_DIM) -> DataFrame:
    """Kept rows per category, and the skipped rows under a null category: category, rows, skipped."""
    widths = features.select("image_uuid", F.size("embedding").alias("width"))
    known = meta.filter(F.col("category").isin(CLASS_NAMES)).select("image_uuid", "category")
    kept = F.when(F.col("width") == dim, F.col("category"))
    counted = widths.join(known, "image_uuid", "left").groupBy(kept.alias("category")).agg(F.count("*").alias("n"))
    skipped = F.col("category").isNull()
    return counted.select(
        "category",
        F.when(skipped, F.lit(0)).otherwise(F.col("n")).alias("rows"),
        F.when(skipped, F.col("n")).otherwise(F.lit(0)).alias("skipped"),
    )


def incremental_todo(images: DataFrame, done: DataFrame) -> DataFrame:
    """Images without a stored result; failures have none and so come back."""
    return images.join(done.select("image_uuid"), "image_uuid", "left_anti")
