"""Detections: filter, clip, best of an image, counts.

detections: image_id, det_id, class_id, confidence, x1, y1, x2, y2, img_w, img_h.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.constants import CONFIDENCE_THRESHOLD, UNKNOWN_CLASS
from kindred.functions import boxes, text

CORNERS = ["x1", "y1", "x2", "y2"]


def confident(detections: DataFrame, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    return detections.filter(F.col("confidence") > threshold)


def listed(detections: DataFrame, clip: bool = True) -> DataFrame:
    """Detections with class name, confidence of 4 digits and whole-pixel corners."""
    corners = [F.col(c) for c in CORNERS]
    pixels = (
        boxes.clip_box(*corners, F.col("img_w"), F.col("img_h")) if clip else boxes.whole_pixels(*corners)
    )
    return detections.select(
        "image_id",
        "det_id",
        text.class_name(F.col("class_id"), UNKNOWN_CLASS).alias("class"),
        F.round("confidence", 4).alias("confidence"),
        *[p.alias(c) for p, c in zip(pixels, CORNERS)],
    )


def detections_per_image(
    images: DataFrame,
    detections: DataFrame,
    threshold: float = CONFIDENCE_THRESHOLD,
    clip: bool = True,
) -> DataFrame:
    """One row for each detection of every image: image_id, det_id, class, confidence, coordinate.

    images: image_id, one row each. An image without any keeps one row of nulls. The list of an image is its rows
    in the order of det_id; rows are neither gathered nor split, so an image may have any number of them.
    """
    kept = listed(confident(detections, threshold), clip)
    found = kept.select("image_id", "det_id", "class", "confidence", F.array(*CORNERS).alias("coordinate"))
    return images.select("image_id").join(found, "image_id", "left")


def best_detection(detections: DataFrame, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """The most confident detection of each image, the first id among equals, before the crop rule."""
    best = Window.partitionBy("image_id").orderBy(F.desc("confidence"), "det_id")
    return (
        confident(detections, threshold)
        .withColumn("_place", F.row_number().over(best))
        .filter(F.col("_place") == 1)
        .drop("_place")
    )


def crop_rectangle(images: DataFrame, detections: DataFrame, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """Part of each image to use: the best box, or the whole image when there is none or it is empty.

    images: image_id, img_w, img_h. Class and confidence are null for the whole image.
    """
    best = listed(best_detection(detections, threshold)).drop("det_id")
    usable = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))

    def if_usable(value: Column, otherwise: Column) -> Column:
        return F.when(usable, value).otherwise(otherwise)

    return images.select("image_id", "img_w", "img_h").join(best, "image_id", "left").select(
        "image_id",
        if_usable(F.col("class"), F.lit(None)).alias("class"),
        if_usable(F.col("confidence"), F.lit(None)).alias("confidence"),
        if_usable(F.col("x1"), F.lit(0)).alias("x1"),
        if_usable(F.col("y1"), F.lit(0)).alias("y1"),
        if_usable(F.col("x2"), F.col("img_w").cast("int")).alias("x2"),
        if_usable(F.col("y2"), F.col("img_h").cast("int")).alias("y2"),
    )


def class_counts(detections: DataFrame, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """Detections per class of each image and their share: image_id, class, detections, share."""
    named = confident(detections, threshold).select(
        "image_id", text.class_name(F.col("class_id"), UNKNOWN_CLASS).alias("class")
    )
    counts = named.groupBy("image_id", "class").agg(F.count("*").alias("detections"))
    share = F.col("detections") / F.sum("detections").over(Window.partitionBy("image_id"))
    return counts.withColumn("share", F.round(share, 6))
