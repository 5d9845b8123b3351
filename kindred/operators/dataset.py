"""Detection training data: label conversion, image match, stratified split, manifest, statistics.

labelme: stem, file_name, imageWidth, imageHeight, shapes.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.constants import CLASS_NAMES, SPLIT_SEED, VALIDATION_RATIO
from kindred.functions import boxes, text
from kindred.operators.positions import smallest_share


def with_class(labelme: DataFrame) -> DataFrame:
    return labelme.withColumn("class_id", text.class_id_from_file_name(F.col("file_name")))


def _boxes() -> Column:
    """Rectangles as relative boxes; null when the file cannot be converted."""
    sized = (F.col("imageWidth") != 0) & (F.col("imageHeight") != 0)
    rectangles = F.filter("shapes", lambda s: s["shape_type"] == "rectangle")
    converted = F.transform(
        rectangles, lambda s: boxes.box_to_centre(s["points"], F.col("imageWidth"), F.col("imageHeight"))
    )
    usable = F.coalesce(sized, F.lit(False)) & F.col("class_id").isNotNull() & (F.size(rectangles) > 0)
    return F.when(usable, converted)


def with_labels(labelme: DataFrame) -> DataFrame:
    """Files with class_id, boxes and label text, both null for a file that fails. Row by row, no shuffle."""

    def line(b: Column) -> Column:
        return text.label_line(F.col("class_id"), b["cx"], b["cy"], b["w"], b["h"])

    return (
        with_class(labelme)
        .withColumn("boxes", _boxes())
        .withColumn("label_text", F.array_join(F.transform("boxes", line), "\n"))
    )


def labelme_to_yolo(labelme: DataFrame) -> DataFrame:
    """One row per label: stem, class_id, position, cx, cy, w, h."""
    return with_class(labelme).withColumn("boxes", _boxes()).select(
        "stem", "class_id", F.posexplode("boxes").alias("position", "box")
    ).select("stem", "class_id", "position", "box.*")


def _with_split(classed: DataFrame, ratio: float, seed: int) -> DataFrame:
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("stem")))
    drawn = smallest_share(classed, "class_id", key, "stem", ratio, "is_val")
    return drawn.withColumn("split", F.when(F.col("is_val"), "val").otherwise("train")).drop("is_val")


def stratified_split(labelme: DataFrame, ratio: float = VALIDATION_RATIO, seed: int = SPLIT_SEED) -> DataFrame:
    """stem, class_id, split: floor(rows * ratio) files of each class are val, drawn by a seeded hash."""
    classed = with_class(labelme).filter(F.col("class_id").isNotNull()).select("stem", "class_id")
    return _with_split(classed, ratio, seed)


def label_image_match(files: DataFrame, images: DataFrame) -> DataFrame:
    """Extension of the image beside each label file: .jpg before .png, null when neither exists.

    files: stem and any other columns, which stay. images: stem, ext.
    """
    wanted = [".jpg", ".png"]
    place = F.array_position(F.array(*[F.lit(e) for e in wanted]), F.col("ext"))
    found = images.filter(F.col("ext").isin(wanted)).groupBy("stem").agg(F.min(place).alias("_place"))
    ext = F.get(F.array(*[F.lit(e) for e in wanted]), F.col("_place").cast("int") - 1)
    return files.join(found, "stem", "left").withColumn("ext", ext).drop("_place")


def manifest(
    labelme: DataFrame, images: DataFrame, ratio: float = VALIDATION_RATIO, seed: int = SPLIT_SEED
) -> DataFrame:
    """Every classed file with its outcome: stem, class_id, split, safe_name, ext, label_text, ok."""
    labels = with_labels(labelme).filter(F.col("class_id").isNotNull()).select("stem", "class_id", "label_text")
    return label_image_match(_with_split(labels, ratio, seed), images).select(
        "stem",
        "class_id",
        "split",
        text.safe_name(text.class_name(F.col("class_id")), F.col("stem")).alias("safe_name"),
        "ext",
        "label_text",
        (F.col("label_text").isNotNull() & F.col("ext").isNotNull()).alias("ok"),
    )


def label_files(manifest_rows: DataFrame) -> DataFrame:
    """Text of each label file; of several files with one name the last stem stands: split, safe_name, label_text."""
    last = Window.partitionBy("split", "safe_name").orderBy(F.desc("stem"))
    return (
        manifest_rows.filter("ok")
        .withColumn("_place", F.row_number().over(last))
        .filter(F.col("_place") == 1)
        .select("split", "safe_name", "label_text")
    )


def split_stats(labelme: DataFrame, manifest_rows: DataFrame) -> DataFrame:
    """One row: train, val, failed, skipped (files without a class)."""
    outcome = manifest_rows.agg(
        F.count_if(F.col("ok") & (F.col("split") == "train")).alias("train"),
        F.count_if(F.col("ok") & (F.col("split") == "val")).alias("val"),
        F.count_if(~F.col("ok")).alias("failed"),
    )
    skipped = with_class(labelme).agg(F.count_if(F.col("class_id").isNull()).alias("skipped"))
    counted = outcome.unionByName(skipped, allowMissingColumns=True)
    return counted.agg(*[F.sum(c).alias(c) for c in ("train", "val", "failed", "skipped")])


def class_distribution(labels: DataFrame) -> DataFrame:
    """Labels per class, every class listed: class_id, class, labels. labels: class_id."""
    spark = labels.sparkSession
    classes = spark.createDataFrame(list(enumerate(CLASS_NAMES)), "class_id int, class string")
    counts = labels.groupBy("class_id").agg(F.count("*").alias("n"))
    return classes.join(counts, "class_id", "left").select(
        "class_id", "class", F.coalesce("n", F.lit(0)).alias("labels")
    )


def split_file_counts(files: DataFrame) -> DataFrame:
    """Files per split and kind. files: split, kind."""
    return files.groupBy("split", "kind").agg(F.count("*").alias("files"))
