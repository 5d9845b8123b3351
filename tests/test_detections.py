from pyspark.sql import functions as F

from kindred.functions import boxes
from kindred.operators import detections

SCHEMA = (
    "image_id bigint, det_id bigint, class_id int, confidence double,"
    " x1 double, y1 double, x2 double, y2 double, img_w int, img_h int"
)
ROWS = [
    (1, 1, 0, 0.912345, -5.7, -0.2, 120.9, 80.5, 100, 60),  # beyond the image
    (1, 2, 5, 0.912345, 1.0, 1.0, 9.0, 9.0, 100, 60),  # equal confidence, unknown class
    (1, 3, 1, 0.5, 0.0, 0.0, 9.0, 9.0, 100, 60),  # at the threshold
    (2, 4, 2, 0.8, 30.0, 5.0, 30.4, 9.0, 100, 60),  # empty after cutting
    (2, 5, 2, 0.7, 1.0, 1.0, 9.0, 9.0, 100, 60),
]


def frames(spark):
    images = spark.createDataFrame([(i, 100, 60) for i in (1, 2, 3)], "image_id bigint, img_w int, img_h int")
    return images, spark.createDataFrame(ROWS, SCHEMA)


def test_detections_per_image(spark):
    images, found = frames(spark)
    got = sorted(map(tuple, detections.detections_per_image(images, found).collect()), key=str)
    assert got[:2] == [(1, 1, "bag", 0.9123, [0, 0, 100, 60]), (1, 2, "unknown", 0.9123, [1, 1, 9, 9])]
    assert [r[:2] for r in got[2:]] == [(2, 4), (2, 5), (3, None)]
    assert got[4] == (3, None, None, None, None)


def test_unclipped_boxes(spark):
    images, found = frames(spark)
    got = detections.detections_per_image(images, found, clip=False).filter("image_id = 1 and det_id = 1").first()
    assert got["coordinate"] == [-5, 0, 120, 80]


def test_one_image_with_very_many_detections(spark):
    images, _ = frames(spark)
    rows = [(1, 10 * i, 0, 0.9, 0.0, 0.0, 1.0, 1.0, 100, 60) for i in range(1000)] + ROWS[3:]
    got = detections.detections_per_image(images, spark.createDataFrame(rows, SCHEMA))
    assert got.count() == 1003
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_best_detection_takes_the_first_of_equals(spark):
    _, found = frames(spark)
    got = {r["image_id"]: r["det_id"] for r in detections.best_detection(found).collect()}
    assert got == {1: 1, 2: 4}


def test_crop_rectangle(spark):
    images, found = frames(spark)
    got = {r["image_id"]: tuple(r)[1:] for r in detections.crop_rectangle(images, found).collect()}
    assert got[1] == ("bag", 0.9123, 0, 0, 100, 60)
    assert got[2] == (None, None, 0, 0, 100, 60)  # empty box: the whole image
    assert got[3] == (None, None, 0, 0, 100, 60)


def test_class_counts(spark):
    _, found = frames(spark)
    got = {(r["image_id"], r["class"]): (r["detections"], r["share"]) for r in detections.class_counts(found).collect()}
    assert got == {(1, "bag"): (1, 0.5), (1, "unknown"): (1, 0.5), (2, "food"): (2, 1.0)}


def test_box_to_centre_clips(spark):
    df = spark.createDataFrame([([[90.0, 70.0], [-10.0, 10.0]],)], "p array<array<double>>")
    got = df.select(boxes.box_to_centre(F.col("p"), F.lit(50), F.lit(50)).alias("b")).first()["b"]
    assert tuple(got) == (0.8, 0.8, 1.0, 1.0)
