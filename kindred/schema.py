"""Explicit schemas of the files and tables. Ids are text: they must never be inferred as numbers."""

from pyspark.sql import types as T

IMAGE_LIST = T.StructType(
    [
        T.StructField("image_uuid", T.StringType()),
        T.StructField("image_url", T.StringType()),
        T.StructField("image_original_name", T.StringType()),
    ]
)

FEATURE_FILE = T.StructType(
    [
        T.StructField("image_uuid", T.StringType()),
        T.StructField("img_feature_value_base64", T.StringType()),
        T.StructField("img_feature_order", T.StringType()),
        T.StructField("img_embedding_base64", T.StringType()),
    ]
)

CANDIDATE = T.StructType(
    [
        T.StructField("image_uuid", T.StringType()),
        T.StructField("image_url", T.StringType()),
        T.StructField("similarity", T.DoubleType()),
    ]
)

QUERY = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("image_uuid", T.StringType()),
        T.StructField("image_url", T.StringType()),
        T.StructField("candidates", T.ArrayType(CANDIDATE)),
    ]
)

CATEGORY_QUERIES = T.StructType(
    [
        T.StructField("total_images", T.LongType()),
        T.StructField("queries", T.ArrayType(QUERY)),
    ]
)

QUERY_METADATA = T.StructType(
    [
        T.StructField("created_at", T.StringType()),
        T.StructField("csv_dir", T.StringType()),
        T.StructField("total_images", T.LongType()),
        T.StructField("diversity_threshold", T.DoubleType()),
        T.StructField("queries_per_category", T.IntegerType()),
        T.StructField("candidates_per_query", T.IntegerType()),
    ]
)

QUERY_DOCUMENT = T.StructType(
    [
        T.StructField("metadata", QUERY_METADATA),
        T.StructField("categories", T.MapType(T.StringType(), CATEGORY_QUERIES)),
    ]
)

SELECTION = T.StructType(
    [
        T.StructField("selected_image_ids", T.ArrayType(T.StringType())),
        T.StructField("completed_at", T.StringType()),
    ]
)
SELECTION_DOCUMENT = T.MapType(T.StringType(), SELECTION)

REVIEWED = T.StructType(SELECTION.fields + [T.StructField("total_results", T.IntegerType())])
REVIEWED_DOCUMENT = T.MapType(T.StringType(), REVIEWED)

EVALUATION_ROW = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("hit", T.LongType()),
        T.StructField("retrieved", T.LongType()),
        T.StructField("relevant", T.LongType()),
        T.StructField("precision", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
    ]
)
EVALUATION_SUMMARY = T.StructType(
    [
        T.StructField("query_count", T.LongType()),
        T.StructField("avg_precision", T.DoubleType()),
        T.StructField("avg_recall", T.DoubleType()),
    ]
)
EVALUATION_DOCUMENT = T.StructType(
    [
        T.StructField("details", T.MapType(T.StringType(), T.ArrayType(EVALUATION_ROW))),
        T.StructField("summary", T.MapType(T.StringType(), EVALUATION_SUMMARY)),
    ]
)

LABELME = T.StructType(
    [
        T.StructField("imageWidth", T.IntegerType()),
        T.StructField("imageHeight", T.IntegerType()),
        T.StructField(
            "shapes",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("shape_type", T.StringType()),
                        T.StructField("points", T.ArrayType(T.ArrayType(T.DoubleType()))),
                    ]
                )
            ),
        ),
    ]
)

# What a scoring job returns, one row per input row.
SCORED = T.StructType(
    [
        T.StructField("image_uuid", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("channel_order", T.StringType()),
        T.StructField("signature", T.BinaryType()),
        T.StructField("embedding", T.BinaryType()),
        T.StructField("name", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("latency_ms", T.DoubleType()),
    ]
)
