"""Catalogue entities derived from the star-schema tables, so that every operator runs on real volume.

The same derivations are stated in SQL in kindred.plans.expected.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.constants import CLASS_NAMES, KOREAN_TO_ENGLISH
from kindred.functions import text, vectors
from kindred.operators.backbones import Backbone

KOREAN = list(KOREAN_TO_ENGLISH)
STAGES = [8, 8, 16, 32]
CHANNELS = 25
DIM = 64
BACKBONES = [
    Backbone("vgg16", "VGG16"),
    Backbone("efficientnet", "EfficientNet-B0"),
    Backbone("lite4", "EfficientNet-Lite4", loaded=False),
]


class Tables:
    """Tables of one data folder, read with the columns a plan asks for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def picked(names: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), index.cast("int"))


def text_of(column: str) -> Column:
    return F.col(column).cast("string")


# Items: one per embedding. Labels 0-4 are the named categories.


def vector_items(t: Tables) -> DataFrame:
    """group, id, embedding."""
    return t.embeddings.select(F.col("label").alias("group"), F.col("vec_id").alias("id"), "embedding")


def with_codes(items: DataFrame) -> DataFrame:
    """Items with channels and words computed from the embedding."""
    signature = vectors.stage_signature(vectors.stage_slices(F.col("embedding"), STAGES))
    return items.withColumn("channels", vectors.top_channels(signature, CHANNELS)).withColumn(
        "words", vectors.bit_words(vectors.binarize(F.col("embedding")))
    )


def catalogue_items(t: Tables) -> DataFrame:
    """category, image_uuid, image_url, embedding of the named categories."""
    category = picked(CLASS_NAMES, F.col("label"))
    return t.embeddings.filter(F.col("label") < len(CLASS_NAMES)).select(
        category.alias("category"),
        text_of("vec_id").alias("image_uuid"),
        F.concat(F.lit("/upload/"), category, F.lit("/"), "vec_id", F.lit(".jpg")).alias("image_url"),
        "embedding",
    )


def features(t: Tables) -> DataFrame:
    """image_uuid, embedding; label 9 has a wrong width."""
    return t.embeddings.select(
        (F.col("vec_id") * 5).cast("string").alias("image_uuid"),
        F.when(F.col("label") == 9, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("embedding"),
    )


def pixels(t: Tables) -> DataFrame:
    """vec_id and a 4 x 4 image of three channels."""
    values = F.transform(F.slice("embedding", 1, 48), lambda x: F.floor(F.abs(x.cast("double")) * 255))
    return t.embeddings.select("vec_id", values.alias("pixels"))


# Image lists.


def part_urls(t: Tables, *more: Column) -> DataFrame:
    """p_partkey, image_url: Korean, English, one-part and doubled paths; more columns of part beside them."""
    key = F.col("p_partkey")
    name = F.concat(key.cast("string"), F.lit(".jpg"))
    kind = F.pmod(key, F.lit(8))
    url = (
        F.when(kind < 5, F.concat(F.lit("/upload/"), picked(KOREAN, kind), F.lit("/"), name))
        .when(kind == 5, F.concat(F.lit("/upload/bag/"), name))
        .when(kind == 6, name)
        .otherwise(F.concat(F.lit("/upload//upload/의류/가방_"), name))
    )
    return t.part.select("p_partkey", url.alias("image_url"), *more)


def line_images(t: Tables) -> DataFrame:
    """Image list with many rows per uuid, and the columns that order them."""
    kind = F.pmod(F.col("l_suppkey"), F.lit(6))
    folder = F.coalesce(picked(KOREAN, kind), F.lit("etc"))
    return t.lineitem.select(
        text_of("l_partkey").alias("image_uuid"),
        F.concat(F.lit("/upload/"), folder, F.lit("/"), "l_partkey", F.lit("_"), "l_suppkey", F.lit(".jpg")).alias(
            "image_url"
        ),
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
    )


def scored_lines(t: Tables) -> DataFrame:
    """Extraction results: name, status, reason."""
    failed = F.col("l_quantity") <= 3
    return t.lineitem.select(
        F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey").alias("name"),
        F.when(failed, "failed").otherwise("ok").alias("status"),
        F.when(failed, F.concat(F.lit("quantity "), F.col("l_quantity").cast("int"))).alias("reason"),
    )


# Detections: one per event.


def detections(t: Tables) -> DataFrame:
    kinds = {"click": 0, "view": 1, "purchase": 2, "signup": 3, "error": 7}
    key = F.col("event_id")

    def step(factor: int, span: int, shift: float) -> Column:
        return F.pmod(key * factor, F.lit(span)) + F.lit(shift)

    x1, y1 = step(7, 330, -19.5), step(11, 340, -29.75)
    return t.events.select(
        F.col("user_id").alias("image_id"),
        key.alias("det_id"),
        text.lookup(F.col("event_type"), kinds).alias("class_id"),
        F.least(F.col("value") / 210, F.lit(1.0)).alias("confidence"),
        x1.alias("x1"),
        y1.alias("y1"),
        (x1 + step(13, 120, -10.0)).alias("x2"),
        (y1 + step(17, 90, -5.0)).alias("y2"),
        F.lit(300).alias("img_w"),
        F.lit(300).alias("img_h"),
    )


def detected_images(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("image_id"), F.lit(300).alias("img_w"), F.lit(300).alias("img_h"))


# Review: queries are orders, candidates are their parts, every line is a submission.


def order_query_id(key: str) -> Column:
    return text.query_id(picked(CLASS_NAMES, F.pmod(F.col(key), F.lit(5))), F.col(key))


def queries(t: Tables) -> DataFrame:
    category = picked(CLASS_NAMES, F.pmod(F.col("o_orderkey"), F.lit(5)))
    return t.orders.select(
        order_query_id("o_orderkey").alias("query_id"),
        category.alias("category"),
        text_of("o_custkey").alias("image_uuid"),
        F.concat(F.lit("/upload/"), category, F.lit("/"), "o_custkey", F.lit(".jpg")).alias("image_url"),
    )


def candidates(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(
        F.min("l_linenumber").alias("rank"), F.round(F.max(1 - F.col("l_discount")), 6).alias("similarity")
    )
    return rows.select(
        order_query_id("l_orderkey").alias("query_id"),
        "rank",
        text_of("l_partkey").alias("image_uuid"),
        F.concat(F.lit("/upload/"), "l_partkey", F.lit(".jpg")).alias("image_url"),
        "similarity",
    )


def submissions(t: Tables) -> DataFrame:
    """Submitted lists with a repeat and foreign ids; every fourth line has foreign ids only."""
    part, foreign = text_of("l_partkey"), F.concat(F.lit("x"), "l_suppkey")
    after = (F.col("l_partkey") + 1).cast("string")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", cents).alias("submission_id"),
        order_query_id("l_orderkey").alias("query_id"),
        F.when(F.pmod("l_linenumber", F.lit(4)) == 0, F.array(foreign, F.lit("y")))
        .otherwise(F.array(part, foreign, part, after))
        .alias("selected_image_ids"),
        F.col("l_shipdate").alias("completed_at"),
    )


def stored_selections(t: Tables) -> DataFrame:
    """Selections made before: one per finished order."""
    return t.orders.filter(F.col("o_orderstatus") == "F").select(
        order_query_id("o_orderkey").alias("query_id"),
        F.array(text_of("o_custkey")).alias("selected_image_ids"),
        F.col("o_orderdate").alias("completed_at"),
    )


def id_run(start: Column, length: Column) -> Column:
    """length consecutive ids from start as text."""
    return F.transform(vectors.positions(length), lambda i: (start + i).cast("string"))


def answer_lists(t: Tables) -> DataFrame:
    """Selections of 0 to 19 ids; every eleventh query has no known category."""
    key = F.col("o_orderkey")
    other = F.concat(F.lit("etc_"), key)
    return t.orders.select(
        F.when(F.pmod(key, F.lit(11)) == 0, other).otherwise(order_query_id("o_orderkey")).alias("query_id"),
        id_run(F.col("o_custkey"), F.pmod(key, F.lit(20))).alias("selected_image_ids"),
    )


def reviewed(t: Tables) -> DataFrame:
    """Two reviewed runs: run, query_id, selected_image_ids, total_results."""
    key = F.col("o_orderkey")
    return t.orders.select(
        F.when(F.col("o_orderstatus") == "F", "a").otherwise("b").alias("run"),
        order_query_id("o_orderkey").alias("query_id"),
        id_run(key, F.pmod(key, F.lit(9))).alias("selected_image_ids"),
        (10 - F.pmod(key, F.lit(2))).cast("int").alias("total_results"),
    )


def run_pair(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Two runs over overlapping queries with overlapping ids."""
    key, query = F.col("o_orderkey"), order_query_id("o_orderkey").alias("query_id")
    a = t.orders.filter(F.col("o_orderstatus") != "O").select(
        query, id_run(key, F.pmod(key, F.lit(10))).alias("selected_image_ids")
    )
    b = t.orders.filter(F.col("o_orderstatus") != "P").select(
        query, id_run(key + 3, F.pmod(key, F.lit(7))).alias("selected_image_ids")
    )
    return a, b


def retrieval(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Retrieved and relevant pairs (query_id, image_uuid), with repeats."""
    query = order_query_id("l_orderkey").alias("query_id")
    retrieved = t.lineitem.filter(F.col("l_returnflag") != "A").select(query, text_of("l_partkey").alias("image_uuid"))
    relevant = t.lineitem.filter(F.col("l_returnflag") != "N")
    foreign = F.concat(F.lit("x"), "l_suppkey").alias("image_uuid")
    return retrieved, relevant.select(query, text_of("l_partkey").alias("image_uuid")).unionByName(
        relevant.filter(F.col("l_linestatus") == "O").select(query, foreign)
    )


# Requests for extractors: one per order.


def requests(t: Tables) -> DataFrame:
    key = F.pmod(F.col("o_orderkey"), F.lit(6))
    asked = {
        1: ["vgg16"],
        2: ["efficientnet", "vgg16", "efficientnet"],
        3: ["resnet", "vgg16"],
        4: ["resnet"],
        5: ["lite4", "efficientnet"],
    }
    names = F.lit(None).cast("array<string>")
    for kind, wanted in asked.items():
        names = F.when(key == kind, F.array(*[F.lit(w) for w in wanted])).otherwise(names)
    return t.orders.select(F.col("o_orderkey").alias("request_id"), names.alias("names"))


def backbone_runs(t: Tables) -> DataFrame:
    """Results of every extractor for every request: request_id, name, status, channel_order, reason, latency_ms."""
    runs = t.orders.select(
        "o_orderkey", "o_totalprice", F.explode(F.array(*[F.lit(b.name) for b in BACKBONES])).alias("name")
    )
    bad = F.pmod(F.col("o_orderkey") + F.length("name"), F.lit(13)) == 0
    return runs.select(
        F.col("o_orderkey").alias("request_id"),
        "name",
        F.when(bad, "failed").otherwise("ok").alias("status"),
        F.when(~bad, F.format_string("[%d, %d]", F.col("o_orderkey"), F.length("name"))).alias("channel_order"),
        F.when(bad, F.concat(F.lit("cannot run "), "name")).alias("reason"),
        F.when(~bad, F.col("o_totalprice") / 1003).alias("latency_ms"),
    )


# Training data: one annotated file per part.


def labelme(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    kind = F.pmod(key, F.lit(7))
    title = F.concat_ws(" ", "p_name", "p_partkey")
    prefix = F.when(kind < 5, F.concat(F.lit("["), picked(KOREAN, kind), F.lit("] "))).when(
        kind == 5, F.lit("[기타] ")
    ).otherwise(F.lit(""))
    stem = F.concat(prefix, title)

    def corner(factor: int, step: int, span: int, j: Column) -> Column:
        return (F.pmod(key * factor + j * step, F.lit(span)) - 10).cast("double")

    def shape(j: Column) -> Column:
        first = F.array(corner(7, 31, 320, j), corner(11, 17, 260, j))
        second = F.array(corner(13, 29, 320, j), corner(5, 41, 260, j))
        kind_of = F.when(F.pmod(key + j, F.lit(3)) != 0, "rectangle").otherwise("polygon")
        return F.struct(kind_of.alias("shape_type"), F.array(first, second).alias("points"))

    return t.part.select(
        stem.alias("stem"),
        F.concat(stem, F.lit(".json")).alias("file_name"),
        F.when(F.pmod(key, F.lit(23)) == 0, 0).otherwise(300).alias("imageWidth"),
        F.lit(240).alias("imageHeight"),
        F.transform(vectors.positions(F.pmod(key, F.lit(4))), shape).alias("shapes"),
        "p_size",
    )


def label_images(t: Tables) -> DataFrame:
    """Image files beside the annotations: stem, ext."""
    files = labelme(t).select("stem", "p_size")
    jpg = files.filter(F.col("p_size") >= 20).select("stem", F.lit(".jpg").alias("ext"))
    return jpg.unionByName(files.filter(F.col("p_size").between(10, 34)).select("stem", F.lit(".png").alias("ext")))
