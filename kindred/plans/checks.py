"""Every operator as a query over one data folder."""

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred import schema
from kindred.constants import CANDIDATES_PER_QUERY, DIVERSITY_THRESHOLD, QUERIES_PER_CATEGORY, TOP_CHANNELS
from kindred.functions import boxes, codes, text, vectors
from kindred.operators import (
    backbones,
    catalogue,
    dataset,
    detections,
    diverse,
    evaluation,
    extraction,
    positions,
    ranking,
    review,
    search,
)
from kindred.operators.skew import sent_if_small
from kindred.plans import derived, ground_truth
from kindred.plans.derived import Tables
from kindred.runtime import fresh_path, stored
from kindred.sinks import dataset as dataset_sinks
from kindred.sinks import documents as document_sinks
from kindred.sinks import features as feature_sinks
from kindred.sinks import files as file_sinks
from kindred.sinks.store import FeatureStore
from kindred.sources import documents, features, files, images, labels
from kindred.streaming import extraction as extraction_stream
from kindred.streaming import selections as selection_stream

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
CREATED_AT = "2026-01-01T00:00:00"


def query(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[plan.__name__] = plan
    return plan


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def on_folder(plan):
        return lambda spark, folder: plan(Tables(spark, folder))

    return {name: on_folder(plan) for name, plan in QUERIES.items()}


def listed(values: str | Column) -> Column:
    """An array as text, so that any engine compares it alike."""
    return F.array_join(F.col(values) if isinstance(values, str) else values, ",")


def exploded(df: DataFrame, values: Column, digits: int) -> DataFrame:
    """vec_id, position, value."""
    return df.select("vec_id", F.posexplode(values).alias("position", "v")).select(
        "vec_id", "position", F.round("v", digits).alias("value")
    )


# Vectors and codes


@query
def l2_normalize(t):
    return exploded(t.embeddings, vectors.unit_vector(F.col("embedding")), 9)


def _signature() -> Column:
    return vectors.stage_signature(vectors.stage_slices(F.col("embedding"), derived.STAGES))


@query
def stage_signature(t):
    return exploded(t.embeddings, _signature(), 9)


@query
def channel_means(t):
    hwc = vectors.channel_means(F.col("embedding"), 4)
    chw = vectors.channel_means(F.col("embedding"), 4, "CHW")
    pairs = F.arrays_zip(hwc.alias("hwc"), chw.alias("chw"))
    return t.embeddings.select("vec_id", F.posexplode(pairs).alias("position", "p")).select(
        "vec_id", "position", F.round("p.hwc", 9).alias("hwc"), F.round("p.chw", 9).alias("chw")
    )


@query
def top_channels(t):
    channels = vectors.top_channels(_signature(), derived.CHANNELS)
    return t.embeddings.select("vec_id", codes.int_list_text(channels).alias("channel_order"))


@query
def binarize(t):
    return t.embeddings.select(
        "vec_id", F.array_join(vectors.binarize(F.col("embedding")).cast("array<string>"), "").alias("bits")
    )


@query
def pack_bits(t):
    bits = vectors.binarize(F.col("embedding"))
    return t.embeddings.select(
        "vec_id",
        F.hex(vectors.pack_bits(bits)).alias("packed"),
        listed(vectors.bit_words(bits).cast("array<string>")).alias("words"),
    )


@query
def base64_codes(t):
    packed = t.embeddings.select("vec_id", vectors.pack_bits(vectors.binarize(F.col("embedding"))).alias("code"))
    coded = packed.withColumn("coded", codes.base64_text(F.col("code")))
    return coded.select("vec_id", "coded", F.hex(codes.base64_code(F.col("coded"))).alias("decoded"))


@query
def float16_roundtrip(t):
    coded = t.embeddings.select("vec_id", "embedding", codes.float16_encode("embedding").alias("code"))
    back = coded.withColumn("back", codes.float16_decode("code"))
    # Half precision keeps 11 bits.
    excess = F.array_max(F.zip_with("embedding", "back", lambda a, b: F.abs(a - b) - F.abs(a) / 2048))
    return back.select("vec_id", F.length("code").alias("code_bytes"), (excess < 1e-7).alias("close"))


@query
def channel_standardize(t):
    return exploded(derived.pixels(t), vectors.channel_standardize(F.col("pixels")), 6)


@query
def channel_center_bgr(t):
    return exploded(derived.pixels(t), vectors.channel_center_bgr(F.col("pixels")), 6)


# Selection and search


@query
def diverse_queries(t):
    return diverse.diverse_queries(derived.vector_items(t)).withColumn("max_similarity", F.round("max_similarity", 6))


@query
def max_query_similarity(t):
    picks = diverse.diverse_queries(derived.vector_items(t))
    return diverse.max_query_similarity(picks).withColumn("max_similarity", F.round("max_similarity", 6))


def _searched(t: Tables, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """Items with codes, and the diverse queries among them."""
    items = derived.vector_items(t)
    picks = diverse.diverse_queries(items, n)
    chosen = items.join(sent_if_small(picks.select("group", "id"), picks.count()), ["group", "id"])
    return derived.with_codes(items), derived.with_codes(chosen)


@query
def cosine_topk(t):
    return search.cosine_topk(*_searched(t), k=20)


@query
def cosine_topk_small_group(t):
    """Groups of at most k items: a label and a remainder of the id; every item is a query."""
    items = derived.vector_items(t).withColumn("group", F.col("group") * 40 + F.pmod("id", F.lit(40)))
    return search.cosine_topk(items, items, k=20)


@query
def channel_overlap_topn(t):
    return search.channel_overlap_topn(*_searched(t), n=30)


@query
def hamming_topk(t):
    return search.hamming_topk(*_searched(t), k=20)


@query
def near_signatures(t):
    """The same by rounds of equal parts, which small tables do not need."""
    return search.hamming_topk(*_searched(t), k=20, least_pairs=0)


@query
def hamming_candidates(t):
    """Comparisons of the first round, in parts of 8 bits."""
    return search.compared_signatures(*_searched(t), bits=8)


@query
def rerank_cosine(t):
    items, queries = _searched(t)
    k = 20
    shortlist = search.hamming_topk(items, queries, k)
    return search.rerank_cosine(shortlist, items, queries, 10, shortlist_rows=queries.count() * k)


@query
def three_stage_search(t):
    return search.three_stage_search(*_searched(t), n_channels=30, n_bits=20, k=10)


@query
def indexed_search(t):
    """The cascade over a stored index of the channels."""
    items, queries = _searched(t)
    index = search.channel_index(items.select("group", "id", F.col("channels").alias("payload")))
    return search.three_stage_search(items, queries, n_channels=30, n_bits=20, k=10, index=index)


@query
def three_stage_recall(t):
    items, queries = _searched(t)
    query_id = F.concat_ws("_", "group", "query").alias("query_id")
    found = search.three_stage_search(items, queries, n_channels=30, n_bits=20, k=10)
    exact = search.cosine_topk(items, queries, k=10)
    pair = [query_id, F.col("id").cast("string").alias("image_uuid")]
    return evaluation.per_query(found.select(*pair), exact.select(*pair))


# Image lists, metadata, features


@query
def category_from_url(t):
    return derived.part_urls(t).withColumn("category", text.category_from_url(F.col("image_url")))


@query
def url_to_english(t):
    return derived.part_urls(t).select("p_partkey", text.url_to_english(F.col("image_url")).alias("image_url"))


@query
def resolve_path(t):
    return derived.part_urls(t).select("p_partkey", text.resolve_path(F.col("image_url"), "/data/upload").alias("path"))


@query
def image_meta_dedup(t):
    return catalogue.image_meta(derived.line_images(t), "l_orderkey", "l_linenumber", "l_extendedprice")


@query
def dim_filter(t):
    return catalogue.dim_filter(derived.features(t), derived.DIM).select(
        "image_uuid", F.size("embedding").alias("width")
    )


@query
def features_join_meta(t):
    joined = catalogue.features_join_meta(derived.features(t), image_meta_dedup(t), derived.DIM)
    return joined.select(
        "image_uuid", "image_url", "category", F.round(vectors.norm(F.col("embedding")), 6).alias("norm")
    )


@query
def load_stats(t):
    return catalogue.load_stats(derived.features(t), image_meta_dedup(t), derived.DIM)


@query
def incremental_todo(t):
    rows = t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("image_uuid"), "l_linenumber", "l_partkey", "l_suppkey"
    )
    done = t.orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").cast("string").alias("image_uuid"))
    return catalogue.incremental_todo(rows, done)


@query
def chunk_number(t):
    rows = t.orders.select(F.col("o_orderkey").cast("string").alias("image_uuid"))
    return positions.chunk_number(rows, "image_uuid", start=7)


@query
def run_stats(t):
    finished = t.orders.filter(F.col("o_orderstatus") == "F").count()
    return extraction.run_stats(derived.scored_lines(t), t.lineitem.count() + finished, elapsed=12.5)


@query
def failure_log(t):
    path = fresh_path(t.spark, "failures")
    lines = extraction.failure_lines(derived.scored_lines(t))
    return t.spark.read.text(path) if feature_sinks.write_failure_log(lines, path) else lines


@query
def scan_image_list(t):
    path = fresh_path(t.spark, "image-list")
    name = F.concat(F.lit('a "'), "p_name", F.lit('", '), "p_brand")
    rows = derived.part_urls(t, name.alias("name"))
    listed_rows = rows.select(
        F.col("p_partkey").cast("string").alias("image_uuid"), "image_url", F.col("name").alias("image_original_name")
    )
    listed_rows.write.option("header", "true").option("escape", '"').csv(path)
    return images.read_image_list(t.spark, path).select("image_uuid", "image_url", "image_original_name")


class _VectorCodes:
    """Codes of a row's vector by plain arithmetic; some ids fail."""

    def __call__(self, row: dict) -> tuple:
        if int(row["image_uuid"]) % 17 == 0:
            raise ValueError("cannot read " + row["image_uuid"])
        vector = np.asarray(row["embedding"], dtype=np.float32)
        order = np.lexsort((np.arange(len(vector)), -vector))[:5]
        bits = (vector >= vector[vector != 0].astype(np.float64).mean()).astype(np.uint8)
        text_form = "[" + ", ".join(str(i) for i in order) + "]"
        return text_form, np.packbits(bits).tobytes(), vector.astype(np.float16).tobytes()


def _scored_vectors(t: Tables, name: str) -> DataFrame:
    registry = extraction.ScorerRegistry()
    registry.register(name, _VectorCodes)
    rows = t.embeddings.select(F.col("vec_id").cast("string").alias("image_uuid"), "embedding")
    return extraction.batch_score(rows, registry.get(name))


@query
def batch_score(t):
    return _scored_vectors(t, "vectors").select(
        "image_uuid",
        "status",
        "channel_order",
        F.hex("signature").alias("signature"),
        F.length("embedding").alias("embedding_bytes"),
        "reason",
    )


@query
def register_scorer(t):
    return _scored_vectors(t, "other").groupBy("status").agg(F.count("*").alias("images"))


@query
def scan_features(t):
    path = fresh_path(t.spark, "features")
    feature_sinks.write_feature_files(extraction.feature_rows(_scored_vectors(t, "vectors")), path)
    return features.read_features(t.spark, path).select(
        "image_uuid",
        F.hex("signature").alias("signature"),
        codes.int_list_text(F.col("channel_order")).alias("channel_order"),
        F.round(vectors.norm(F.col("embedding")), 2).alias("norm"),
    )


@query
def max_file_index(t):
    path = fresh_path(t.spark, "features")
    feature_sinks.write_feature_files(extraction.feature_rows(_scored_vectors(t, "vectors")), path, start=3)
    return features.max_file_index(files.list_files(t.spark, path, recursive=True))


@query
def stream_incremental(t):
    base = fresh_path(t.spark, "stream")
    rows = derived.part_urls(t).select(
        F.col("p_partkey").cast("string").alias("image_uuid"), "image_url", F.lit("n").alias("image_original_name")
    )
    # A few batches whatever the size: files and files per batch grow with the cluster.
    tasks = t.spark.sparkContext.defaultParallelism
    rows.repartition(2 * tasks).write.option("header", "true").csv(f"{base}/lists")
    listed_images = extraction_stream.image_list_stream(t.spark, f"{base}/lists", files_per_batch=tasks)

    def scorer():
        def one(row):
            if int(row["image_uuid"]) % 17 == 0:
                raise ValueError("unreadable")
            return "[" + row["image_uuid"] + "]", b"", None

        return one

    extraction_stream.start_extraction(
        t.spark, listed_images, scorer, f"{base}/features", f"{base}/state"
    ).awaitTermination()
    done = features.read_features(t.spark, f"{base}/features").select("image_uuid", F.lit("ok").alias("state"))
    failed = extraction_stream.open_failures(t.spark, f"{base}/features")
    return done.unionByName(failed.select("image_uuid", F.lit("failed").alias("state")))


def _two_runs(t: Tables) -> FeatureStore:
    """Two scoring runs into one store, the second of which finds the keys of the first."""
    path = fresh_path(t.spark, "features")
    rows = t.embeddings.select(
        F.col("vec_id").cast("string").alias("image_uuid"),
        F.lit("u").alias("image_url"),
        F.lit("n").alias("image_original_name"),
        "embedding",
    )
    store = FeatureStore(t.spark, path)
    for wanted in (rows.filter(F.pmod(F.col("image_uuid").cast("bigint"), F.lit(3)) == 0), rows):
        todo = store.missing(wanted)
        store.commit(extraction.batch_score(todo, _VectorCodes), todo)
    return store


@query
def processed_keys(t):
    return features.processed_keys(t.spark, _two_runs(t).path)


@query
def run_history(t):
    """What the commits of a store say of themselves, counted by the jobs that made them."""
    return _two_runs(t).history().select("number", "success", "failed")


# Detections


@query
def class_name_fallback(t):
    return derived.detections(t).select("det_id", text.class_name(F.col("class_id"), "unknown").alias("class"))


@query
def confidence_filter(t):
    return detections.confident(derived.detections(t)).select("det_id", F.round("confidence", 6).alias("confidence"))


@query
def box_clip(t):
    corners = [F.col(c) for c in detections.CORNERS]
    clipped = boxes.clip_box(*corners, F.col("img_w"), F.col("img_h"))
    return derived.detections(t).select("det_id", *[c.alias(n) for c, n in zip(clipped, detections.CORNERS)])


@query
def detections_per_image(t):
    rows = detections.detections_per_image(derived.detected_images(t), derived.detections(t))
    points = F.array_join(F.col("coordinate").cast("array<string>"), ":").alias("coordinate")
    return rows.select("image_id", "det_id", "class", "confidence", points)


@query
def best_detection(t):
    best = detections.listed(detections.best_detection(derived.detections(t)))
    return best


@query
def crop_rectangle(t):
    return detections.crop_rectangle(derived.detected_images(t), derived.detections(t))


@query
def detection_class_counts(t):
    return detections.class_counts(derived.detections(t))


# Review


@query
def gt_query_list(t):
    return review.query_list(derived.queries(t), derived.stored_selections(t))


@query
def gt_status(t):
    return review.status(derived.queries(t), derived.stored_selections(t)).withColumn("percent", F.round("percent", 6))


@query
def selection_validate(t):
    return review.validate(derived.submissions(t), derived.candidates(t)).select(
        "submission_id", "query_id", listed("selected_image_ids").alias("selected"), "valid_ids", "accepted"
    )


def _upserted(t: Tables, candidates: DataFrame) -> DataFrame:
    return review.upsert(derived.stored_selections(t), review.validate(derived.submissions(t), candidates))


def _selections(t: Tables, candidates: DataFrame) -> DataFrame:
    """The selection snapshot that the review reads."""
    return stored(_upserted(t, candidates), "selections")


def _candidates(t: Tables) -> DataFrame:
    """The candidate table that the review reads."""
    return stored(derived.candidates(t), "candidates")


@query
def selection_upsert(t):
    return _upserted(t, derived.candidates(t)).select(
        "query_id",
        listed("selected_image_ids").alias("selected"),
        text.iso_text(F.col("completed_at")).alias("completed_at"),
    )


@query
def gt_query_detail(t):
    candidates = _candidates(t)
    return review.query_detail(derived.queries(t), candidates, _selections(t, candidates))


@query
def gt_export(t):
    candidates = _candidates(t)
    return review.export_rows(derived.queries(t), candidates, _selections(t, candidates))


@query
def query_navigation(t):
    return review.navigation(derived.queries(t))


@query
def gt_totals(t):
    return review.totals(derived.catalogue_items(t), derived.queries(t))


@query
def similarity_percent(t):
    return derived.candidates(t).select(
        "query_id", "image_uuid", text.similarity_percent(F.col("similarity")).alias("percent")
    )


@query
def stream_selection_upsert(t):
    base = fresh_path(t.spark, "intake")
    submissions, half = derived.submissions(t), F.pmod(F.xxhash64("submission_id"), F.lit(2))
    for arrival in (0, 1):
        submissions.filter(half == arrival).write.mode("append").parquet(f"{base}/submissions")
    # Two batches, however many files there are.
    files_of_batch = math.ceil(len(t.spark.read.parquet(f"{base}/submissions").inputFiles()) / 2)
    arriving = t.spark.readStream.schema(submissions.schema).option("maxFilesPerTrigger", files_of_batch).parquet(f"{base}/submissions")
    intake = selection_stream.start_intake(arriving, derived.candidates(t), f"{base}/accepted", f"{base}/state")
    intake.awaitTermination()
    current = selection_stream.current_selections(t.spark, f"{base}/accepted")
    return current.select(
        "query_id",
        listed("selected_image_ids").alias("selected"),
        text.iso_text(F.col("completed_at")).alias("completed_at"),
    )


# Documents


def _document_path(t: Tables) -> str:
    """The query document of the catalogue, written."""
    items = stored(derived.catalogue_items(t), "catalogue", ("category",))
    truth = ground_truth.build(items)
    document = document_sinks.queries_document(
        truth.queries,
        truth.candidates,
        items.groupBy("category").agg(F.count("*").alias("total_images")),
        CREATED_AT,
        t.folder,
        DIVERSITY_THRESHOLD,
        QUERIES_PER_CATEGORY,
        CANDIDATES_PER_QUERY,
    )
    path = fresh_path(t.spark, "queries-json")
    document_sinks.write_text(document, path)
    return path


@query
def queries_document(t):
    text_rows = document_sinks.read_text(t.spark, _document_path(t))
    doc = text_rows.select(F.from_json("value", schema.QUERY_DOCUMENT).alias("doc"))
    entry = doc.select("doc.metadata.total_images", F.explode("doc.categories").alias("category", "entry"))
    pairs = F.transform("entry.queries", lambda q: F.concat_ws("=", q["query_id"], q["image_uuid"]))
    return entry.select(
        F.col("total_images").alias("all_images"),
        "category",
        F.col("entry.total_images").alias("total_images"),
        listed(pairs).alias("queries"),
    )


@query
def flatten_queries(t):
    queries, candidates = documents.read_query_document(t.spark, _document_path(t))
    return queries.select("query_id", "category", F.col("image_uuid").alias("query_image_uuid")).join(
        candidates, "query_id"
    )


@query
def scan_selections(t):
    path = fresh_path(t.spark, "selections-json")
    rows = derived.stored_selections(t).withColumn("completed_at", text.iso_text(F.col("completed_at")))
    document_sinks.write_text(document_sinks.selection_document(rows), path)
    read = documents.read_selections(t.spark, path, lines=True)
    return read.select(
        "query_id",
        listed("selected_image_ids").alias("selected"),
        text.iso_text(F.col("completed_at")).alias("completed_at"),
    )


@query
def initial_selections(t):
    """A first selection document is written only where there is none."""
    path = fresh_path(t.spark, "selections-json")
    rows = derived.stored_selections(t).withColumn("completed_at", text.iso_text(F.col("completed_at")))
    for document in (rows.filter(F.col("query_id").startswith("bag_")), rows):
        document_sinks.write_text(document_sinks.selection_document(document), path, mode="ignore")
    read = documents.read_selections(t.spark, path, lines=True)
    return read.select("query_id", listed("selected_image_ids").alias("selected"))


@query
def test_query_document(t):
    """The ranked queries as the document that evaluation reads, flat again."""
    path = fresh_path(t.spark, "test-queries-json")
    ranked = ranking.rank_queries(derived.answer_lists(t), derived.queries(t))
    document_sinks.write_text(document_sinks.test_query_document(ranked), path)
    rows = documents.read_test_queries(t.spark, path)
    return rows.withColumn("ground_truth", listed("ground_truth"))


@query
def scan_reviewed(t):
    path = fresh_path(t.spark, "reviewed-json")
    columns = ["selected_image_ids", "completed_at", "total_results"]
    rows = derived.reviewed(t).withColumn("completed_at", F.lit("2026-04-19T19:59:48.307218700"))
    document_sinks.write_text(document_sinks.selection_document(rows, columns), path)
    read = documents.read_reviewed(t.spark, path, lines=True)
    return read.select(
        "query_id",
        listed("selected_image_ids").alias("selected"),
        "total_results",
        text.iso_text(F.col("completed_at")).alias("completed_at"),
    )


# Ranking and evaluation


@query
def category_from_query_id(t):
    return derived.answer_lists(t).select("query_id", text.category_from_query_id(F.col("query_id")).alias("category"))


@query
def rank_queries(t):
    known = derived.queries(t).join(
        t.orders.filter(F.col("o_orderstatus") != "P").select(derived.order_query_id("o_orderkey").alias("query_id")),
        "query_id",
        "left_semi",
    )
    return ranking.rank_queries(derived.answer_lists(t), known).withColumn("ground_truth", listed("ground_truth"))


@query
def rank_cutoff(t):
    return ranking.rank_cutoff(derived.answer_lists(t))


@query
def eval_per_query(t):
    return evaluation.per_query(*derived.retrieval(t))


@query
def eval_summary(t):
    evaluated = eval_per_query(t).withColumn("category", text.category_from_query_id(F.col("query_id")))
    return evaluation.summary(evaluated)


@query
def reviewed_precision(t):
    return evaluation.reviewed_precision(derived.reviewed(t))


@query
def compare_reviews(t):
    return evaluation.compare_reviews(*derived.run_pair(t))


# Extractors and requests


@query
def backbone_registry(t):
    return backbones.usage(derived.requests(t), derived.BACKBONES)


@query
def backbone_targets(t):
    targets = backbones.backbone_targets(derived.requests(t), derived.BACKBONES)
    return targets.withColumn("targets", listed("targets")).withColumn("unknown", listed("unknown"))


@query
def backbone_lookup(t):
    requested = derived.requests(t).select("request_id", F.explode("names").alias("name"))
    return backbones.lookup(requested, derived.BACKBONES)


@query
def compare_backbones(t):
    targets = backbones.backbone_targets(derived.requests(t), derived.BACKBONES)
    return backbones.compare_backbones(targets, derived.backbone_runs(t))


class _LowChannels:
    """Channels in ascending order of their values."""

    def __call__(self, row: dict) -> tuple:
        vector = np.asarray(row["embedding"], dtype=np.float32)
        order = np.lexsort((np.arange(len(vector)), vector))
        return "[" + ", ".join(str(i) for i in order) + "]", b"", None


class _HighChannels:
    """Channels in descending order of their values; some images fail."""

    def __call__(self, row: dict) -> tuple:
        if int(row["image_uuid"]) % 17 == 0:
            raise ValueError("cannot read " + row["image_uuid"])
        vector = np.asarray(row["embedding"], dtype=np.float32)
        order = np.lexsort((np.arange(len(vector)), -vector))
        return "[" + ", ".join(str(i) for i in order) + "]", b"", None


EXTRACTORS = [
    backbones.Backbone("vgg16", "VGG16", scorer=_HighChannels, channels=TOP_CHANNELS["vgg16"]),
    backbones.Backbone("efficientnet", "EfficientNet-B0", scorer=_LowChannels, channels=TOP_CHANNELS["efficientnet"]),
    backbones.Backbone("lite4", "EfficientNet-Lite4", loaded=False),
]


@query
def compare_extractors(t):
    """Requests run on their images by the extractors they name."""
    kind = F.pmod("vec_id", F.lit(4))
    asked = {1: ["vgg16"], 2: ["efficientnet", "resnet"], 3: ["lite4", "vgg16"]}
    names = F.lit(None).cast("array<string>")
    for at, wanted in asked.items():
        names = F.when(kind == at, F.array(*map(F.lit, wanted))).otherwise(names)
    images = t.embeddings.select(
        F.col("vec_id").alias("request_id"), F.col("vec_id").cast("string").alias("image_uuid"), "embedding"
    )
    targets = backbones.backbone_targets(t.embeddings.select(F.col("vec_id").alias("request_id"), names.alias("names")), EXTRACTORS)
    return backbones.compare_backbones(targets, backbones.run_targets(targets, images, EXTRACTORS)).drop("latency_ms")


@query
def latency_of_runs(t):
    """Latencies of real runs of the extractors; as times differ, how the figures lie to each other."""
    images = t.embeddings.select(
        F.col("vec_id").alias("request_id"), F.col("vec_id").cast("string").alias("image_uuid"), "embedding"
    )
    everyone = t.embeddings.select(F.col("vec_id").alias("request_id"), F.lit(None).cast("array<string>").alias("names"))
    targets = backbones.backbone_targets(everyone, EXTRACTORS)
    found = backbones.latency_by_backbone(backbones.run_targets(targets, images, EXTRACTORS))
    in_order = (F.col("min_ms") <= F.col("p50_ms")) & (F.col("p50_ms") <= F.col("p95_ms")) & (F.col("p95_ms") <= F.col("max_ms"))
    return found.select("name", "runs", (in_order & (F.col("min_ms") >= 0)).alias("in_order"))


@query
def latency_by_backbone(t):
    return backbones.latency_by_backbone(derived.backbone_runs(t))


# Training data


@query
def class_from_filename(t):
    return dataset.with_class(derived.labelme(t)).select("stem", "class_id")


@query
def labelme_to_yolo(t):
    rows = dataset.labelme_to_yolo(derived.labelme(t))
    return rows.select("stem", "class_id", "position", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "w", "h")])


@query
def safe_name(t):
    named = dataset.with_class(derived.labelme(t)).filter("class_id is not null")
    return named.select("stem", text.safe_name(text.class_name(F.col("class_id")), F.col("stem")).alias("safe_name"))


@query
def stratified_split(t):
    return dataset.stratified_split(derived.labelme(t))


@query
def label_image_match(t):
    return dataset.label_image_match(derived.labelme(t).select("stem"), derived.label_images(t))


def _manifest(t: Tables) -> DataFrame:
    return dataset.manifest(derived.labelme(t), derived.label_images(t))


@query
def dataset_manifest(t):
    path = fresh_path(t.spark, "manifest")
    dataset_sinks.write_manifest(_manifest(t), path)
    return t.spark.read.parquet(path).select(
        "stem", "class_id", F.col("split").cast("string").alias("split"), "safe_name", "ext", "ok"
    )


@query
def yolo_label_text(t):
    path = fresh_path(t.spark, "label-files")
    dataset_sinks.write_label_files(dataset.label_files(_manifest(t)), path)
    return t.spark.read.schema("safe_name string, label_text string, split string").parquet(path)


@query
def split_stats(t):
    return dataset.split_stats(derived.labelme(t), _manifest(t))


@query
def class_distribution(t):
    root = fresh_path(t.spark, "labels")
    lines = dataset.label_files(_manifest(t)).select("split", F.col("label_text").alias("value"))
    for split in ("train", "val"):
        lines.filter(F.col("split") == split).select("value").write.text(f"{root}/{split}")
    return dataset.class_distribution(labels.read_label_lines(t.spark, f"{root}/*"))


@query
def split_file_counts(t):
    root = fresh_path(t.spark, "dataset")
    for split, of_split in (("val", F.col("s_nationkey") < 5), ("train", F.col("s_nationkey") >= 5)):
        rows = t.supplier.filter(of_split)
        file_sinks.write_each(rows.select("s_name"), f"{root}/images/{split}")
        file_sinks.write_each(rows.filter(F.col("s_acctbal") > 0).select("s_name"), f"{root}/labels/{split}")
    return dataset.split_file_counts(labels.read_split_files(t.spark, root))


@query
def scan_image_files(t):
    path = fresh_path(t.spark, "files")
    file_sinks.write_each(t.supplier.select("s_name"), path)
    return images.read_image_files(t.spark, path).groupBy("ext").agg(F.count_distinct("stem").alias("files"))


@query
def scan_labelme(t):
    path = fresh_path(t.spark, "labelme")
    corners = F.array(F.array(F.lit(1.5), F.col("s_suppkey").cast("double")), F.array(F.lit(20.0), F.lit(30.0)))
    shape = F.struct(F.lit("rectangle").alias("shape_type"), corners.alias("points"))
    document = F.struct(
        F.lit(300).alias("imageWidth"), F.col("s_nationkey").alias("imageHeight"), F.array(shape).alias("shapes")
    )
    file_sinks.write_each(t.supplier.select(F.to_json(document).alias("value")), path)
    read = labels.read_labelme(t.spark, path)
    y1 = F.col("shapes")[0]["points"][0][1]
    return read.select(
        "imageWidth", "imageHeight", y1.alias("y1"), F.col("shapes")[0]["shape_type"].alias("shape_type")
    )
