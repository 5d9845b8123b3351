import base64
import csv
import json
import sys

import numpy as np
import pytest
from kindred.sinks.documents import read_text
from pyspark import cloudpickle
from pyspark.sql import functions as F

from kindred.functions import vectors
from kindred.operators import catalogue
from kindred.operators.extraction import ScorerRegistry, batch_score, failure_lines, run_stats
from kindred.plans.extraction import extract
from kindred.plans.ground_truth import build_from_files
from kindred.sinks.features import save_bucketed, write_failure_log, write_feature_files
from kindred.sources import documents, features, files, images
from kindred.streaming import extraction as stream

# The scorer of this module runs in tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIM = 16
KOREAN = ["가방", "신발", "의류"]


def vector_of(uuid):
    return np.random.default_rng(int(uuid)).normal(size=DIM).astype(np.float32)


def scorer():
    """Codes by arithmetic on the uuid; uuids ending in 7 cannot be read."""

    def one(row):
        if row["image_uuid"].endswith("7"):
            raise ValueError("cannot open")
        v = np.random.default_rng(int(row["image_uuid"])).normal(size=16).astype(np.float32)
        order = json.dumps(np.argsort(-v)[:5].tolist())
        return order, np.packbits(v >= v[v != 0].mean()).tobytes(), v.astype(np.float16).tobytes()

    return one


def write_list(path, rows, header=("image_uuid", "image_url", "image_original_name")):
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f)
        writer.writerow(header)
        writer.writerows([r[: len(header)] for r in rows])


def test_image_lists(spark, tmp_path):
    write_list(
        tmp_path / "images_1.csv",
        [("0001", "/upload/가방/a.jpg", 'one, "two"\nthree'), ("0002", "/upload/bag/b.jpg", "")],
    )
    write_list(
        tmp_path / "images_2.csv", [("0001", "/upload/신발/c.jpg"), ("0003", "d.jpg")], ("image_uuid", "image_url")
    )
    pattern = f"{tmp_path}/images_*.csv"
    got = {(r["image_uuid"], r["image_original_name"]) for r in images.read_image_list(spark, pattern).collect()}
    assert got == {("0001", 'one, "two"\nthree'), ("0002", ""), ("0001", "0001"), ("0003", "0003")}
    meta = {r["image_uuid"]: (r["image_url"], r["category"]) for r in images.read_image_meta(spark, pattern).collect()}
    assert meta == {
        "0001": ("/upload/shoes/c.jpg", "shoes"),  # the later file wins
        "0002": ("/upload/bag/b.jpg", None),
        "0003": ("d.jpg", None),
    }
    with pytest.raises(FileNotFoundError):
        images.read_image_meta(spark, f"{tmp_path}/none_*.csv")


def test_last_row_of_a_file_wins(spark, tmp_path):
    write_list(tmp_path / "images_1.csv", [("1", f"/upload/가방/{i}.jpg", "n") for i in range(50)])
    assert images.read_image_meta(spark, f"{tmp_path}/images_1.csv").first()["image_url"] == "/upload/bag/49.jpg"


def test_file_index(spark, tmp_path):
    assert features.existing_file_index(spark, f"{tmp_path}/none") == 0
    for name in ("efficientNet_002.csv", "efficientNet_011.csv", "efficientNet_x.csv", "other.csv"):
        (tmp_path / name).write_text("image_uuid\n")
    assert features.existing_file_index(spark, str(tmp_path)) == 11
    bad = spark.createDataFrame([("/a/other.csv",)], "path string")
    assert features.max_file_index(bad).first()["file_index"] == 0


def test_features_of_plain_files(spark, tmp_path):
    v = vector_of("5")
    row = (
        "5", base64.b64encode(b"\x80\x01").decode(), "[3, 1]", base64.b64encode(v.astype(np.float16).tobytes()).decode()
    )
    with open(tmp_path / "efficientNet_001.csv", "w", newline="") as f:
        writer = csv.writer(f)
        writer.writerow(["image_uuid", "img_feature_value_base64", "img_feature_order", "img_embedding_base64"])
        writer.writerows([row, ("6", row[1], row[2], "")])
    got = {r["image_uuid"]: r for r in features.read_features(spark, str(tmp_path)).collect()}
    assert bytes(got["5"]["signature"]) == b"\x80\x01" and got["5"]["channel_order"] == [3, 1]
    assert got["5"]["embedding"] == v.astype(np.float16).astype(np.float32).tolist()
    assert got["6"]["embedding"] is None
    kept = catalogue.dim_filter(features.read_features(spark, str(tmp_path)), DIM)
    assert [r["image_uuid"] for r in kept.collect()] == ["5"]


def test_batch_score_keeps_failures_in_their_rows(spark):
    rows = spark.createDataFrame([("1", "n1"), ("7", "n7")], "image_uuid string, image_original_name string")
    scored = batch_score(rows, scorer, partitions=2)
    got = {r["image_uuid"]: r for r in scored.collect()}
    assert got["1"]["status"] == "ok" and got["1"]["latency_ms"] >= 0
    assert (got["7"]["status"], got["7"]["reason"], got["7"]["signature"]) == ("failed", "cannot open", None)
    assert [r["value"] for r in failure_lines(scored).collect()] == ["n7 - cannot open"]
    assert tuple(run_stats(scored, 5, 2.0).first()) == (1, 1, 3, 0.5)


def test_scorer_registry():
    registry = ScorerRegistry()
    registry.register("arithmetic", scorer)
    assert registry.get("arithmetic") is scorer and registry.names() == ["arithmetic"]
    with pytest.raises(ValueError):
        registry.register("arithmetic", scorer)
    with pytest.raises(KeyError):
        registry.get("other")


def test_no_failures_no_log(spark, tmp_path):
    assert not write_failure_log(spark.createDataFrame([], "value string"), f"{tmp_path}/log")
    assert not files.exists(spark, f"{tmp_path}/log")


def test_extraction_to_ground_truth(spark, tmp_path):
    lists, out, log = f"{tmp_path}/images_*.csv", f"{tmp_path}/features", f"{tmp_path}/failed"
    rows = [(str(i), f"/upload/{KOREAN[i % 3]}/{i}.jpg", f"n{i}") for i in range(60)]
    write_list(tmp_path / "images_1.csv", rows[:40])
    first = extract(spark, lists, out, log, scorer).first()
    assert (first["success"], first["failed"], first["skipped"]) == (36, 4, 0)
    assert features.existing_file_index(spark, out) == 1

    write_list(tmp_path / "images_2.csv", rows[40:])
    second = extract(spark, lists, out, log, scorer, partitions=3).first()
    # Failures are tried again, successes are not.
    assert (second["success"], second["failed"], second["skipped"]) == (18, 6, 36)
    assert features.existing_file_index(spark, out) == 2
    stored = features.read_features(spark, out)
    assert stored.count() == 54 == features.processed_keys(spark, out).count()

    truth = build_from_files(spark, lists, out, f"{tmp_path}/gt", "now", 4, 5, dim=DIM)
    queries, candidates = documents.read_query_document(spark, f"{tmp_path}/gt/queries.json")
    assert queries.count() == 12 and candidates.count() == 60
    key = ["query_id", "rank", "image_uuid", "image_url", "similarity"]
    assert {tuple(r) for r in candidates.select(key).collect()} == {tuple(r) for r in truth.candidates.select(key).collect()}
    units = {}
    for uuid, url, _ in rows:
        v = vector_of(uuid).astype(np.float16).astype(np.float64)
        units[uuid] = v / np.linalg.norm(v)
    for q in queries.collect():
        group = [u for u, url, _ in rows if url.split("/")[2] == rows[int(q["image_uuid"])][1].split("/")[2]]
        group = [u for u in group if not u.endswith("7") and u != q["image_uuid"]]
        best = sorted(group, key=lambda u: (-round(float(units[u] @ units[q["image_uuid"]]), 10), u))[:5]
        got = candidates.filter(F.col("query_id") == q["query_id"]).orderBy("rank").collect()
        assert [r["image_uuid"] for r in got] == best
    document = json.loads(read_text(spark, f"{tmp_path}/gt/queries.json").first()["value"])
    assert document["metadata"]["total_images"] == 54 and list(document["categories"]) == ["bag", "shoes", "clothes"]
    assert documents.read_selections(spark, f"{tmp_path}/gt/selections.json", lines=True).count() == 0


def test_load_stats_count_what_is_skipped(spark):
    feats = spark.createDataFrame(
        [("1", [1.0, 2.0]), ("2", [1.0]), ("3", None), ("4", [1.0, 2.0]), ("5", [1.0, 2.0])], "image_uuid string, embedding array<float>"
    )
    meta = spark.createDataFrame(
        [("1", "u", "bag"), ("2", "u", "bag"), ("3", "u", "bag"), ("4", "u", None)], "image_uuid string, image_url string, category string"
    )
    got = {r["category"]: (r["rows"], r["skipped"]) for r in catalogue.load_stats(feats, meta, 2).collect()}
    assert got == {"bag": (1, 0), None: (0, 4)}
    assert [r["image_uuid"] for r in catalogue.features_join_meta(feats, meta, 2).collect()] == ["1"]


def test_stream_retries_failures(spark, tmp_path):
    lists = tmp_path / "lists"
    lists.mkdir()
    broken = tmp_path / "broken"
    broken.write_text("")
    flag = str(broken)

    def flaky():
        import os

        def one(row):
            if row["image_uuid"] == "7" and os.path.exists(flag):
                raise ValueError("not yet")
            return "[1]", b"\x01", None

        return one

    def run(state="c"):
        stream.start_extraction(
            spark, stream.image_list_stream(spark, str(lists)), flaky, f"{tmp_path}/f", f"{tmp_path}/{state}"
        ).awaitTermination()
        return sorted(r["image_uuid"] for r in features.read_features(spark, f"{tmp_path}/f").collect())

    write_list(lists / "images_1.csv", [(str(i), "u", "n") for i in range(5, 9)])
    assert run() == ["5", "6", "8"]
    failed = stream.open_failures(spark, f"{tmp_path}/f")
    assert [r["image_uuid"] for r in failed.collect()] == ["7"]
    broken.rename(tmp_path / "repaired")
    write_list(lists / "images_2.csv", [("8", "u", "n"), ("9", "u", "n")])
    assert run() == ["5", "6", "7", "8", "9"]
    assert stream.open_failures(spark, f"{tmp_path}/f").count() == 0
    # A stream without the old checkpoint sees all files again, but scores nothing twice and overwrites nothing.
    write_list(lists / "images_3.csv", [("10", "u", "n")])
    assert run("new") == ["10", "5", "6", "7", "8", "9"]


def test_bucketed_tables_join_without_shuffle(spark):
    feats = spark.range(100).select(
        F.col("id").cast("string").alias("image_uuid"), F.array(F.lit(1.0)).cast("array<float>").alias("embedding")
    )
    meta = spark.range(100).select(
        F.col("id").cast("string").alias("image_uuid"), F.lit("u").alias("image_url"), F.lit("bag").alias("category")
    )
    save_bucketed(feats, "bucketed_features", "image_uuid", 4)
    save_bucketed(meta, "bucketed_meta", "image_uuid", 4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = catalogue.features_join_meta(spark.table("bucketed_features"), spark.table("bucketed_meta"), 1)
        assert joined.count() == 100
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_chunks_hold_500_rows(spark, tmp_path):
    rows = spark.range(1203).select(
        F.format_string("%05d", "id").alias("image_uuid"), F.lit("a").alias("img_feature_value_base64"),
        F.lit("[1, 2]").alias("img_feature_order"), F.lit("b").alias("img_embedding_base64"),
    )
    write_feature_files(rows, str(tmp_path / "f"), start=4)
    read = features.read_feature_files(spark, str(tmp_path / "f"))
    sizes = read.groupBy(F.regexp_extract(F.col("_metadata.file_path"), "feature_file=([^/]+)", 1).alias("f")).count()
    assert {r["f"]: r["count"] for r in sizes.collect()} == {"efficientNet_005": 500, "efficientNet_006": 500, "efficientNet_007": 203}


def test_signature_words_match_the_vector(spark):
    v = vector_of("3")
    df = spark.createDataFrame([(v.tolist(),)], "v array<float>")
    bits = vectors.binarize(F.col("v"))
    row = df.select(vectors.bit_words(bits).alias("a"), vectors.words_of_signature(vectors.pack_bits(bits)).alias("b")).first()
    assert row["a"] == row["b"]


def test_streamed_lists_follow_the_rules_of_the_batch_reader(spark, tmp_path):
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists" / "images_1.csv").write_text("image_uuid,image_url\nu1,/a\n")
    rows = stream.image_list_stream(spark, f"{tmp_path}/lists")
    rows.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(
        f"{tmp_path}/out"
    ).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("u1", "/a", "u1")]
