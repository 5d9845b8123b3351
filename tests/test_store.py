"""The feature store that batch and stream share, its commits, ledger and compaction."""

import base64
import csv
import sys
import threading
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from kindred import schema
from kindred.operators import backbones
from kindred.operators.extraction import batch_score, counting, observed_stats, run_stats
from kindred.plans.extraction import extract
from kindred.sinks import selections as snapshots
from kindred.sinks import versions
from kindred.sinks.commits import CommitLog
from kindred.sinks.store import FeatureStore
from kindred.sources import features
from kindred.sources import images as image_lists
from kindred.sources.marks import Marks
from kindred.streaming import extraction as stream
from kindred.streaming.selections import current_selections, start_intake
from tests.conftest import plan_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

IMAGES = "image_uuid string, image_url string, image_original_name string"


def scorer():
    """One code for every image; uuids ending in 7 cannot be read."""

    def one(row):
        if row["image_uuid"].endswith("7"):
            raise ValueError("cannot open")
        return "[1, 2]", b"\x01", b"\x00\x3c" * 4

    return one


def reader_of_all():
    return lambda row: ("[1, 2]", b"\x01", b"\x00\x3c" * 4)


def images_of(spark, numbers):
    return spark.createDataFrame([(str(i), f"/upload/{i}.jpg", f"n{i}") for i in numbers], IMAGES)


def write_list(path, numbers):
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f)
        writer.writerow(["image_uuid", "image_url", "image_original_name"])
        writer.writerows([(str(i), f"/upload/{i}.jpg", f"n{i}") for i in numbers])


def keys(spark, path):
    return sorted(int(r["image_uuid"]) for r in features.processed_keys(spark, path).collect())


def streamed(spark, tmp_path, store, load=scorer, **options):
    rows = stream.image_list_stream(spark, f"{tmp_path}/lists", **options)
    stream.start_extraction(spark, rows, load, store, f"{tmp_path}/state").awaitTermination()


def test_batch_finds_what_the_stream_has_stored(spark, tmp_path):
    (tmp_path / "lists").mkdir()
    store, lists = f"{tmp_path}/features", f"{tmp_path}/lists/images_*.csv"
    write_list(tmp_path / "lists" / "images_1.csv", range(20))
    streamed(spark, tmp_path, store)
    # Streamed rows are chunks like any other.
    assert sorted(int(r["image_uuid"]) for r in features.read_features(spark, store).collect()) == [i for i in range(20) if i % 10 != 7]
    assert [r["image_uuid"] for r in stream.open_failures(spark, store).collect()] in (["7", "17"], ["17", "7"])
    done = extract(spark, lists, store, f"{tmp_path}/failed", scorer).first()
    assert (done["success"], done["failed"], done["skipped"]) == (0, 2, 18)
    # The batch reads the failed ones; the stream then has nothing to retry, and scores only new images.
    again = extract(spark, lists, store, f"{tmp_path}/failed", reader_of_all).first()
    assert (again["success"], again["failed"], again["skipped"]) == (2, 0, 18)
    assert stream.open_failures(spark, store).count() == 0
    write_list(tmp_path / "lists" / "images_2.csv", range(18, 25))
    streamed(spark, tmp_path, store)
    assert keys(spark, store) == list(range(25))
    assert features.read_features(spark, store).count() == 25
    assert features.existing_file_index(spark, store) == features.chunk_index(spark, store) == 3


def test_keys_never_read_a_code(spark, tmp_path):
    store = FeatureStore(spark, f"{tmp_path}/f")
    images = images_of(spark, range(30))
    store.commit(batch_score(images, scorer), images)
    for plan in (plan_of(store.keys()), plan_of(store.missing(images)), plan_of(features.processed_keys(spark, store.path))):
        assert "base64" not in plan and "csv" not in plan.lower()


def test_compacted_ledger_is_not_shuffled(spark, tmp_path):
    store = FeatureStore(spark, f"{tmp_path}/f")
    for part in (range(30), range(30, 40)):
        images = images_of(spark, part)
        store.commit(batch_score(images, scorer), images)
    store.compact()
    images = images_of(spark, range(50))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        todo = store.missing(images)
        assert sorted(int(r["image_uuid"]) for r in todo.collect()) == [7, 17, 27, 37, *range(40, 50)]
        plan = todo._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1  # of the images
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_twenty_batches_read_a_snapshot_and_what_is_newer(spark, tmp_path):
    store = FeatureStore(spark, f"{tmp_path}/f", compact_after=8)
    for i in range(20):
        images = images_of(spark, range(10 * i, 10 * i + 10))
        store.commit(batch_score(images, scorer), images, "run", i)
        store.commit(batch_score(images, scorer), images, "run", i)  # a repeated batch changes nothing
    state = store.log.state()
    assert (state.number, state.snapshot.number, len(state.later)) == (20, 16, 4)
    assert len(store.log.folders("keys", state)) == len(store.log.folders("failures", state)) == 5
    assert state.runs() == {"run": 19}
    assert keys(spark, store.path) == [i for i in range(200) if i % 10 != 7]
    assert store.open_failures().count() == 20
    assert features.read_features(spark, store.path).count() == 180


def test_unfinished_commits_are_not_seen(spark, tmp_path):
    store = FeatureStore(spark, f"{tmp_path}/f")
    images = images_of(spark, range(5))
    store.commit(batch_score(images, scorer), images)
    # Rows of a job that ended before its marker.
    rows = features.read_feature_files(spark, store.path)
    rows.withColumn("image_uuid", F.lit("x")).write.option("header", "true").csv(f"{store.path}/commit={'0' * 32}/feature_file=efficientNet_002")
    spark.createDataFrame([("x",)], "image_uuid string").write.parquet(store.log.folder("keys", "0" * 32))
    assert keys(spark, store.path) == list(range(5)) and features.read_features(spark, store.path).count() == 5


def test_a_second_writer_leaves_out_what_the_first_has_stored(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/f"
    first, second = FeatureStore(spark, path), FeatureStore(spark, path)
    mark = second.log.commit

    def late(number, name, **info):
        # The other writer commits just before this one's first marker.
        monkeypatch.setattr(second.log, "commit", mark)
        images = images_of(spark, range(0, 10))
        first.commit(batch_score(images, reader_of_all), images)
        return mark(number, name, **info)

    monkeypatch.setattr(second.log, "commit", late)
    images = images_of(spark, range(5, 15))
    second.commit(batch_score(images, reader_of_all), images)
    assert second.log.state().number == 2
    assert sorted(int(r["image_uuid"]) for r in features.read_features(spark, path).collect()) == list(range(15))
    assert keys(spark, path) == list(range(15)) and features.existing_file_index(spark, path) == 2


def test_chunks_from_before_the_store(spark, tmp_path):
    path = tmp_path / "f"
    path.mkdir()
    with open(path / "efficientNet_004.csv", "w", newline="") as f:
        writer = csv.writer(f)
        writer.writerow(schema.FEATURE_FILE.fieldNames())
        writer.writerow(("3", base64.b64encode(b"\x01").decode(), "[3, 1]", ""))
    store = FeatureStore(spark, str(path))
    assert keys(spark, str(path)) == [3]
    images = images_of(spark, range(5))
    assert store.missing(images).count() == 4
    todo = store.missing(images)
    store.commit(batch_score(todo, reader_of_all), todo)
    assert keys(spark, str(path)) == list(range(5)) and features.existing_file_index(spark, str(path)) == 5
    assert features.read_features(spark, str(path)).count() == 5


def test_one_writer_takes_a_name(spark, tmp_path):
    marks, won = Marks(spark, f"{tmp_path}/marks"), []
    threads = [threading.Thread(target=lambda i=i: won.append(i) if marks.create("1", str(i)) else None) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and marks.text("1") == str(won[0]) and marks.numbers() == [1]


def test_two_publishers_at_once_lose_no_selection(spark, tmp_path):
    path, shape = f"{tmp_path}/selections", "query_id string, selected_image_ids array<string>, completed_at string"

    def rows(n):
        listed = [(f"q{n}_{i}", ["a"], "2026-01-01T00:00:00") for i in range(3)]
        return spark.createDataFrame(listed, shape).withColumn("completed_at", F.col("completed_at").cast("timestamp_ntz"))

    threads = [threading.Thread(target=snapshots.upsert_published, args=(rows(n), path)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert versions.number(spark, path) == 4
    assert snapshots.published_selections(spark, path).count() == 12


def test_documents_of_two_writers_both_get_a_number(spark, tmp_path):
    path, seen = f"{tmp_path}/doc", []

    def write(folder):
        if not seen:
            seen.append(versions.publish(spark, path, lambda f: spark.createDataFrame([("b",)], "value string").write.text(f)))
        spark.createDataFrame([("a",)], "value string").write.text(folder)

    assert versions.publish(spark, path, write) == 2 and seen == [1]
    assert spark.read.text(versions.current(spark, path)).first()["value"] == "a"


def test_intake_reads_a_snapshot_and_newer_batches(spark, tmp_path):
    shape = "submission_id string, query_id string, selected_image_ids array<string>, completed_at timestamp_ntz"
    candidates = spark.createDataFrame([(f"q{i}", "a") for i in range(3)], "query_id string, image_uuid string")
    for i in range(12):
        rows = spark.createDataFrame([(str(i), f"q{i % 3}", ["a"], None)], shape)
        day = F.expr(f"timestamp_ntz'2026-01-01' + interval {i} days")
        rows.withColumn("completed_at", day).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    arriving = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    start_intake(arriving, candidates, f"{tmp_path}/out", f"{tmp_path}/state", compact_after=5).awaitTermination()
    log = CommitLog(spark, f"{tmp_path}/out")
    state = log.state()
    assert state.number == 12 and len(log.folders("accepted", state)) == 1 + len(state.later) <= 5
    got = current_selections(spark, f"{tmp_path}/out").collect()
    assert sorted(r["completed_at"].day for r in got) == [10, 11, 12]


@pytest.mark.parametrize("rows, chunks", [(0, 0), (1, 1), (500, 1), (1203, 3)])
def test_chunk_sizes_of_a_commit(spark, tmp_path, rows, chunks):
    store = FeatureStore(spark, f"{tmp_path}/f")
    images = images_of(spark, [10 * i for i in range(rows)]) if rows else images_of(spark, [1]).limit(0)
    store.commit(batch_score(images, scorer, 3), images)
    assert features.existing_file_index(spark, store.path) == chunks
    if rows:
        read = features.read_feature_files(spark, store.path)
        named = F.regexp_extract(F.col("_metadata.file_path"), "feature_file=([^/]+)", 1)
        sizes = sorted(r["count"] for r in features._chunk_reader(spark).csv(store.path).groupBy(named.alias("f")).count().collect())
        assert sizes == sorted([500] * (rows // 500) + [rows % 500] * (rows % 500 > 0)) and read.count() == rows


def test_numbers_of_a_run_are_counted_as_it_runs(spark, tmp_path):
    write_list(tmp_path / "images_1.csv", range(40))
    store = f"{tmp_path}/features"
    first = extract(spark, f"{tmp_path}/images_*.csv", store, f"{tmp_path}/failed", scorer, commits=3).first()
    assert (first["success"], first["failed"], first["skipped"]) == (36, 4, 0)
    history = FeatureStore(spark, store).history().collect()
    assert [r["number"] for r in history] == [1, 2, 3] and sum(r["success"] for r in history) == 36
    assert all(r["seconds"] > 0 and r["per_second"] >= 0 for r in history)
    write_list(tmp_path / "images_2.csv", range(38, 43))
    second = extract(spark, f"{tmp_path}/images_*.csv", store, f"{tmp_path}/failed", scorer).first()
    assert (second["success"], second["failed"], second["skipped"]) == (3, 4, 38)
    scored = batch_score(images_of(spark, range(40)), scorer)
    seen, observation = counting(scored)
    seen.write.format("noop").mode("overwrite").save()
    counted = run_stats(scored, 50, 2.0).first()
    assert tuple(observed_stats(spark, **observation.get, total_images=50, elapsed=2.0).first()) == tuple(counted)


def test_a_stream_can_be_followed(spark, tmp_path):
    (tmp_path / "lists").mkdir()
    for i in range(3):
        write_list(tmp_path / "lists" / f"images_{i}.csv", range(10 * i, 10 * i + 10))
    progress = stream.Progress()
    spark.streams.addListener(progress)
    try:
        streamed(spark, tmp_path, f"{tmp_path}/f", files_per_batch=1)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        for _ in range(50):
            if len(progress.batches) >= 3:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    assert [(batch, images) for _, batch, images in progress.batches if images] == [(0, 10), (1, 10), (2, 10)]
    done = {r["batch"]: (r["run"], r["success"]) for r in FeatureStore(spark, f"{tmp_path}/f").history().collect()}
    assert done == {batch: (progress.batches[0][0], 9) for batch in range(3)}


def test_latency_quantiles_of_real_runs(spark):
    def slow():
        def one(row):
            time.sleep(0.02 if int(row["image_uuid"]) % 10 else 0.2)
            return "[1]", b"", None

        return one

    known = [backbones.Backbone("slow", "Slow", scorer=slow)]
    images = images_of(spark, range(20)).withColumn("request_id", F.col("image_uuid"))
    targets = images.select("request_id", F.array(F.lit("slow")).alias("targets"))
    found = backbones.latency_by_backbone(backbones.run_targets(targets, images, known)).first()
    assert found["runs"] == 20 and 20 <= found["min_ms"] <= found["p50_ms"] < 150
    assert 200 <= found["p95_ms"] <= found["max_ms"]


def test_lists_are_split_where_no_quote_spans_lines(spark, tmp_path):
    write_list(tmp_path / "plain.csv", range(5))
    (tmp_path / "broken.csv").write_text('image_uuid,image_url,image_original_name\n1,u,"a\nb"\n')
    assert not image_lists.has_quoted_breaks(spark, f"{tmp_path}/plain.csv")
    assert image_lists.has_quoted_breaks(spark, f"{tmp_path}/broken.csv")
    assert "multiLine" not in plan_of(image_lists.read_image_list(spark, f"{tmp_path}/plain.csv"))
    assert image_lists.read_image_list(spark, f"{tmp_path}/broken.csv").first()["image_original_name"] == "a\nb"
    assert image_lists.read_image_list(spark, f"{tmp_path}/*.csv").count() == 6
