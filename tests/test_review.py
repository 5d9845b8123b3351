import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from kindred.operators import ranking, review
from kindred.sinks import documents as sinks
from kindred.sinks import selections as snapshots
from kindred.sources import documents

NOON = dt.datetime(2026, 1, 1, 12)
QUERIES = [
    ("bag_00", "bag", "i0", "/u/i0"),
    ("bag_01", "bag", "i1", "/u/i1"),
    ("food_00", "food", "i2", "/u/i2"),
]


def tables(spark):
    queries = spark.createDataFrame(QUERIES, "query_id string, category string, image_uuid string, image_url string")
    rows = [("bag_00", r, f"c{r}", f"/u/c{r}", 1 - r / 100) for r in range(1, 22)] + [("food_00", 1, "c1", "/u/c1", 0.5)]
    candidates = spark.createDataFrame(
        rows, "query_id string, rank int, image_uuid string, image_url string, similarity double"
    )
    selections = spark.createDataFrame(
        [("bag_00", ["c3", "c1", "gone"], NOON)],
        "query_id string, selected_image_ids array<string>, completed_at timestamp_ntz",
    )
    return queries, candidates, selections


SUBMISSION = "submission_id string, query_id string, selected_image_ids array<string>, completed_at timestamp_ntz"


def test_validation(spark):
    _, candidates, _ = tables(spark)
    lists = {
        "repeats": ["c2", "c1", "c2", "x", "c1"],
        "foreign": ["x", "y"],
        "nothing": [],
        "twenty": [f"c{i}" for i in range(20, 0, -1)],
        "many": [f"c{i}" for i in range(1, 22)],
    }
    rows = [(name, "bag_00", ids, NOON) for name, ids in lists.items()] + [("other", "food_00", ["c2"], NOON)]
    got = {r["submission_id"]: r for r in review.validate(spark.createDataFrame(rows, SUBMISSION), candidates).collect()}
    assert got["repeats"]["selected_image_ids"] == ["c2", "c1"]
    assert got["twenty"]["selected_image_ids"] == lists["twenty"]
    assert {name: r["valid_ids"] for name, r in got.items()} == {
        "repeats": 2, "foreign": 0, "nothing": 0, "twenty": 20, "many": 21, "other": 0
    }
    assert {name for name, r in got.items() if r["accepted"]} == {"repeats", "twenty"}


def test_upsert_keeps_the_latest(spark):
    _, candidates, selections = tables(spark)
    later, earlier = NOON + dt.timedelta(hours=1), NOON - dt.timedelta(hours=1)
    rows = [
        ("a", "bag_00", ["c5"], later),
        ("b", "bag_00", ["c6"], earlier),
        ("c", "bag_00", ["no"], later + dt.timedelta(hours=1)),
        ("d", "food_00", ["c1"], earlier),
    ]
    validated = review.validate(spark.createDataFrame(rows, SUBMISSION), candidates)
    got = {r["query_id"]: r["selected_image_ids"] for r in review.upsert(selections, validated).collect()}
    assert got == {"bag_00": ["c5"], "food_00": ["c1"]}


def test_snapshots(spark, tmp_path):
    path = f"{tmp_path}/selections"
    _, candidates, selections = tables(spark)
    assert snapshots.published_selections(spark, path).count() == 0
    assert snapshots.publish_selections(selections, path) == 1
    rows = [("d", "food_00", ["c1"], NOON)]
    validated = review.validate(spark.createDataFrame(rows, SUBMISSION), candidates)
    assert snapshots.publish_selections(review.upsert(snapshots.published_selections(spark, path), validated), path) == 2
    assert {r["query_id"] for r in snapshots.published_selections(spark, path).collect()} == {"bag_00", "food_00"}


def test_half_written_versions_are_not_seen(spark, tmp_path):
    path = f"{tmp_path}/selections"
    _, _, selections = tables(spark)
    snapshots.publish_selections(selections, path)
    # Some files of a second version, whose job has not ended.
    selections.limit(1).write.parquet(f"{path}/versions/2-{'0' * 32}")
    assert snapshots.published_selections(spark, path).count() == selections.count()
    assert snapshots.publish_selections(selections.limit(1), path) == 2
    assert snapshots.published_selections(spark, path).count() == 1


def test_a_failed_write_keeps_the_old_document(spark, tmp_path):
    path = f"{tmp_path}/queries.json"
    sinks.write_text(spark.createDataFrame([("old",)], "value string"), path)
    failing = spark.range(3).select(F.raise_error(F.lit("no")).cast("string").alias("value"))
    with pytest.raises(Exception, match="no"):
        sinks.write_text(failing, path)
    assert [r["value"] for r in sinks.read_text(spark, path).collect()] == ["old"]


def test_status_and_list(spark):
    queries, _, selections = tables(spark)
    got = {r["category"]: tuple(r)[1:] for r in review.status(queries, selections).collect()}
    assert got["bag"] == (2, 1, 50.0, "pending")
    assert got["food"] == (1, 0, 0.0, "pending")
    assert got["overall"][:2] == (3, 1)
    assert {r["query_id"] for r in review.query_list(queries, selections).collect() if r["completed"]} == {"bag_00"}


def test_detail(spark):
    queries, candidates, selections = tables(spark)
    got = review.query_detail(queries, candidates, selections, "bag_00").orderBy("rank").collect()
    assert len(got) == 21
    assert [r["image_uuid"] for r in got if r["selected"]] == ["c1", "c3"]
    alone = review.query_detail(queries, candidates, selections, "bag_01").collect()
    assert len(alone) == 1 and alone[0]["image_uuid"] is None and alone[0]["selected"] is None
    assert review.query_detail(queries, candidates, selections, "food_00").first()["selected"] is None
    assert review.query_detail(queries, candidates, selections, "nope").count() == 0


def test_export(spark, tmp_path):
    queries, candidates, selections = tables(spark)
    rows = review.export_rows(queries, candidates, selections)
    sinks.write_text(sinks.export_lines(rows), f"{tmp_path}/export")
    lines = [json.loads(r["value"]) for r in sinks.read_text(spark, f"{tmp_path}/export").collect()]
    assert lines == [
        {
            "query_id": "bag_00",
            "category": "bag",
            "query_image_uuid": "i0",
            "query_image_url": "/u/i0",
            # Candidate order, not the order of the selection.
            "relevant_images": [
                {"image_uuid": "c1", "image_url": "/u/c1", "similarity": 0.99},
                {"image_uuid": "c3", "image_url": "/u/c3", "similarity": 0.97},
            ],
        }
    ]
    meta = json.loads(sinks.export_metadata(rows, "now").first()["value"])
    assert meta == {"created_at": "now", "total_queries": 1, "selections_per_query": 10}


def test_export_keeps_an_answered_query_without_match(spark):
    queries, candidates, _ = tables(spark)
    answered = spark.createDataFrame(
        [("bag_01", ["zz"], NOON)], "query_id string, selected_image_ids array<string>, completed_at timestamp_ntz"
    )
    rows = review.export_rows(queries, candidates, answered)
    assert json.loads(sinks.export_lines(rows).first()["value"])["relevant_images"] == []


def test_navigation(spark):
    queries, _, _ = tables(spark)
    got = {r["query_id"]: (r["previous_query_id"], r["next_query_id"]) for r in review.navigation(queries).collect()}
    assert got == {"bag_00": (None, "bag_01"), "bag_01": ("bag_00", "food_00"), "food_00": ("bag_01", None)}


def test_totals(spark):
    queries, candidates, _ = tables(spark)
    assert tuple(review.totals(candidates, queries).first()) == (22, 2, 3)


def test_ranking(spark, tmp_path):
    queries, _, _ = tables(spark)
    rows = [(f"bag_{i:02d}", ["a"] * n, None) for i, n in enumerate([2, 5, 5, 1])] + [
        ("food_00", [], None),
        ("cap_00", ["a"] * 9, None),
    ]
    selections = spark.createDataFrame(
        rows, "query_id string, selected_image_ids array<string>, completed_at timestamp_ntz"
    )
    ranked = ranking.rank_queries(selections, queries, top_n=3)
    got = [tuple(r) for r in ranked.orderBy("category", "rank").select("query_id", "rank", "image_uuid", "ground_truth_count").collect()]
    assert got == [("bag_01", 1, "i1", 5), ("bag_02", 2, "", 5), ("bag_00", 3, "i0", 2), ("food_00", 1, "i2", 0)]
    cutoffs = {r["category"]: (r["queries"], r["cutoff"]) for r in ranking.rank_cutoff(selections, 3).collect()}
    assert cutoffs == {"bag": (4, 2), "food": (1, None)}
    document = json.loads(sinks.test_query_document(ranked).first()["value"])
    assert list(document) == ["bag", "sunglass", "food", "shoes", "clothes"]
    assert [q["query_id"] for q in document["bag"]] == ["bag_01", "bag_02", "bag_00"]
    assert document["shoes"] == []


def test_selection_documents(spark, tmp_path):
    path = f"{tmp_path}/selections.json"
    assert documents.read_selections(spark, path).count() == 0
    with open(path, "w") as f:
        json.dump(
            {"bag_00": {"selected_image_ids": ["a"], "completed_at": "2026-04-19T20:06:49.762320"},
             "bag_01": {"selected_image_ids": [], "completed_at": "2026-04-19T19:59:48.307218700"}}, f, indent=2,
        )
    got = {r["query_id"]: r for r in documents.read_selections(spark, path).collect()}
    assert got["bag_00"]["selected_image_ids"] == ["a"]
    assert got["bag_01"]["completed_at"] == dt.datetime(2026, 4, 19, 19, 59, 48, 307218)


def test_reviewed_and_evaluation_documents(spark, tmp_path):
    with open(f"{tmp_path}/reviewed.json", "w") as f:
        json.dump(
            {"bag_00": {"completed_at": "2026-04-19T20:06:49", "selected_image_ids": [], "total_results": 9}},
            f,
            indent=2,
        )
    assert documents.read_reviewed(spark, f"{tmp_path}/reviewed.json").first()["total_results"] == 9
    row = {"query_id": "bag_00", "hit": 7, "retrieved": 10, "relevant": 20, "precision": 0.7, "recall": 0.35}
    with open(f"{tmp_path}/eval.json", "w") as f:
        json.dump(
            {"details": {"bag": [row]}, "summary": {"bag": {"query_count": 1, "avg_precision": 0.7, "avg_recall": 0.35}}},
            f,
            indent=2,
        )
    details, summary = documents.read_evaluation(spark, f"{tmp_path}/eval.json")
    assert details.first().asDict() == {"category": "bag", **row}
    assert tuple(summary.first()) == ("bag", 1, 0.7, 0.35)


def test_missing_query_document(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        documents.read_query_document(spark, f"{tmp_path}/none.json")


def test_initial_selections_are_not_overwritten(spark, tmp_path):
    kept = spark.createDataFrame([("x",)], "value string")
    sinks.write_text(kept, f"{tmp_path}/s", mode="ignore")
    sinks.write_text(spark.createDataFrame([("y",)], "value string"), f"{tmp_path}/s", mode="ignore")
    assert [r["value"] for r in sinks.read_text(spark, f"{tmp_path}/s").collect()] == ["x"]


def test_every_category_is_ordered(spark):
    queries, _, _ = tables(spark)
    more = queries.unionByName(
        queries.filter("category = 'food'").withColumn("category", F.lit("clothes")).withColumn(
            "query_id", F.lit("clothes_00")
        ),
    )
    got = [r["query_id"] for r in review.navigation(more).orderBy("place").collect()]
    assert got == ["bag_00", "bag_01", "food_00", "clothes_00"]


def _odd_submissions(spark):
    """Repeated and empty lists, null ids, submissions without a query or an id, and a submission in two parts."""
    rows = [(f"s{i}", "bag_00", [f"c{i % 25}", "x", f"c{i % 7}", None], NOON) for i in range(30)] + [
        ("none", None, ["c1"], NOON), (None, "bag_00", ["c1", "c2"], NOON), ("null", "bag_00", None, NOON),
        ("twice", "food_00", ["c1"], NOON), ("twice", "food_00", ["x", "c1"], NOON), ("bag_00", None, ["c1"], None),
    ]
    return spark.createDataFrame(rows, SUBMISSION)


@pytest.mark.parametrize("hot_rows", [1, 5, 10**6])
def test_validation_of_hot_queries(spark, hot_rows):
    _, candidates, _ = tables(spark)
    candidates = candidates.unionByName(candidates.withColumn("query_id", F.lit(None).cast("string"))).unionByName(candidates)
    got = {r["submission_id"]: r for r in review.validate(_odd_submissions(spark), candidates, hot_rows).collect()}
    assert len(got) == 30 + 5
    for i in range(30):
        wanted = list(dict.fromkeys(c for c in (i % 25, i % 7) if 1 <= c <= 21))
        assert got[f"s{i}"]["selected_image_ids"] == [f"c{c}" for c in wanted]
    assert got["none"]["valid_ids"] == got["null"]["valid_ids"] == got["bag_00"]["valid_ids"] == 0
    assert got[None]["selected_image_ids"] == ["c1", "c2"]
    assert got["twice"]["valid_ids"] == 2


def test_submissions_move_once(spark):
    _, candidates, _ = tables(spark)
    validated = review.validate(_odd_submissions(spark), candidates)
    plan = review.latest(validated.filter("accepted"), "completed_at", "submission_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_candidates_of_an_export_move_once(spark):
    queries, candidates, selections = tables(spark)
    plan = review.export_rows(queries, candidates, selections.unionByName(selections)).hint("shuffle_merge")
    plan = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and plan.count("Join") == 2
    assert review.export_rows(queries, candidates, selections.unionByName(selections)).count() == 2
