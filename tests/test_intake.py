import datetime as dt

from pyspark.sql import functions as F

from kindred.sinks.commits import CommitLog
from kindred.sinks.selections import publish_selections, published_selections
from kindred.streaming.selections import current_selections, publish_current, start_intake

DAY = dt.datetime(2026, 1, 1)


def test_later_submissions_win_over_batches(spark, tmp_path):
    shape = "submission_id string, query_id string, selected_image_ids array<string>, completed_at timestamp_ntz"
    candidates = spark.createDataFrame([("q1", "a"), ("q1", "b"), ("q2", "a")], "query_id string, image_uuid string")

    def arrive(rows):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        arriving = spark.readStream.schema(shape).parquet(f"{tmp_path}/in")
        start_intake(arriving, candidates, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        current = current_selections(spark, f"{tmp_path}/out")
        return {r["query_id"]: r["selected_image_ids"] for r in current.collect()}

    assert arrive([("1", "q1", ["a", "x", "a"], DAY), ("2", "q2", ["b"], DAY)]) == {"q1": ["a"]}
    assert arrive([("3", "q1", ["b", "a"], DAY + dt.timedelta(1)), ("4", "q2", ["a"], DAY)]) == {"q1": ["b", "a"], "q2": ["a"]}
    # An earlier completion that arrives late changes nothing.
    assert arrive([("5", "q1", ["a"], DAY - dt.timedelta(1))]) == {"q1": ["b", "a"], "q2": ["a"]}
    log = CommitLog(spark, f"{tmp_path}/out")
    assert spark.read.parquet(*log.folders("accepted", log.state())).agg(F.count("*")).first()[0] == 4


def test_first_read_and_publishing_on_top_of_the_stored_ones(spark, tmp_path):
    accepted, snapshots = f"{tmp_path}/out", f"{tmp_path}/snapshots"
    assert current_selections(spark, accepted).count() == 0
    shape = "query_id string, selected_image_ids array<string>, completed_at timestamp_ntz"
    old = [("q1", ["z"], DAY + dt.timedelta(9)), ("q2", ["z"], DAY - dt.timedelta(9)), ("q3", ["z"], DAY)]
    publish_selections(spark.createDataFrame(old, shape), snapshots)
    rows = [("q1", ["a"], DAY, "1"), ("q2", ["b"], DAY, "2")]
    more = f"{shape}, submission_id string"
    log = CommitLog(spark, accepted)
    spark.createDataFrame(rows, more).write.parquet(log.folder("accepted", "0" * 32))
    assert log.commit(1, "0" * 32, run="x", batch=0)
    assert publish_current(spark, accepted, snapshots) == 2
    got = {r["query_id"]: r["selected_image_ids"] for r in published_selections(spark, snapshots).collect()}
    assert got == {"q1": ["z"], "q2": ["b"], "q3": ["z"]}
