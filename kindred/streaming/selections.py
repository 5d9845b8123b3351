"""Selection intake as a stream of submissions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kindred.operators.review import latest, validate
from kindred.sinks.commits import CommitLog, State, fresh_name
from kindred.sinks.selections import upsert_published
from kindred.streaming.batches import run_of

ACCEPTED = "query_id string, selected_image_ids array<string>, completed_at timestamp_ntz, submission_id string"
ROWS = "accepted"
# Batches after a snapshot before the next one.
COMMITS = 16


def start_intake(
    submissions: DataFrame, candidates: DataFrame, accepted: str, checkpoint: str, compact_after: int = COMMITS
) -> StreamingQuery:
    """Validate streamed submissions and keep the accepted ones, one commit per batch.

    A batch that is repeated is skipped if its commit stands. Every few batches the newest submission of each query is kept
    as a snapshot, so readers never read the whole history.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        log, stream = CommitLog(batch.sparkSession, accepted), run_of(batch)
        state = log.state()
        if state.runs().get(stream, -1) >= batch_id:
            return
        name = fresh_name()
        checked = validate(batch, candidates).filter("accepted")
        newest = latest(checked, "completed_at", "submission_id")
        columns = ["query_id", "selected_image_ids", "completed_at", "submission_id"]
        newest.select(*columns).write.parquet(log.folder(ROWS, name))
        number = state.number + 1
        while not log.commit(number, name, run=stream, batch=batch_id):  # rows of other streams stand beside these
            number += 1
        if len(log.state().later) >= compact_after:
            compact(log)

    return (
        submissions.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _newest(log: CommitLog, state: State) -> DataFrame:
    folders = log.folders(ROWS, state)
    rows = log.spark.read.schema(ACCEPTED).parquet(*folders) if folders else log.spark.createDataFrame([], ACCEPTED)
    return latest(rows, "completed_at", "submission_id").select("query_id", "selected_image_ids", "completed_at", "submission_id")


def compact(log: CommitLog) -> None:
    """Keep the newest submission of each query of all batches so far as one snapshot."""
    state, name = log.state(), fresh_name()
    if state.later:
        _newest(log, state).write.parquet(log.folder(ROWS, name))
        log.snapshot(state, name)


def current_selections(spark: SparkSession, accepted: str) -> DataFrame:
    """The newest accepted submission of each query: query_id, selected_image_ids, completed_at.

    Reads the last snapshot and the batches after it. Before the first batch there is none.
    """
    log = CommitLog(spark, accepted)
    return _newest(log, log.state()).drop("submission_id")


def publish_current(spark: SparkSession, accepted: str, snapshots: str) -> int:
    """Publish the streamed submissions on top of the stored selections: the newer one of a query stays."""
    return upsert_published(current_selections(spark, accepted), snapshots)
