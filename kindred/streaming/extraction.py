"""Incremental extraction as a stream over the image-list folder, into the same feature store as the batch job."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from kindred.operators.extraction import Scorer, batch_score
from kindred.runtime import stored
from kindred.sinks.store import COMMITS, IMAGE_COLUMNS, FeatureStore
from kindred.sources.images import list_reader, with_names
from kindred.streaming.batches import run_of


def open_failures(spark: SparkSession, features: str) -> DataFrame:
    """Images whose last try failed."""
    return FeatureStore(spark, features).open_failures()


ARRIVED = "arrived"


class Progress(StreamingQueryListener):
    """Batches of extraction streams as they end: stream, batch, images that arrived in it.

    Add one to spark.streams to follow runs; what became of the images is in FeatureStore.history, by the same stream and batch.
    """

    def __init__(self) -> None:
        self.batches: list[tuple[str, int, int]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(ARRIVED)
        if seen is not None:
            self.batches.append((str(event.progress.id), event.progress.batchId, seen["images"]))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def start_extraction(
    spark: SparkSession, images: DataFrame, scorer: Scorer, features: str, checkpoint: str, compact_after: int = COMMITS
) -> StreamingQuery:
    """Score all new images of a streaming image list, retry earlier failures, append the results to the store.

    The file source hands every row out once; the store's failures are what brings failed rows back. A batch is one commit: a
    batch that is repeated after a crash is skipped if its commit stands, and else done again.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        store = FeatureStore(batch.sparkSession, features, compact_after)
        state, stream = store.log.state(), run_of(batch)
        if store.has(stream, batch_id, state):
            return
        # Stored, so that the arriving files are read, and their rows observed, once.
        arrived = stored(batch.select(*IMAGE_COLUMNS), "arrived")
        rows = arrived.unionByName(store.open_failures(state).select(*IMAGE_COLUMNS))
        todo = store.missing(rows, state, rows.count())
        store.commit(batch_score(todo, scorer), todo, stream, batch_id)

    return (
        images.observe(ARRIVED, F.count("*").alias("images"))
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def image_list_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """New image-list files of a folder as they arrive, read by the rules of the batch reader."""
    reader = list_reader(spark.readStream)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return with_names(reader.csv(folder))
