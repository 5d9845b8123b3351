"""Batches of a stream."""

from pyspark.sql import DataFrame


def run_of(batch: DataFrame) -> str:
    """Id of the stream that a batch belongs to; it lives as long as the stream's checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
