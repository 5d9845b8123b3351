"""Batch extraction from image lists to a feature store."""

import time
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kindred.operators.extraction import Scorer, batch_score, failure_lines, observed_stats
from kindred.runtime import stored
from kindred.sinks.features import write_failure_log
from kindred.sinks.store import FeatureStore
from kindred.sources.images import read_image_list


def extract(
    spark: SparkSession,
    image_lists: str,
    features: str,
    failure_log: str,
    scorer: Scorer,
    partitions: int | None = None,
    commits: int = 1,
) -> DataFrame:
    """Score the images without stored features and append them to the store: one row of run statistics.

    commits: the images are dealt into so many parts by their uuid, each a commit of its own. What is committed is there if the
    run ends early, and FeatureStore.history shows how far a run has come. The numbers are counted by the jobs as they run.
    """
    start = time.monotonic()
    store = FeatureStore(spark, features)
    images = read_image_list(spark, image_lists).select("image_uuid", "image_url", "image_original_name")
    if commits > 1:
        images = stored(images, "images")
    total = success = failed = 0
    scored = []
    for at in range(commits):
        arrived = Observation()
        part = images.filter(F.pmod(F.xxhash64("image_uuid"), F.lit(commits)) == at) if commits > 1 else images
        todo = store.missing(part.observe(arrived, F.count("*").alias("images")))
        outcome = store.commit(batch_score(todo, scorer, partitions), todo)
        total += arrived.get["images"]
        success, failed = success + outcome.counts["success"], failed + outcome.counts["failed"]
        scored.append(failure_lines(outcome.scored))
    write_failure_log(reduce(DataFrame.union, scored), failure_log)
    return observed_stats(spark, success, failed, total, time.monotonic() - start)
