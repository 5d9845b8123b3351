"""Batch scoring with a caller's model: scorers by name, one load per task, failures as rows."""

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kindred import schema
from kindred.functions import codes

# A scorer is a function without arguments that loads the model and returns a function of one row.
# That function takes the row as a dict and returns (channel_order, signature, embedding or None).
Scorer = Callable[[], Callable[[dict], tuple]]


class ScorerRegistry:
    """Scorers by name."""

    def __init__(self):
        self._scorers: dict[str, tuple[Scorer, str]] = {}

    def register(self, name: str, scorer: Scorer, display_name: str | None = None) -> None:
        if name in self._scorers:
            raise ValueError(f"scorer {name!r} exists")
        self._scorers[name] = (scorer, display_name or name)

    def get(self, name: str) -> Scorer:
        if name not in self._scorers:
            raise KeyError(f"unknown scorer {name!r}; known: {self.names()}")
        return self._scorers[name][0]

    def names(self) -> list[str]:
        return list(self._scorers)


def batch_score(images: DataFrame, scorer: Scorer, partitions: int | None = None) -> DataFrame:
    """Score every image; the model is loaded once per task and an error of one row stays in that row.

    images has image_uuid and whatever the scorer reads. Filter before this call: no filter passes it.
    partitions spreads an expensive model over more tasks than the input has.
    """
    named = images if "image_original_name" in images.columns else images.withColumn(
        "image_original_name", F.col("image_uuid")
    )
    columns = schema.SCORED.fieldNames()

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = scorer()
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                start = time.perf_counter()
                uuid, name = row["image_uuid"], row["image_original_name"]
                try:
                    order, signature, embedding = extract(row)
                    took = (time.perf_counter() - start) * 1000
                    rows.append((uuid, "ok", order, signature, embedding, name, None, took))
                except Exception as error:  # a bad image must not end the job
                    rows.append((uuid, "failed", None, None, None, name, str(error), None))
            yield pd.DataFrame(rows, columns=columns)

    spread = named if partitions is None else named.repartition(partitions)
    return spread.mapInPandas(score, schema.SCORED)


def feature_columns(scored: DataFrame) -> DataFrame:
    """Codes as text, in the columns of the feature files; columns that are none of the codes' follow."""
    others = [c for c in scored.columns if c not in schema.SCORED.fieldNames()]
    return scored.select(
        "image_uuid",
        codes.base64_text(F.col("signature")).alias("img_feature_value_base64"),
        F.col("channel_order").alias("img_feature_order"),
        codes.base64_text(F.col("embedding")).alias("img_embedding_base64"),
        *others,
    )


def feature_rows(scored: DataFrame) -> DataFrame:
    """Successful results in the shape of the feature files."""
    return feature_columns(scored.filter(F.col("status") == "ok").select(*schema.SCORED.fieldNames()))


def failure_lines(scored: DataFrame) -> DataFrame:
    """name - reason of every failed row."""
    line: Column = F.format_string("%s - %s", "name", "reason")
    return scored.filter(F.col("status") == "failed").select(line.alias("value"))


def counting(scored: DataFrame) -> tuple[DataFrame, Observation]:
    """scored, and its numbers of success and failed, which are there when a job over it has ended: no job of their own."""
    seen = Observation()
    outcome = {
        "success": F.count_if(F.col("status") == "ok"),
        "failed": F.count_if(F.col("status") == "failed"),
    }
    return scored.observe(seen, *[count.alias(name) for name, count in outcome.items()]), seen


def observed_stats(spark: SparkSession, success: int, failed: int, total_images: int, elapsed: float) -> DataFrame:
    """run_stats of numbers that were counted while the job ran."""
    counts = spark.createDataFrame([(success, failed)], "success bigint, failed bigint")
    return _stats(counts, F.lit(total_images), elapsed)


def _stats(counted: DataFrame, total: Column, elapsed: float) -> DataFrame:
    return counted.select(
        "success",
        "failed",
        (total - F.col("success") - F.col("failed")).alias("skipped"),
        F.round(F.col("success") / F.lit(elapsed), 1).alias("per_second"),
    )


def run_stats(scored: DataFrame, total_images: int | Column, elapsed: float) -> DataFrame:
    """One row: success, failed, skipped (images not scored again), images per second."""
    counted = scored.agg(
        F.count_if(F.col("status") == "ok").alias("success"), F.count_if(F.col("status") == "failed").alias("failed")
    )
    return _stats(counted, total_images if isinstance(total_images, Column) else F.lit(total_images), elapsed)
