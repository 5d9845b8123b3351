"""Feature extractors as a table, and requests that name them.

registry: name, display_name, loaded, input_w, input_h, one row per extractor known to this process.
requests: request_id, names (null or empty asks for all loaded ones).
"""

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import codes
from kindred.operators.extraction import Scorer, ScorerRegistry, batch_score

# Runs whose rank the latency sketches tell apart.
LATENCY_ACCURACY = 100_000

REGISTRY_SCHEMA = "name string, display_name string, loaded boolean, input_w int, input_h int"


@dataclass(frozen=True)
class Backbone:
    """An extractor: its scorer, if it is loaded, and how many channels its list shows (None: all)."""

    name: str
    display_name: str
    loaded: bool = True
    input_w: int = 224
    input_h: int = 224
    scorer: Scorer | None = None
    channels: int | None = None


def scorers(backbones: Sequence[Backbone]) -> ScorerRegistry:
    """The loaded extractors by name, for a batch run with one of them."""
    registry = ScorerRegistry()
    for backbone in backbones:
        if backbone.loaded and backbone.scorer is not None:
            registry.register(backbone.name, backbone.scorer, backbone.display_name)
    return registry


def registry_table(spark: SparkSession, backbones: Sequence[Backbone]) -> DataFrame:
    rows = [(b.name, b.display_name, b.loaded, b.input_w, b.input_h) for b in backbones]
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


def _names(backbones: Sequence[Backbone]) -> Column:
    return F.array(*[F.lit(b.name) for b in backbones]).cast("array<string>")


def _asks_all() -> Column:
    return F.col("names").isNull() | (F.size("names") == 0)


def backbone_targets(requests: DataFrame, backbones: Sequence[Backbone]) -> DataFrame:
    """Targets of each request in request order, each once, and the unknown names: request_id, targets,
    unknown, status. Without names all loaded extractors are meant; no target is an error."""
    loaded = _names([b for b in backbones if b.loaded])
    targets = F.when(_asks_all(), loaded).otherwise(F.array_intersect("names", _names(backbones)))
    unknown = F.when(_asks_all(), F.array().cast("array<string>")).otherwise(
        F.array_except("names", _names(backbones))
    )
    return requests.select("request_id", targets.alias("targets"), unknown.alias("unknown")).withColumn(
        "status", F.when(F.size("targets") == 0, F.lit("no loaded backbone")).otherwise(F.lit("ok"))
    )


def lookup(requested: DataFrame, backbones: Sequence[Backbone]) -> DataFrame:
    """Each requested name with its status: ok, not loaded, unknown. requested: request_id, name."""
    name = F.col("name")
    known = name.isin([b.name for b in backbones])
    loaded = name.isin([b.name for b in backbones if b.loaded])
    return requested.withColumn(
        "status", F.when(loaded, "ok").when(known, "not loaded").otherwise("unknown")
    )


def usage(requests: DataFrame, backbones: Sequence[Backbone]) -> DataFrame:
    """The registry with the number of requests each extractor is a target of, 0 included."""
    counts = (
        backbone_targets(requests, backbones)
        .select(F.explode("targets").alias("name"))
        .groupBy("name")
        .agg(F.count("*").alias("n"))
    )
    registry = registry_table(requests.sparkSession, backbones)
    return registry.join(counts, "name", "left").select(
        *registry.columns, F.coalesce("n", F.lit(0)).alias("requests")
    )


def run_targets(targets: DataFrame, images: DataFrame, backbones: Sequence[Backbone]) -> DataFrame:
    """Runs every target of a request on its image: request_id, name, status, channel_order, reason, latency_ms.

    images: request_id, image_uuid and what the scorers read. An extractor that fails, or is not loaded, leaves a row that
    says so. Each extractor is one map over its own requests.
    """
    wanted = targets.select("request_id", F.explode("targets").alias("_backbone")).join(images, "request_id")
    known = scorers(backbones)
    kind = targets.schema["request_id"].dataType
    runs = []
    for backbone in backbones:
        own = wanted.filter(F.col("_backbone") == backbone.name).drop("_backbone")
        if backbone.name in known.names():
            named = own.withColumn("image_original_name", F.col("request_id").cast("string"))
            scored = batch_score(named, known.get(backbone.name))
            order = F.col("channel_order")
            if backbone.channels is not None:
                order = codes.int_list_text(F.slice(codes.int_list(order), 1, backbone.channels))
            shown = F.when(F.col("status") == "ok", order)
            runs.append(
                scored.select(
                    F.col("name").cast(kind).alias("request_id"),
                    F.lit(backbone.name).alias("name"),
                    "status",
                    shown.alias("channel_order"),
                    "reason",
                    "latency_ms",
                )
            )
        else:
            nothing = F.lit(None)
            runs.append(
                own.select(
                    "request_id",
                    F.lit(backbone.name).alias("name"),
                    F.lit("failed").alias("status"),
                    nothing.cast("string").alias("channel_order"),
                    F.lit("not loaded").alias("reason"),
                    nothing.cast("double").alias("latency_ms"),
                )
            )
    return reduce(DataFrame.unionByName, runs)


def compare_backbones(targets: DataFrame, scored: DataFrame) -> DataFrame:
    """Result of every target of a request: request_id, name, channel_order, error, latency_ms (2 digits).

    scored: request_id, name, status, channel_order, reason, latency_ms. A failing extractor leaves an
    error in its own row; the others stand.
    """
    wanted = targets.select("request_id", F.explode("targets").alias("name"))
    ok = F.col("status") == "ok"
    return wanted.join(scored, ["request_id", "name"], "left").select(
        "request_id",
        "name",
        F.when(ok, F.col("channel_order")).alias("channel_order"),
        F.when(~F.coalesce(ok, F.lit(False)), F.coalesce("reason", F.lit("no result"))).alias("error"),
        F.when(ok, F.round("latency_ms", 2)).alias("latency_ms"),
    )


def latency_by_backbone(scored: DataFrame, accuracy: int = LATENCY_ACCURACY) -> DataFrame:
    """Runs and latency by extractor, successful ones only: name, runs, avg_ms, min_ms, p50_ms, p95_ms, max_ms.

    Quantiles come from mergeable sketches: ranks are exact up to 1 / accuracy of the runs.
    """
    quantiles = F.percentile_approx("latency_ms", [0.5, 0.95], accuracy)
    return (
        scored.filter(F.col("status") == "ok")
        .groupBy("name")
        .agg(
            F.count("*").alias("runs"),
            F.round(F.avg("latency_ms"), 2).alias("avg_ms"),
            F.round(F.min("latency_ms"), 2).alias("min_ms"),
            F.round(quantiles[0], 2).alias("p50_ms"),
            F.round(quantiles[1], 2).alias("p95_ms"),
            F.round(F.max("latency_ms"), 2).alias("max_ms"),
        )
    )
