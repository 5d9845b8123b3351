"""Published selection snapshots: every save writes a new version, readers take the newest whole one."""

from pyspark.sql import DataFrame, SparkSession

from kindred.operators.review import latest
from kindred.sinks import versions

SNAPSHOT = "query_id string, selected_image_ids array<string>, completed_at timestamp_ntz"


def publish_selections(selections: DataFrame, path: str) -> int:
    """Write the rows as the next version and mark it; the version before stays readable until then."""
    return versions.publish_rows(selections, path)


def published_selections(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Rows of a version, by default the newest; empty before the first."""
    version = versions.number(spark, path) if version is None else version
    if version == 0:
        return spark.createDataFrame([], SNAPSHOT)
    return spark.read.schema(SNAPSHOT).parquet(versions.folder(spark, path, version))


def upsert_published(selections: DataFrame, path: str) -> int:
    """Publish the selections on top of the stored ones: the newer one of a query stays.

    A writer that comes second merges again with what the first has published, so no selection is lost.
    """
    spark = selections.sparkSession
    rows = selections.select("query_id", "selected_image_ids", "completed_at")

    def write(folder: str, base: int) -> None:
        merged = latest(rows.unionByName(published_selections(spark, path, base)), "completed_at", "query_id")
        merged.select(*rows.columns).write.parquet(folder)

    return versions.publish_on(spark, path, write)
