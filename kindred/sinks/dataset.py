"""Training data: manifest and label texts as keyed tables."""

from pyspark.sql import DataFrame


def write_manifest(manifest_rows: DataFrame, path: str) -> None:
    manifest_rows.write.mode("overwrite").partitionBy("split").parquet(path)


def write_label_files(label_files: DataFrame, path: str) -> None:
    """One row per label file, keyed by split and safe name."""
    label_files.write.mode("overwrite").partitionBy("split").parquet(path)
