"""Feature files: text on disk, typed view, keys and file numbers.

A chunk is a file prefix_007.csv or, as the sink writes it, a folder feature_file=prefix_007; those of a feature
store lie in the folder of their commit.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred import schema
from kindred.functions import codes
from kindred.operators.skew import sent_if_small
from kindred.sinks.commits import CommitLog
from kindred.sources import files


COMMIT = r"/commit=([0-9a-f]{32})/"


def _chunk_reader(spark: SparkSession):
    return (
        spark.read.schema(schema.FEATURE_FILE)
        .option("header", "true")
        .option("quote", '"')
        .option("escape", '"')
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv")
    )


def _commit() -> Column:
    """Name of the commit that a chunk belongs to, empty for chunks written without one."""
    return F.regexp_extract(F.col("_metadata.file_path"), COMMIT, 1)


def committed_names(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Names of all commits of a feature store, and their number."""
    log = CommitLog(spark, f"{path}/_store")
    state = log.state()
    names = spark.createDataFrame([(c.name,) for c in state.later], "name string")
    if state.snapshot:
        names = names.unionByName(spark.read.schema("name string").parquet(log.folder("names", state.snapshot)))
    return names, state.number


def read_feature_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all chunks; those of a commit that is not finished, or never was, are left out."""
    names, count = committed_names(spark, path)
    rows = _chunk_reader(spark).csv(path)
    if count == 0:
        return rows.filter(_commit() == "")
    # The empty name stands for chunks without a commit.
    known = names.unionByName(spark.createDataFrame([("",)], "name string"))
    wanted = sent_if_small(known.withColumnRenamed("name", "_commit"), count + 1)
    return rows.withColumn("_commit", _commit()).join(wanted, "_commit", "left_semi").drop("_commit")


def decoded(features: DataFrame) -> DataFrame:
    """Typed codes: image_uuid, signature, channel_order, embedding; an empty embedding is null."""
    return features.select(
        "image_uuid",
        codes.base64_code(F.col("img_feature_value_base64")).alias("signature"),
        codes.int_list(F.col("img_feature_order")).alias("channel_order"),
        codes.float16_decode(codes.base64_code(F.col("img_embedding_base64"))).alias("embedding"),
    )


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Decoded features; no file is an error."""
    if not files.exists(spark, path):
        raise FileNotFoundError(f"no feature file: {path}")
    return decoded(read_feature_files(spark, path))


def keys_of_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Uuids of the chunks that were written without a commit, each once; none if there is no such file."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], "image_uuid string")
    return _chunk_reader(spark).csv(path).filter(_commit() == "").select("image_uuid").distinct()


def processed_keys(spark: SparkSession, path: str) -> DataFrame:
    """Stored uuids, each once, from the store's ledger; of a folder without commits, from its chunks."""
    log = CommitLog(spark, f"{path}/_store")
    folders = log.folders("keys", log.state())
    return spark.read.schema("image_uuid string").parquet(*folders) if folders else keys_of_chunks(spark, path)


def max_file_index(paths: DataFrame) -> DataFrame:
    """Highest chunk number among paths, 0 if there is none; other names are ignored: file_index."""
    chunk = F.regexp_replace(F.regexp_extract("path", r"feature_file=([^/]+)/", 1), r"^$", "")
    name = F.when(chunk != "", chunk).otherwise(files.stem(files.file_name(F.col("path"))))
    number = F.get(F.split(name, "_"), F.lit(1)).try_cast("bigint")
    return paths.agg(F.coalesce(F.max(number), F.lit(0)).alias("file_index"))


def chunk_index(spark: SparkSession, path: str) -> int:
    """Highest chunk number among the files of a folder, 0 if there is none."""
    if not files.exists(spark, path):
        return 0
    csv_files = files.list_files(spark, path, recursive=True).filter(F.col("path").endswith(".csv"))
    return max_file_index(csv_files).first()["file_index"]


def existing_file_index(spark: SparkSession, path: str) -> int:
    """Highest chunk number of a store, as its newest commit says; without commits, of the files."""
    newest = CommitLog(spark, f"{path}/_store").state().newest
    return newest.info["last_chunk"] if newest else chunk_index(spark, path)
