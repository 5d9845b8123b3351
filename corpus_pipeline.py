"""A corpus from raw documents: language, quality, near copies, mixture, tokens.

Null, empty and wordless texts have no language and go with the first stage; repeated rows and copies are one document after
the third; rows without an id are judged like others. Columns beside those that a stage reads stay, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import language_id, mixing, neardup, pieces, quality_classifier
from kindred.llm.common import table
from kindred.runtime import stored

# Token shares of the corpus: nothing of poor quality is wanted, and less of toxic texts than there are.
WEIGHTS = {"good": 0.95, "poor": 0.0, "toxic": 0.05}


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def by_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.draw(docs, table(spark, sf_dir, "labels"), WEIGHTS)


def into_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(docs)


STAGES = [
    ("language ID", by_language),
    ("quality classifier", by_quality),
    ("MinHash near-dedup", without_copies),
    ("mixing sources to target weights", by_mixture),
    ("SentencePiece encoding", into_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table through all stages, each stored in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if at == 0 else stored(docs, "stage"), sf_dir)
    return docs
