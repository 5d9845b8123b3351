"""Helpers shared by the operators: reading tables, Arrow batches, tokens as arrays, hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of one Arrow batch; texts are long, so the default of 10,000 rows would not bound a task's memory.
BATCH_ROWS = 512
# Texts of a batch are worked through in slices of about this many bytes.
SLICE_BYTES = 4_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def in_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str):
    """df.mapInArrow with batches of at most BATCH_ROWS rows (a session setting, lowered if it is larger)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the column's text, modulo; a null id counts as the empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(modulus)


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about `size` bytes; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes, dtype=np.int64) - sizes) // size
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    for start, end in zip(starts, [*starts[1:], len(part)]):
        yield batch.slice(start, end - start)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text: offsets per text, word numbers, and the distinct words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    keep = pc.not_equal(flat, "")
    owner = np.repeat(np.arange(len(lengths)), lengths)[keep.to_numpy(zero_copy_only=False)]
    coded = flat.filter(keep).dictionary_encode()
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=len(lengths)), out=offsets[1:])
    return offsets, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points in one array, and the offset of each text."""
    values = pc.fill_null(texts, "")
    lengths = pc.utf8_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    joined = "".join(values.to_pylist())
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit hashes of 64-bit integers (the finalizer of the splitmix64 generator)."""
    x = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """64-bit hash of each word: the sum of the hashes of its (byte, place) pairs, hashed again with its length."""
    raw = distinct.cast(pa.binary())
    lengths = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).astype(np.uint64)
    places = np.arange(len(data), dtype=np.int64) - np.repeat(offsets[:-1], lengths)
    parts = mixed(data | (places.astype(np.uint64) << np.uint64(8)))
    return mixed(sums(parts, offsets) + lengths.astype(np.uint64))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values within each offset range; empty ranges give 0."""
    running = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return running[offsets[1:]] - running[offsets[:-1]]
