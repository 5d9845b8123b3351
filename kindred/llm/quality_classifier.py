"""Quality classifier: supervised subword embeddings with a softmax output, trained by stochastic gradient descent.

Every word stands for itself and for its character 3- to 5-grams (of `<word>`); each of these features has a learned
vector in a hashed table; a word that repeats the word before it has one more feature, which all words share. A document is the average of the vectors of all its words' features, and a softmax over a
linear layer gives the classes. Since both steps are linear, a feature adds a fixed number to the logits, so scoring
looks up each distinct word of a batch once, however often it occurs.

Training reads a bounded sample of the labelled rows (`SAMPLE_ROWS`); scoring reads every whole text and shuffles
nothing. Defined results: null and empty texts, and texts of white space, have no features and get the score of the
bias alone; labels of null or of a class that is not asked for are not learned; a document labelled several times is
learned with each label; without any label all scores are 0.5. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from kindred.llm.common import code_points, in_batches, mixed, remainder, slices, sums, word_hashes, words

BUCKETS = 1 << 16
# The feature of a word that equals the one before it: a word bigram that all words share.
REPEATED = BUCKETS
NGRAMS = (3, 4, 5)
# Bound of the training sample: at most so many labelled documents.
SAMPLE_ROWS = 6000


@dataclass
class Settings:
    dimension: int = 8
    epochs: int = 5
    least_steps: int = 30_000  # small samples are gone through more often
    rate: float = 0.5
    rows: int = SAMPLE_ROWS
    seed: int = 7


@dataclass
class Model:
    """What each feature bucket adds to the logits (before the division by the number of features), and the bias."""

    logits: np.ndarray
    bias: np.ndarray


def word_features(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all words one after the other, and the offset of each word."""
    marked = pc.binary_join_element_wise("<", distinct, ">", "")
    points, offsets = code_points(marked)
    points, lengths = points.astype(np.uint64), np.diff(offsets)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(offsets[1:], lengths) - np.arange(len(points))  # characters from here to the word's end
    buckets, owners = [word_hashes(distinct)], [np.arange(len(lengths))]
    gram = points
    for n in range(2, max(NGRAMS) + 1):
        gram = gram[:-1] * np.uint64(0x100000001B3) + points[n - 1 :]
        if n in NGRAMS:
            whole = np.flatnonzero(left[: len(gram)] >= n)
            buckets.append(mixed(gram[whole] + np.uint64(n)))
            owners.append(owner[whole])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    flat = (np.concatenate(buckets) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)[order]
    return flat, np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(lengths)))])


def repeats(offsets: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """How many words of each text equal the word before them."""
    same = np.zeros(len(codes), np.int64)
    same[1:] = codes[1:] == codes[:-1]
    same[offsets[:-1][offsets[:-1] < len(codes)]] = 0
    return sums(same, offsets)


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """At most `rows` labelled documents, those with the smallest hash of the id; labels has doc_id and label."""
    labels = labels.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    count = labels.count()
    key = F.xxhash64(F.col("doc_id"), F.lit("labelled"))
    # Twice the wanted number passes, so the sort that cuts to the exact bound stays small.
    chosen = (
        labels.select("doc_id", F.col("label").cast("int").alias("_label"), key.alias("_key"))
        .filter(F.pmod("_key", F.lit(1_000_003)) <= F.lit(2.0 * 1_000_003 * rows / max(count, 1)))
        .orderBy("_key", "doc_id", "_label")
        .limit(rows)
    )
    # Bounded by `rows` narrow rows, so only the texts of the sample are shuffled; an id that many rows share has one text.
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return met.groupBy("doc_id", "_key", "_label").agg(F.min("text").alias("text")).select("_key", "_label", "text")


def _learn(examples: list, classes: int, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Logit table and bias from (buckets, shares, label) rows in a fixed order."""
    draw = np.random.default_rng(settings.seed)
    table = draw.uniform(-1, 1, (BUCKETS + 1, settings.dimension)) / settings.dimension
    output, bias = np.zeros((settings.dimension, classes)), np.zeros(classes)
    epochs = max(settings.epochs, -(-settings.least_steps // len(examples)))
    steps, done = epochs * len(examples), 0
    for _ in range(epochs):
        for at in draw.permutation(len(examples)):
            held, shares, label = examples[at]
            rate = settings.rate * (1 - done / steps)
            done += 1
            hidden = shares @ table[held]
            logits = hidden @ output + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[label] -= 1
            back = output @ error
            output -= rate * np.outer(hidden, error)
            bias -= rate * 0.1 * error
            table[held] -= (rate * shares)[:, None] * back
    return table @ output, bias


def train(docs: DataFrame, labels: DataFrame, classes: int = 2, settings: Settings | None = None) -> Model:
    """Learns from docs (doc_id, text) and labels (doc_id, label in 0 .. classes - 1)."""
    settings = settings or Settings()
    labels = labels.filter(F.col("label").between(0, classes - 1))

    def featurise(batches):
        for batch in batches:
            for part in slices(batch):
                offsets, codes, distinct = words(part.column("text"))
                flat, bounds = word_features(distinct)
                held, shares = [], []
                for a, b, repeated in zip(offsets[:-1], offsets[1:], repeats(offsets, codes)):
                    found, times = np.unique(codes[a:b], return_counts=True)
                    sizes = bounds[found + 1] - bounds[found]
                    at = np.repeat(bounds[found] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                    count = np.bincount(flat[at], np.repeat(times, sizes), minlength=BUCKETS + 1)
                    count[REPEATED] = repeated
                    kept = np.flatnonzero(count)
                    held.append(kept.astype(np.int32).tobytes())
                    shares.append((count[kept] / max(count.sum(), 1)).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("_key"), part.column("_label"), pa.array(held, pa.binary()), pa.array(shares, pa.binary())],
                    ["key", "label", "held", "shares"],
                )

    def learn(batches):
        rows = [r for batch in batches for r in batch.to_pylist()]
        if not rows:
            return
        rows.sort(key=lambda r: (r["key"], r["label"], r["held"], r["shares"]))
        examples = [(np.frombuffer(r["held"], np.int32), np.frombuffer(r["shares"], np.float32), r["label"]) for r in rows]
        logits, bias = _learn(examples, classes, settings)
        yield pa.RecordBatch.from_pylist([{"logits": logits.astype(np.float32).tobytes(), "bias": bias.tobytes()}])

    sample = in_batches(
        _sample(docs, labels, settings.rows), featurise, "key long, label int, held binary, shares binary"
    )
    # The sample is bounded, so one task can learn from it; a lost executor repeats it with the same result.
    fitted = in_batches(sample.repartition(1), learn, "logits binary, bias binary").collect()
    if not fitted:
        return Model(np.zeros((BUCKETS + 1, classes), np.float32), np.zeros(classes))
    return Model(np.frombuffer(fitted[0]["logits"], np.float32).reshape(BUCKETS + 1, classes), np.frombuffer(fitted[0]["bias"]))


def chances(texts: pa.Array, model: Model) -> np.ndarray:
    """Probability of each class for each text."""
    offsets, codes, distinct = words(texts)
    flat, bounds = word_features(distinct)
    sizes = np.diff(bounds)
    repeated = repeats(offsets, codes)
    count = np.maximum(sums(sizes[codes], offsets) + repeated, 1)
    logits = np.stack(
        [
            (
                sums(sums(model.logits[flat, c].astype(np.float64), bounds)[codes], offsets)
                + repeated * float(model.logits[REPEATED, c])
            )
            / count
            + model.bias[c]
            for c in range(len(model.bias))
        ],
        axis=1,
    )
    raised = np.exp(logits - logits.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def with_chances(docs: DataFrame, model: Model, name: str = "_kd_chances") -> DataFrame:
    """docs with an array of class probabilities beside their own columns; a map without any shuffle."""
    schema = StructType([*docs.schema.fields, StructField(name, ArrayType(DoubleType()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = chances(part.column("text"), model)
                lists = pa.ListArray.from_arrays(
                    np.arange(0, found.size + 1, found.shape[1], dtype=np.int32), pa.array(found.ravel())
                )
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, name])

    return in_batches(docs, run, schema)


def quality_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learned: of rows whose crc32(doc_id) mod 5 is not 0."""
    return labels.filter(remainder("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))


def score(docs: DataFrame, labels: DataFrame, least: float = 0.3, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= least) of every document."""
    model = train(docs, quality_labels(labels), 2, settings)
    found = with_chances(docs.select("doc_id", "text"), model)
    chance = F.col("_kd_chances")[1]
    return found.select(
        "doc_id",
        (remainder("doc_id", 5) == 0).alias("held_out"),
        chance.alias("score"),
        (chance >= least).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3, settings: Settings | None = None) -> DataFrame:
    """docs without the rows whose score is under `least`."""
    model = train(docs, quality_labels(labels), 2, settings)
    return with_chances(docs, model).filter(F.col("_kd_chances")[1] >= least).drop("_kd_chances")
