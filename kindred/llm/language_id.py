"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts become counts of hashed character 1-, 2- and 3-grams (lower case), weighted by `log(1 + count)` times an
inverse document frequency counted over every training document, at unit length. The weights are learned with
follow-the-regularised-leader (per-coordinate steps, elastic net) on a bounded sample, and a temperature fitted on
rows of the sample that were not trained on makes the probabilities honest.

Defined results: a null text, an empty one or one without any letter is `und` with score 0; long texts are read whole;
repeated rows are predicted one by one; languages of null are never learned; equal probabilities go to the language
that sorts first; without training rows everything is `und`. Only the named columns are read, so others may clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from kindred.llm.common import code_points, in_batches, remainder, slices

BUCKETS = 1 << 15
# Bounds of the training sample: at most so many documents of each language, so many of all, and so many languages, those
# with the most documents; rarer ones are not learned.
SAMPLE_PER_LANGUAGE = 1000
SAMPLE_ROWS = 40_000
LANGUAGES = 200
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Settings:
    """Learning rate (alpha, beta), elastic net (l1, l2), passes over the sample, and its share for calibration."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    epochs: int = 2
    calibration_share: float = 0.2
    per_language: int = SAMPLE_PER_LANGUAGE


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    idf: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    temperature: float = 1.0


def _document_counts(batch: pa.RecordBatch):
    """For each text of the batch its row, buckets with at least one n-gram, and their counts."""
    start = 0
    for part in slices(batch):
        points, offsets = code_points(pc.utf8_lower(part.column("text")))
        points = points.astype(np.uint32)
        two = points[:-1] * np.uint32(0x9E3779B1) + points[1:]
        three = two[:-1] * np.uint32(0x85EBCA6B) + points[2:]
        shift = np.uint32(32 - BUCKETS.bit_length() + 1)
        grams = [((g * np.uint32(0xC2B2AE35)) >> shift).astype(np.int32) for g in (points, two, three)]
        for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
            # An n-gram of n characters starts at n - 1 places fewer.
            own = np.concatenate([g[a : max(a, b - n)] for n, g in enumerate(grams)])
            counts = np.bincount(own, minlength=BUCKETS)
            held = np.flatnonzero(counts)
            yield start + row, held, counts[held]
        start += part.num_rows


def _features(held: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = np.log1p(counts) * idf[held]
    return values / max(np.sqrt(values @ values), 1e-12)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts. Every task adds up its own texts first."""

    def count(batches):
        frequency, texts = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in batches:
            for _, held, _ in _document_counts(batch):
                frequency[held] += 1
                texts += 1
        frequency[BUCKETS] = texts
        kept = np.flatnonzero(frequency)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(frequency[kept])], ["bucket", "n"])

    found = in_batches(texts.select("text"), count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    frequency = np.zeros(BUCKETS + 1, np.int64)
    for row in found.collect():  # at most BUCKETS + 1 rows
        frequency[row["bucket"]] = row["n"]
    return frequency[:BUCKETS], int(frequency[BUCKETS])


def _sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """At most per_language rows of each of the LANGUAGES most frequent languages, those with the smallest hash of the id."""
    most = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    counts = {r["lang"]: r["n"] for r in most.collect()}
    if not counts:
        return labelled.limit(0)
    per_language = min(per_language, SAMPLE_ROWS // len(counts))
    # Far fewer rows reach the ranking below when only hashes that can win are let through.
    chance = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2.0 * per_language / n))])
    key = F.xxhash64(F.col("doc_id"), F.lit("language"))
    drawn = labelled.select("doc_id", "lang", "text", key.alias("_key")).filter(
        F.pmod("_key", F.lit(1_000_003)) < F.lit(1_000_003) * chance[F.col("lang")]
    )
    ranked = Window.partitionBy("lang").orderBy("_key", "doc_id", F.xxhash64("text"))
    return drawn.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= per_language)


def _learn(rows: list, classes: int, settings: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, bias and temperature from (buckets, values, class) rows in a fixed order."""
    spared = max(1, round(1 / settings.calibration_share)) if settings.calibration_share > 0 else 0
    kept_back = [r for i, r in enumerate(rows) if spared and i % spared == spared - 1]
    trained = [r for i, r in enumerate(rows) if not spared or i % spared != spared - 1] or rows
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights_at(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - settings.l1, 0)
        return -shrunk / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2)

    for _ in range(settings.epochs):
        for held, values, label in trained:
            at, x = np.append(held, BUCKETS), np.append(values, 1.0)
            w = weights_at(at)
            error = _softmax(x @ w)
            error[label] -= 1
            gradient = x[:, None] * error
            squares = gradient * gradient
            z[at] += gradient - (np.sqrt(n[at] + squares) - np.sqrt(n[at])) / settings.alpha * w
            n[at] += squares
    w = weights_at(np.arange(BUCKETS + 1))
    logits = np.array([v @ w[h] + w[BUCKETS] for h, v, _ in kept_back]).reshape(-1, classes)
    labels = np.array([c for _, _, c in kept_back], int)
    return w[:BUCKETS], w[BUCKETS], _temperature(logits, labels)


def _softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(-1, keepdims=True))
    return raised / raised.sum(-1, keepdims=True)


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the best likelihood among 0.25 to 20 in steps of 2 %."""
    if not len(labels):
        return 1.0
    choices = np.geomspace(0.25, 20, 222)
    best = [np.log(_softmax(logits / t)[np.arange(len(labels)), labels] + 1e-9).sum() for t in choices]
    return float(choices[int(np.argmax(best))])


def train(labelled: DataFrame, settings: Settings | None = None) -> Model:
    """Learns from (doc_id, text, lang) rows with a language; document frequencies come from all of them."""
    settings = settings or Settings()
    labelled = labelled.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull())
    frequency, texts = document_frequencies(labelled)
    if not texts:
        return Model()
    idf = np.log((1 + texts) / (1 + frequency)) + 1

    def featurise(batches):
        for batch in batches:
            found = [(h.astype(np.int32), _features(h, c, idf)) for _, h, c in _document_counts(batch)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_key"),
                    batch.column("lang"),
                    pa.array([h.tobytes() for h, _ in found], pa.binary()),
                    pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary()),
                ],
                ["key", "lang", "held", "vals"],
            )

    def learn(batches):
        rows = [r for batch in batches for r in batch.to_pylist()]
        # In hash order the languages are mixed; the bytes settle equal hashes.
        rows.sort(key=lambda r: (r["key"], r["lang"], r["held"], r["vals"]))
        languages = sorted({r["lang"] for r in rows})
        if not rows:
            return
        examples = [
            (np.frombuffer(r["held"], np.int32), np.frombuffer(r["vals"], np.float32), languages.index(r["lang"]))
            for r in rows
        ]
        weights, bias, temperature = _learn(examples, len(languages), settings)
        yield pa.RecordBatch.from_pylist(
            [
                {
                    "languages": languages,
                    "weights": weights.astype(np.float32).tobytes(),
                    "bias": bias.tobytes(),
                    "temperature": temperature,
                }
            ]
        )

    sample = in_batches(
        _sample(labelled, settings.per_language).select("_key", "lang", "text"),
        featurise,
        "key long, lang string, held binary, vals binary",
    )
    # The sample is bounded, so one task can learn from it; a lost executor repeats it with the same result.
    fitted = in_batches(
        sample.repartition(1), learn, "languages array<string>, weights binary, bias binary, temperature double"
    ).collect()
    if not fitted:
        return Model()
    row = fitted[0]
    return Model(
        list(row["languages"]),
        idf.astype(np.float32),
        np.frombuffer(row["weights"], np.float32).reshape(BUCKETS, -1),
        np.frombuffer(row["bias"]),
        row["temperature"],
    )


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs (doc_id, text); a map without any shuffle."""
    return with_prediction(docs.select("doc_id", "text"), model).select(
        "doc_id", F.col("_kd_lang").alias("lang_pred"), F.col("_kd_score").alias("score")
    )


def identify(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from rows whose crc32(doc_id) mod 3 is not 1."""
    held_out = remainder("doc_id", 3) == 1
    model = train(docs.filter(~held_out), settings)
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.4, settings: Settings | None = None) -> DataFrame:
    """docs without the rows that have no letter or whose language is less certain than `least`."""
    model = train(docs.filter(remainder("doc_id", 3) != 1), settings)
    judged = with_prediction(docs, model)
    return judged.filter((F.col("_kd_lang") != UNKNOWN) & (F.col("_kd_score") >= least)).drop("_kd_lang", "_kd_score")


def with_prediction(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the columns _kd_lang and _kd_score beside their own, in the same map task: no join by an id."""
    schema = StructType([*docs.schema.fields, StructField("_kd_lang", StringType()), StructField("_kd_score", DoubleType())])

    def run(batches):
        for batch in batches:
            found, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            texts = batch.column("text")
            for row, held, counts in _document_counts(batch) if model.languages else ():
                if LETTER.search(texts[row].as_py() or ""):
                    logits = _features(held, counts, model.idf) @ model.weights[held] + model.bias
                    chances = _softmax(logits / model.temperature)
                    best = int(np.argmax(chances))
                    found[row], scores[row] = model.languages[best], chances[best]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array(scores)],
                [*batch.schema.names, "_kd_lang", "_kd_score"],
            )

    return in_batches(docs, run, schema)
