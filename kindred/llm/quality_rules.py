"""Quality rules: hashed n-gram likelihood ratio between trusted and raw text, with plain rules before it.

Two multinomials over hashed character trigrams (case kept) are counted: one over the trusted documents, one over all
documents, both smoothed. A document's value is the mean log ratio of its trigrams, so long and short texts compare; it
is kept if that is at least `THRESHOLD`, the same for every document and free of chance, and if no base rule fails.

Words are `[^\\x20\\x09-\\x0D]+`. Base rules: `n_dup_lines` counts the \\n-split lines with a word that equal an earlier
line, `n_repeat_words` the words in five-word windows found twice or more in the text. Defined results: null is the
empty text, which fails the base rules (fewer than ten words) and has ratio 0; texts under three characters have ratio
0; a document listed several times as trusted counts once; repeated rows each count. Without trusted rows all ratios
are 0. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import code_points, in_batches, mixed, slices, sums, words

BUCKETS = 1 << 16
SMOOTHING = 0.5
THRESHOLD = -0.5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"


def _trigrams(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram at each character, and which of them lie within one text."""
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    packed = points.astype(np.uint64)
    packed = (packed[:-2] << np.uint64(42)) | (packed[1:-1] << np.uint64(21)) | packed[2:]
    inside = np.ones(len(packed), bool)
    for back in (1, 2):
        ends = offsets[1:] - back
        # An empty or short text ends where another one's trigrams start.
        inside[ends[(ends >= 0) & (ends < len(packed)) & (ends >= offsets[:-1])]] = False
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return (mixed(packed) >> shift).astype(np.int64), inside


def counts(texts: DataFrame) -> np.ndarray:
    """How often each trigram bucket occurs in all texts. Every task adds up its own texts first."""

    def count(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch):
                buckets, inside = _trigrams(*code_points(part.column("text")))
                total += np.bincount(buckets[inside], minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    found = in_batches(texts.select("text"), count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(BUCKETS, np.int64)
    for row in found.collect():  # at most BUCKETS rows
        total[row["bucket"]] = row["n"]
    return total


def log_ratios(trusted: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log(p_trusted / p_raw) of each bucket; both multinomials have SMOOTHING added to every count."""
    if not trusted.sum():
        return np.zeros(BUCKETS)
    target, base = trusted + SMOOTHING, raw + SMOOTHING
    return np.log(target / target.sum()) - np.log(base / base.sum())


def repeated_words(offsets: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a window of WINDOW words which the text holds twice or more."""
    many = len(codes) - WINDOW + 1
    if many < 1:
        return np.zeros(len(offsets) - 1, np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    window = owner[:many].astype(np.uint64)
    for step in range(WINDOW):
        window = mixed(window * np.uint64(0x9E3779B97F4A7C15) + codes[step : step + many].astype(np.uint64))
    whole = np.flatnonzero(owner[:many] == owner[WINDOW - 1 :])
    order = whole[np.argsort(window[whole], kind="stable")]
    same = window[order[1:]] == window[order[:-1]]
    repeated = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order
    edges = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edges, repeated, 1)
    np.add.at(edges, repeated + WINDOW, -1)
    return sums((np.cumsum(edges)[:-1] > 0).astype(np.int64), offsets)


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier line."""
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    spoken = pc.not_equal(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0)
    owner = owner[spoken.to_numpy(zero_copy_only=False)]
    codes = lines.filter(spoken).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = np.unique((owner.astype(np.int64) << 32) | codes) >> 32
    return np.bincount(owner, minlength=len(texts)) - np.bincount(distinct, minlength=len(texts))


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base columns of each text."""
    texts = pc.fill_null(texts, "")
    offsets, codes, distinct = words(texts)
    points, ends = code_points(texts)
    is_symbol = np.zeros(128, np.int64)
    is_symbol[[ord(c) for c in SYMBOLS]] = 1
    lengths = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    return {
        "n_words": np.diff(offsets),
        "word_chars": sums(lengths[codes], offsets),
        "n_symbols": sums(np.where(points < 128, is_symbol[np.minimum(points, 127)], 0), ends),
        "n_dup_lines": duplicate_lines(texts),
        "n_repeat_words": repeated_words(offsets, codes),
    }


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The base columns, base_failed, kept and ratio of every document.

    trusted: doc_id of the documents whose text is the target. Their texts are joined by id once, to be counted; all
    else is a map over the documents.
    """
    chosen = trusted.select("doc_id").filter(F.col("doc_id").isNotNull())
    raw = counts(docs)
    # The list of trusted ids grows with the corpus, so it is never sent whole to the tasks.
    trusted_texts = docs.select("doc_id", "text").join(chosen.hint("merge"), "doc_id", "left_semi")
    ratios = log_ratios(counts(trusted_texts), raw)
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                base = measures(part.column("text"))
                points, ends = code_points(part.column("text"))
                buckets, inside = _trigrams(points, ends)
                value = np.zeros(len(points))
                value[: len(buckets)] = np.where(inside, ratios[buckets], 0)
                ratio = sums(value, ends) / np.maximum(np.diff(ends) - 2, 1)
                failed = (base["n_words"] < LEAST_WORDS) | (
                    100 * base["n_repeat_words"] > MOST_REPEATED_PERCENT * base["n_words"]
                )
                columns = {**base, "base_failed": failed, "kept": ~failed & (ratio >= threshold), "ratio": ratio}
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *map(pa.array, columns.values())], ["doc_id", *columns]
                )

    return in_batches(
        docs.select("doc_id", "text"),
        run,
        f"doc_id {ids}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, ratio double",
    )


def by_labels(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """judge() with the documents that `labels` marks as good (quality 1) as the trusted ones."""
    return judge(docs, labels.filter(F.col("quality") == 1), threshold)
