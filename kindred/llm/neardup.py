"""Near-duplicate classes: consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A text is the set of its five-word shingles (words split at white space; a text of one to four words is one shingle),
each weighted by its count times an inverse document frequency. Document frequencies are counted over all documents, for
hashed shingles in `IDF_BUCKETS` buckets; a shingle of every document weighs its count, one of a thousandth of them or fewer
twice that, at every size of the corpus. Improved consistent weighted sampling draws `BANDS * ROWS` samples of each text: two
texts agree in a sample with probability equal to their weighted Jaccard similarity. Texts that agree in all samples of a
band share a bucket; exact similarities decide; classes are the connected components of the links.

Exact copies (equal words in equal order) are one node, so a text copied a million times is compared once. Candidates are found
and decided in two steps, both inside tasks, which return spanning forests instead of pairs:

1. In each bucket the members that agree in at least `AGREEING` of all samples are joined (at similarity 0.8 four pairs in
   a million agree in fewer). The components of these links are the groups within which classes lie.
2. The texts of a group are brought together once. Any two of them that agree so far and are not in one class yet are compared
   exactly.

A bucket or group that is too large for a task is dealt into salted parts. Parts of a bucket meet pairwise. Parts of a group
are first decided each by itself, together with the group's leaders, so that what is alike is in one class already;
then the members outside the group's largest class meet all others, part by part. No pair of different classes is left out.

Defined results: null and empty texts and texts of white space stay alone, as their own class; the class of a document
is the smallest doc_id in it (nulls aside); repeated rows and copies share a class; one row comes out per row that goes in.
Rows with equal doc_id and different texts are different documents. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from kindred.llm.common import in_batches, mixed, slices, word_hashes, words
from kindred.llm.components import components
from kindred.runtime import stored

WIDTH = 5
SIMILARITY = 0.8
# Texts with similarity 0.8 share a band with probability 1 - (1 - 0.8 ** 4) ** 16 = 0.9998; texts that share a third of
# their shingles, as through a common passage, meet in one band of 80 only.
ROWS = 4
BANDS = 16
SAMPLES = ROWS * BANDS
# Of all samples of a pair so many must agree before its shingles are compared.
AGREEING = 36
# Shingles that are sampled together, and bytes of texts that are signed together.
RUN_SHINGLES = 1 << 14
SIGNED_BYTES = 1_000_000
# Members of a bucket, and members and words of a group, that are compared in one task.
BUCKET_MEMBERS = 8192
GROUP_MEMBERS = 4096
GROUP_WORDS = 1 << 21
# Members that every part of a large group is compared with, and keys of texts that a task knows it has sent.
LEADERS = 16
KNOWN_KEYS = 1 << 17
# Frequencies are counted in so many buckets, sent in blocks of this size, and told apart down to this share of all documents.
IDF_BITS = 20
IDF_BUCKETS = 1 << IDF_BITS
IDF_BLOCK = 1 << 14
RAREST = 1000


def text_keys(offsets: np.ndarray, codes: np.ndarray, distinct: pa.Array) -> list[bytes | None]:
    """128-bit digest of each text's words in order; None without words."""
    raw = np.array(distinct.to_pylist(), dtype=object)
    return [
        hashlib.blake2b(" ".join(raw[codes[a:b]]).encode(), digest_size=16).digest() if b > a else None
        for a, b in zip(offsets[:-1], offsets[1:])
    ]


def shingles(offsets: np.ndarray, codes: np.ndarray, distinct: pa.Array):
    """Sorted distinct shingle hashes of each text, and how often each occurs."""
    hashes = word_hashes(distinct)[codes]
    count = max(len(hashes) - WIDTH + 1, 0)
    window = np.zeros(count, np.uint64)
    for step in range(WIDTH):
        window = window * np.uint64(0x9E3779B97F4A7C15) + hashes[step : step + count]
    window = mixed(window)
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= WIDTH:
            yield np.unique(window[a : b - WIDTH + 1], return_counts=True)
        elif b > a:
            short = np.uint64(b - a)
            for value in hashes[a:b]:
                short = mixed(np.array([short ^ value]))[0]
            yield np.array([short]), np.ones(1, np.int64)
        else:
            yield np.zeros(0, np.uint64), np.zeros(0, np.int64)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - IDF_BITS)).astype(np.int64)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Weight of each shingle bucket: 1 + log(N / df) / log(RAREST), with N / df between 1 and RAREST."""
    blocks = IDF_BUCKETS // IDF_BLOCK

    def count(batches):
        frequency, texts = np.zeros(IDF_BUCKETS, np.int64), 0
        for batch in batches:
            for part in slices(batch):
                for held, _ in shingles(*words(part.column("text"))):
                    frequency[np.unique(_bucket(held))] += 1
                texts += part.num_rows
        raw = [frequency[at : at + IDF_BLOCK].tobytes() for at in range(0, IDF_BUCKETS, IDF_BLOCK)]
        columns = [pa.array(range(blocks), pa.int32()), pa.array([texts] * blocks), pa.array(raw, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["block", "texts", "counts"])

    def add(batches):
        totals: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                texts, counts = totals.get(row["block"], (0, 0))
                totals[row["block"]] = (texts + row["texts"], counts + np.frombuffer(row["counts"], np.int64))
        rows = [(block, texts, counts.tobytes()) for block, (texts, counts) in totals.items()]
        columns = [pa.array([r[at] for r in rows], t) for at, t in enumerate((pa.int32(), pa.int64(), pa.binary()))]
        yield pa.RecordBatch.from_arrays(columns, ["block", "texts", "counts"])

    shape = "block int, texts long, counts binary"
    found = in_batches(docs.select("text"), count, shape).repartition(blocks, "block").mapInArrow(add, shape)
    frequency, texts = np.zeros(IDF_BUCKETS, np.int64), 1
    for row in found.toArrow().to_pylist():  # IDF_BUCKETS numbers
        frequency[row["block"] * IDF_BLOCK : (row["block"] + 1) * IDF_BLOCK] = np.frombuffer(row["counts"], np.int64)
        texts = max(texts, row["texts"])
    return 1 + np.log(np.clip(texts / np.maximum(frequency, 1), 1, RAREST)) / np.log(RAREST)


def _gamma_quantiles() -> np.ndarray:
    """65,536 even quantiles of the Gamma(2, 1) distribution, whose distribution function is 1 - (1 + x) exp(-x)."""
    x = np.concatenate([np.geomspace(1e-6, 1e-2, 20_000), np.linspace(1e-2, 40, 400_000)])
    return np.interp((np.arange(65_536) + 0.5) / 65_536, 1 - (1 + x) * np.exp(-x), x)


def samples(hashes: np.ndarray, log_weights: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """Sample identities (texts x count) of texts whose shingles lie between offsets; none may be empty."""
    gamma = _gamma_quantiles()
    tables = gamma.astype(np.float32), np.log(gamma).astype(np.float32)
    log_weights = log_weights.astype(np.float32)
    out = np.zeros((len(offsets) - 1, count), np.uint64)
    # Runs of texts that the processor's caches hold.
    run = offsets[:-1] // RUN_SHINGLES
    edges = np.flatnonzero(np.r_[True, run[1:] != run[:-1], True])
    for first, last in zip(edges[:-1], edges[1:]):
        part = slice(offsets[first], offsets[last])
        own = offsets[first : last + 1] - offsets[first]
        out[first:last] = _samples_of_run(hashes[part], log_weights[part], own, count, *tables)
    return out


def _samples_of_run(
    hashes: np.ndarray, log_weights: np.ndarray, offsets: np.ndarray, count: int, gamma: np.ndarray, log_gamma: np.ndarray
) -> np.ndarray:
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), count), np.uint64)
    for sample in range(count):
        # Three independent draws of each shingle, the same in every text that holds it.
        draw = mixed(hashes ^ mixed(np.array([sample + 1]))[0]).view(np.int64)
        r, log_c = np.take(gamma, draw & 0xFFFF, mode="clip"), np.take(log_gamma, (draw >> 16) & 0xFFFF, mode="clip")
        beta = ((draw >> 32) & 0xFFFF).astype(np.float32) * np.float32(1 / 65_536)
        t = np.floor(log_weights / r + beta)
        log_a = log_c - r * (t - beta + 1)
        least = np.minimum.reduceat(log_a, offsets[:-1])
        hits = np.flatnonzero(log_a == np.repeat(least, sizes))
        first = hits[np.searchsorted(hits, offsets[:-1])]
        out[:, sample] = mixed(hashes[first] ^ mixed(t[first].astype(np.int64).astype(np.uint64)))
    return out


def _band_keys(drawn: np.ndarray) -> np.ndarray:
    """One 64-bit value for each band of a text."""
    keys = np.zeros((len(drawn), BANDS), np.uint64)
    for band in range(BANDS):
        value = mixed(np.full(len(drawn), band + 1))
        for row in range(ROWS):
            value = mixed(value ^ drawn[:, band * ROWS + row])
        keys[:, band] = value
    return keys


def signed(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, key (digest of the words, null without words), words (their number), band values and samples (a byte each)."""
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, size=SIGNED_BYTES):
                coded = words(part.column("text"))
                found = list(shingles(*coded))
                spoken = [i for i, (held, _) in enumerate(found) if len(held)]
                bands, drawn = [None] * part.num_rows, [None] * part.num_rows
                if spoken:
                    hashes = np.concatenate([found[i][0] for i in spoken])
                    weights = np.concatenate([found[i][1] for i in spoken]) * idf[_bucket(hashes)]
                    offsets = np.concatenate([[0], np.cumsum([len(found[i][0]) for i in spoken])])
                    own = samples(hashes, np.log(weights), offsets, SAMPLES)
                    keys, short = _band_keys(own).astype(np.int64), own.astype(np.uint8)
                    for at, i in enumerate(spoken):
                        bands[i], drawn[i] = keys[at].tolist(), short[at].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(text_keys(*coded), pa.binary()),
                        pa.array(np.diff(coded[0])),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array(drawn, pa.binary()),
                    ],
                    ["doc_id", "key", "words", "bands", "samples"],
                )

    schema = f"doc_id {ids}, key binary, words long, bands array<long>, samples binary"
    return in_batches(docs.select("doc_id", "text"), run, schema)


def with_key(docs: DataFrame, name: str = "_kd_key") -> DataFrame:
    """docs with the digest of their words beside their own columns."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                key = pa.array(text_keys(*words(part.column("text"))), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, key], [*part.schema.names, name])

    return in_batches(docs, run, StructType([*docs.schema.fields, StructField(name, BinaryType())]))


def texts_by_key(docs: DataFrame) -> DataFrame:
    """key and text of documents with words. A task sends a text it has sent before seldom again."""

    def run(batches):
        sent: set[bytes] = set()
        for batch in batches:
            for part in slices(batch):
                keys = text_keys(*words(part.column("text")))
                fresh = []
                for key in keys:
                    fresh.append(key is not None and key not in sent)
                    if len(sent) >= KNOWN_KEYS:
                        sent.clear()
                    if key is not None:
                        sent.add(key)
                out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), part.column("text")], ["key", "text"])
                yield out.filter(pa.array(fresh, pa.bool_()))

    return in_batches(docs.select("text"), run, "key binary, text string")


def weighted_jaccard(a, times_a, b, times_b, idf: np.ndarray) -> float:
    """Sum of the smaller weights over the sum of the larger ones; shingles in ascending order."""
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    same = np.flatnonzero(b[at] == a)
    shared = (np.minimum(times_a[same], times_b[at[same]]) * idf[_bucket(a[same])]).sum()
    total = (times_a * idf[_bucket(a)]).sum() + (times_b * idf[_bucket(b)]).sum()
    return float(shared / (total - shared))


Links = list[tuple[int, int]]


def in_cells(rows: DataFrame, cell: list[str], columns: list[str], links_of: Callable[..., Links]) -> DataFrame:
    """Links (a, b) that links_of finds in each cell of rows, brought together by the cell's columns; keys are in `key`.

    links_of gets the cell's columns as lists and returns pairs of places.
    """
    dealt = rows.select(*cell, "key", *columns).repartition(*cell).sortWithinPartitions(*cell)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(held: list[list]) -> pa.RecordBatch:
            keys = held[0]
            pairs = [sorted((keys[i], keys[j])) for i, j in links_of(*held[1:])] if len(keys) > 1 else []
            ends = [pa.array([p[at] for p in pairs], pa.binary()) for at in (0, 1)]
            return pa.RecordBatch.from_arrays(ends, ["a", "b"])

        current, held = None, []
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in cell)))
            values = [batch.column(c).to_pylist() for c in ("key", *columns)]
            edges = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
            for start, end in zip(edges, [*edges[1:], len(names)]):
                part = [column[start:end] for column in values]
                if names[start] == current:
                    held = [old + new for old, new in zip(held, part)]
                else:
                    if held:
                        yield found(held)
                    current, held = names[start], part
        if held:
            yield found(held)

    return in_batches(dealt, run, "a binary, b binary").distinct()


def joined_by(label: np.ndarray, asking: np.ndarray, drawn: np.ndarray, same: Callable[[int, int], bool]) -> Links:
    """Pairs that join the labels of members which agree in AGREEING samples and are the same; label is changed.

    Each asking member meets all members of other labels, those that agree most first; pairs whose labels have been joined
    in between are not looked at.
    """
    found: Links = []
    for i in np.flatnonzero(asking):
        others = np.flatnonzero(label != label[i])
        if not len(others):
            if (label == label[0]).all():
                break
            continue
        agree = np.count_nonzero(drawn[others] == drawn[i], axis=1)
        likely = np.flatnonzero(agree >= AGREEING)
        for j in others[likely[np.argsort(-agree[likely], kind="stable")]]:
            if label[j] != label[i] and same(i, j):
                found.append((int(i), int(j)))
                label[label == label[j]] = label[i]
    return found


def _drawn(samples_of: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(samples_of), np.uint8).reshape(-1, SAMPLES)


def likely_links(samples_of: list[bytes]) -> Links:
    """Links of a bucket's members that agree in enough samples, without rings."""
    drawn = _drawn(samples_of)
    return joined_by(np.arange(len(drawn)), np.ones(len(drawn), bool), drawn, lambda i, j: True)


def candidate_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) of texts that share a bucket and agree in enough samples. nodes: key, bands, samples."""
    entries = nodes.select("key", F.explode("bands").alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n"))
    shared = stored(sizes.filter("n > 1"), "buckets")
    met = entries.join(shared, "bucket")
    parts = F.ceil(F.col("n") / F.lit(BUCKET_MEMBERS)).cast("int")
    dealt = _in_pairs(met.withColumn("at", F.pmod(F.xxhash64("key"), parts).cast("int")), parts)
    rows = dealt.join(nodes.select("key", "samples").hint("merge"), "key")
    return in_cells(rows, ["bucket", "i", "j"], ["samples"], likely_links)


def _in_pairs(rows: DataFrame, parts: Column) -> DataFrame:
    """Rows of part `at` in every pair (i, j) of parts, i <= j, that it belongs to."""
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return other.withColumns({"i": F.least("at", "other"), "j": F.greatest("at", "other")}).drop("at", "other")


def exact_links(idf: np.ndarray, least: float) -> Callable[..., Links]:
    """A function of a cell's samples, labels, asking members and texts: links of texts that are similar enough."""

    def links_of(samples_of: list[bytes], labels: list[bytes], asking: list[bool], texts: list[str]) -> Links:
        label = np.unique(np.array(labels, dtype=object), return_inverse=True)[1]
        if (label == label[0]).all():
            return []
        sets = list(shingles(*words(pa.array(texts, pa.string()))))

        def same(i: int, j: int) -> bool:
            return weighted_jaccard(*sets[i], *sets[j], idf) >= least - 1e-9

        return joined_by(label, np.array(asking), _drawn(samples_of), same)

    return links_of


def verified_links(nodes: DataFrame, docs: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """Links (a, b) that join all texts of similarity `least`; nodes: key, words, bands, samples of different texts."""
    group = components(candidate_links(nodes)).withColumnsRenamed({"node": "key", "label": "group"})
    known = stored(group.join(nodes.select("key", "words", "samples"), "key"), "grouped")
    # Merged at every size: what is known is in proportion to the documents.
    texts = texts_by_key(docs).join(known.select("key").hint("merge"), "key", "left_semi")
    texts = texts.groupBy("key").agg(F.first("text").alias("text"))
    sizes = known.groupBy("group").agg(F.count("*").alias("n"), F.sum("words").alias("words"))
    parts = F.greatest(F.ceil(F.col("n") / F.lit(GROUP_MEMBERS)), F.ceil(F.col("words") / F.lit(GROUP_WORDS))).cast("int")
    sizes = stored(sizes.select("group", parts.alias("parts")), "sizes")
    members = stored(known.drop("words").join(sizes, "group").join(texts.hint("merge"), "key"), "members")

    # Each part by itself. The leaders, the same in all parts of a group, are the members with the smallest hashes.
    salt = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    order = Window.partitionBy("group").orderBy(F.xxhash64("key", F.lit(1)), "key")
    large = members.filter("parts > 1")
    lead = large.select("group", "key").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= LEADERS)
    leaders = large.join(lead.select("group", "key"), ["group", "key"])
    every = leaders.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter(F.col("i") != salt)
    alone = members.withColumn("i", salt).unionByName(every).withColumns({"label": F.col("key"), "asking": F.lit(True)})
    columns, decide = ["samples", "label", "asking", "text"], exact_links(idf, least)
    found = stored(in_cells(alone, ["group", "i"], columns, decide), "links")
    if large.isEmpty():
        return found

    # Members outside the largest class of their group meet all others.
    labelled = stored(_relabelled(large, components(found)), "labelled")
    classes_of = stored(labelled.groupBy("group", "label").agg(F.count("*").alias("n")), "counts")
    largest = classes_of.groupBy("group").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"))
    open_groups = largest.withColumn("left", F.col("n") - F.col("most.n")).filter("left > 0")
    asked = F.ceil(F.col("left") / F.lit(GROUP_MEMBERS)).cast("int")
    open_groups = stored(open_groups.select("group", F.col("most.label").alias("main"), asked.alias("askers")), "open")
    rows = stored(labelled.join(open_groups, "group").withColumn("asking", F.col("label") != F.col("main")), "rows")
    asker = F.pmod(F.xxhash64("key"), F.col("askers")).cast("int")
    asking = rows.filter("asking").withColumns({"i": asker, "j": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))})
    others = rows.withColumns({"j": salt, "i": F.explode(F.sequence(F.lit(0), F.col("askers") - 1))})
    others = others.withColumn("asking", F.lit(False))
    met = asking.unionByName(others, allowMissingColumns=True)
    return stored(found.union(in_cells(met, ["group", "i", "j"], columns, decide)), "links")


def _id_text(column: str = "doc_id"):
    """The id as text, with null as the empty text, so that rows without an id meet too."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def classes(docs: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, key, class_id) and keepers (doc_id, key), one for each class of texts with words."""
    docs = docs.select("doc_id", "text")
    idf = inverse_frequencies(docs)
    table = stored(signed(docs, idf), "signed")
    spoken = table.filter(F.col("key").isNotNull())
    # Copies have equal samples.
    nodes = spoken.groupBy("key").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("words", "bands", "samples")])
    nodes = stored(nodes, "nodes")
    label = components(verified_links(nodes, docs, idf, least))
    named = stored(_relabelled(nodes.select("key", "doc_id"), label), "labelled")
    smallest = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("m"))
    keepers = stored(smallest.select("label", "m.doc_id", "m.key"), "keepers")
    of_key = stored(
        named.select("key", "label").join(keepers.select("label", F.col("doc_id").alias("class_id")), "label"), "classes"
    )
    judged = (
        table.filter(F.col("key").isNull())
        .select("doc_id", "key", F.col("doc_id").alias("class_id"))
        .unionByName(spoken.select("doc_id", "key").join(of_key.select("key", "class_id"), "key"))
    )
    return judged, keepers.select("doc_id", "key")


def _relabelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """rows (with key) and their component; texts without a link are their own."""
    named = rows.join(label.select(F.col("node").alias("key"), "label"), "key", "left")
    return named.withColumn("label", F.coalesce("label", "key"))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id of every document."""
    return classes(docs, least)[0].select("doc_id", "class_id")


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class: the one with the smallest doc_id. Texts without words all stay."""
    _, keepers = classes(docs, least)
    keyed = with_key(docs).withColumn("_kd_id", _id_text())
    chosen = keepers.select(_id_text().alias("_kd_id"), F.col("key").alias("_kd_key"))
    kept = keyed.filter(F.col("_kd_key").isNotNull()).join(chosen, ["_kd_id", "_kd_key"], "left_semi")
    # Rows repeated whole have one keeper between them; they lie together after the join.
    once = kept.dropDuplicates(["_kd_id", "_kd_key"])
    return keyed.filter(F.col("_kd_key").isNull()).unionByName(once).select(*docs.columns)
