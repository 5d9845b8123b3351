"""Hard negatives of anchors: exact integer scores by table lookups on packed bit planes, positives first, then negatives.

Components become whole numbers, floor(256 * x). A row is stored as its bit planes: for each bit of the two's complement
of its components one bit per dimension, eight dimensions to a byte. For each anchor and group of eight dimensions a table holds the sums of
all 256 subsets of the anchor's eight components. A byte of a plane is then the number of the subset that has this bit
set, so a score is a shift-add over planes of looked-up sums: no multiplication, and the exact inner product.

Anchors are a stated query set. They are worked through in rounds, as many as have `TABLE_BYTES` of tables; a round's anchors
are sent to all tasks, and each task scores blocks of its rows against blocks of anchors, keeping the first few of each
anchor. A round reads the rows twice: the first 5 rows of an anchor's own label are its positives, whose scores bound the
negatives of the second reading. Only the first few are shuffled.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part. Shorter vectors
count as filled up with zeros. Rows with equal id that score equally with an anchor count once. Rows with the anchor's own id
are never its positives. Anchors with equal id and different label or vector are anchors of their own. Higher scores come
first, ties by smaller id. An anchor without another row of its label, or without a row within the bounds, returns nothing;
an empty table gives an empty one. Vectors so large that a score could pass 64 bits are an error. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.runtime import fresh_path, stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
# A negative's score lies between these percentages of its positive's.
LOW, HIGH = 30, 90
GROUP = 8
SUBSETS = 1 << GROUP
# Tables of a round's anchors in a task.
TABLE_BYTES = 64 << 20
# Rows and anchors that are scored at once, and scores a task computes in one round.
BLOCK_ROWS = BLOCK_ANCHORS = 512
TASK_SCORES = 1 << 30
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def usable(items: DataFrame) -> DataFrame:
    """id, label and vector (doubles times SCALE) of the rows that take part."""
    value = F.col("vector").cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return items.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite).select(
        F.col("id").cast("long").alias("id"),
        F.col("label").cast("long").alias("label"),
        F.transform(value, lambda x: F.lit(float(SCALE)) * x).alias("vector"),
    )


@dataclass(frozen=True)
class Shape:
    """How a table's vectors are packed: dimensions filled up to whole groups, and bits of the two's complement."""

    width: int
    bits: int

    @property
    def groups(self) -> int:
        return self.width // GROUP

    @property
    def number(self) -> type:
        """The type of tables and scores; running sums stay below width * 2 ** (2 * bits)."""
        return np.int32 if self.width << (2 * self.bits) < 1 << 31 else np.int64

    @property
    def anchors(self) -> int:
        """Anchors of one round."""
        return max(1, TABLE_BYTES // (max(self.groups, 1) * SUBSETS * np.dtype(self.number).itemsize))


def shape_of(width: int, low: float, high: float) -> Shape:
    """The shape for vectors of up to width components that lie, as whole numbers, between low and high."""
    most = max(-low, high + 1, 1)
    if width * most * most >= 2.0**62:
        raise ValueError(f"scores of {width} components as large as {most / SCALE:g} do not fit 64 bits")
    return Shape(-(-max(width, 1) // GROUP) * GROUP, max(2, math.ceil(math.log2(most)) + 1))


def packed(values: np.ndarray, shape: Shape) -> np.ndarray:
    """Bit planes of whole numbers (rows x width) as bytes: rows x bits x groups, the lowest bit first."""
    planes = (values[:, None, :] >> np.arange(shape.bits)[None, :, None]) & 1
    return np.packbits(planes.astype(np.uint8), axis=2, bitorder="little")


def unpacked(planes: np.ndarray) -> np.ndarray:
    """The whole numbers of bit planes."""
    bits = np.unpackbits(planes, axis=2, bitorder="little").astype(np.int64)
    weights = np.int64(1) << np.arange(bits.shape[1], dtype=np.int64)
    weights[-1] = -weights[-1]
    return np.einsum("rbw,b->rw", bits, weights)


def with_planes(items: DataFrame, shape: Shape) -> DataFrame:
    """id, label and planes of usable rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            values = np.zeros((len(sizes), shape.width), np.int64)
            values[rows, place] = np.floor(vectors.flatten().to_numpy(zero_copy_only=False)).astype(np.int64)
            planes = [row.tobytes() for row in packed(values, shape)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(planes, pa.binary())], ["id", "label", "planes"]
            )

    return items.mapInArrow(run, "id long, label long, planes binary")


def planes_of(column: pa.Array, shape: Shape) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(len(column), shape.bits, shape.groups)


def subset_sums(anchors: np.ndarray, shape: Shape) -> np.ndarray:
    """groups x 256 x anchors: for each subset of eight dimensions the sum of the anchor's components in it."""
    parts = anchors.reshape(len(anchors), shape.groups, GROUP).astype(shape.number)
    tables = np.zeros((shape.groups, SUBSETS, len(anchors)), shape.number)
    for place in range(GROUP):
        half = 1 << place
        tables[:, half : 2 * half] = tables[:, :half] + parts[:, :, place].T[:, None, :]
    return tables


def scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Inner products of rows (their planes) and anchors (their tables): rows x anchors."""
    total = np.zeros((len(planes), tables.shape[2]), tables.dtype)
    looked_up = np.empty_like(total)
    for bit in reversed(range(planes.shape[1])):
        total <<= 1
        for group in range(planes.shape[2]):
            np.take(tables[group], planes[:, bit, group], axis=0, out=looked_up, mode="clip")
            total += looked_up
        if bit == planes.shape[1] - 1:  # the sign bit
            np.negative(total, out=total)
    return total


class First:
    """The first k rows of each of some queries: higher scores first, then smaller ids; equal pairs count once."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), LEAST)
        self.id = np.full((queries, k), MOST)
        self.held = np.zeros(queries, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        k = self.score.shape[1]
        touched = np.unique(query)
        old, place = np.nonzero(np.arange(k)[None, :] < self.held[touched][:, None])
        query = np.concatenate([touched[old], query])
        score = np.concatenate([self.score[touched[old], place], score.astype(np.int64)])
        ids = np.concatenate([self.id[touched[old], place], ids])
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        fresh = np.r_[True, (query[1:] != query[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])]
        query, score, ids = query[fresh], score[fresh], ids[fresh]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        query, score, ids, rank = (values[rank < k] for values in (query, score, ids, rank))
        self.score[query, rank], self.id[query, rank] = score, ids
        self.held[touched] = np.bincount(np.searchsorted(touched, query), minlength=len(touched))

    def floor(self) -> np.ndarray:
        """The score a row must reach to matter, for each query."""
        return np.where(self.held == self.score.shape[1], self.score[:, -1], LEAST)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, place = np.nonzero(np.arange(self.score.shape[1])[None, :] < self.held[:, None])
        return query, self.score[query, place], self.id[query, place]


def _clipped(bounds: np.ndarray, number: type) -> np.ndarray:
    info = np.iinfo(number)
    return np.clip(bounds, info.min, info.max).astype(number)


@dataclass(frozen=True)
class Anchors:
    """A round's anchors, sorted by label."""

    id: np.ndarray
    label: np.ndarray
    vector: np.ndarray

    def blocks(self, shape: Shape, by_label: bool) -> list[tuple[slice, np.ndarray]]:
        """Blocks of anchors, of one label each if wanted, with their tables."""
        changes = np.flatnonzero(self.label[1:] != self.label[:-1]) + 1 if by_label else []
        edges = [0, *map(int, changes), len(self.label)]
        cuts = [
            slice(at, min(at + BLOCK_ANCHORS, end))
            for first, end in zip(edges[:-1], edges[1:])
            for at in range(first, end, BLOCK_ANCHORS)
        ]
        return [(cut, subset_sums(self.vector[cut], shape)) for cut in cuts]


def _parts(batch: pa.RecordBatch, shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
    planes = planes_of(batch.column("planes"), shape)
    for at in range(0, len(ids), BLOCK_ROWS):
        part = slice(at, at + BLOCK_ROWS)
        yield ids[part], labels[part], planes[part]


def _positives(items: DataFrame, anchors: Anchors, shape: Shape, count: int) -> DataFrame:
    """anchor (its place), id and score of each anchor's first rows of its own label."""
    sent = items.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = sent.value
        of_label = defaultdict(list)
        for cut, tables in anchors.blocks(shape, by_label=True):
            of_label[anchors.label[cut.start]].append((cut, tables))
        first = First(len(anchors.id), count)
        for batch in batches:
            for ids, labels, planes in _parts(batch, shape):
                for label, (cut, tables) in ((n, b) for n in np.unique(labels) for b in of_label.get(n, ())):
                    own = np.flatnonzero(labels == label)
                    found = scores(planes[own], tables)
                    wanted = found >= _clipped(first.floor()[cut], found.dtype)
                    row, anchor = np.nonzero(wanted & (ids[own][:, None] != anchors.id[cut][None, :]))
                    first.add(anchor + cut.start, found[row, anchor], ids[own][row])
        anchor, score, ids = first.rows()
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(ids), pa.array(score)], ["anchor", "id", "score"])

    return _ranked(items.mapInArrow(run, "anchor long, id long, score long"), ["anchor"], count)


def _ranked(found: DataFrame, query: list[str], count: int) -> DataFrame:
    order = Window.partitionBy(*query).orderBy(F.desc("score"), "id")
    return found.dropDuplicates([*query, "id", "score"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def bounds(positive: np.ndarray, low: int = LOW, high: int = HIGH) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole score with low * positive <= 100 * score <= high * positive, without passing 64 bits."""
    whole, rest = np.divmod(positive, 100)
    return low * whole - (-(low * rest) // 100), high * whole + high * rest // 100


def _negatives(items: DataFrame, anchors: Anchors, pairs: pa.Table, shape: Shape, count: int) -> DataFrame:
    """anchor and place (of the positive), id and score of each pair's first rows of other labels within its bounds."""
    place = pairs["rank"].to_numpy() - 1
    low = np.full((len(anchors.id), int(place.max()) + 1), MOST)  # nothing reaches the bounds of a missing positive
    high = np.full_like(low, LEAST)
    at = (pairs["anchor"].to_numpy(), place)
    low[at], high[at] = bounds(pairs["score"].to_numpy())
    sent = items.sparkSession.sparkContext.broadcast((anchors, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, low, high = sent.value
        blocks, places = anchors.blocks(shape, by_label=False), low.shape[1]
        first = First(low.size, count)
        for batch in batches:
            for ids, labels, planes in _parts(batch, shape):
                for cut, tables in blocks:
                    found = scores(planes, tables)
                    other = labels[:, None] != anchors.label[None, cut]
                    floor = np.maximum(first.floor().reshape(low.shape)[cut], low[cut])
                    for place in range(places):
                        least, most = floor[:, place], high[cut, place]
                        inside = (found >= _clipped(least, found.dtype)) & (found <= _clipped(most, found.dtype))
                        row, anchor = np.nonzero(inside & other & (least <= most))
                        first.add((anchor + cut.start) * places + place, found[row, anchor], ids[row])
        query, score, ids = first.rows()
        yield pa.RecordBatch.from_arrays(
            [pa.array(query // places), pa.array(query % places + 1), pa.array(ids), pa.array(score)],
            ["anchor", "place", "id", "score"],
        )

    return _ranked(items.mapInArrow(run, "anchor long, place long, id long, score long"), ["anchor", "place"], count)


def hard_negatives(items: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for the anchors, the rows whose id is
    divisible by `every`. items: id, label, vector."""
    spark = items.sparkSession
    rows = usable(items)
    is_anchor = F.col("id") % every == 0
    known = rows.agg(
        F.count("*").alias("rows"),
        F.count_if(is_anchor).alias("anchors"),
        F.max(F.size("vector")).alias("width"),
        F.min(F.array_min("vector")).alias("low"),
        F.max(F.array_max("vector")).alias("high"),
    ).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not known["anchors"]:
        return spark.createDataFrame([], schema)
    shape = shape_of(known["width"], known["low"] or 0.0, known["high"] or 0.0)
    tasks = math.ceil(known["rows"] * min(known["anchors"], shape.anchors) / TASK_SCORES)
    spread = with_planes(rows, shape).repartition(max(spark.sparkContext.defaultParallelism, tasks))
    coded = stored(spread, "planes")
    chosen = stored(coded.filter(is_anchor).distinct(), "anchors")

    path = fresh_path(spark, "negatives")
    # Anchors fall into rounds by their hash; three quarters of the bound on the average leave room for uneven rounds.
    rounds = math.ceil(chosen.count() / (0.75 * shape.anchors)) if known["anchors"] > shape.anchors else 1
    for at in range(rounds):
        some = chosen.filter(F.pmod(F.xxhash64("id", "label", "planes"), F.lit(rounds)) == at).orderBy("label", "id", "planes").toArrow()
        if not some.num_rows:
            continue
        vectors = unpacked(planes_of(some["planes"].combine_chunks(), shape))
        anchors = Anchors(some["id"].to_numpy(), some["label"].to_numpy(), vectors)
        pairs = _positives(coded, anchors, shape, positives).toArrow()  # a few rows of each anchor of the round
        if not pairs.num_rows:
            continue
        found = _negatives(coded, anchors, pairs, shape, negatives)
        named = pa.table(
            {
                "anchor": pairs["anchor"],
                "place": pa.array(pairs["rank"].to_numpy().astype(np.int64)),
                "anchor_id": pa.array(anchors.id[pairs["anchor"].to_numpy()]),
                "positive_id": pairs["id"],
                "positive_score": pairs["score"],
            }
        )
        joined = found.join(F.broadcast(spark.createDataFrame(named)), ["anchor", "place"])
        joined.select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ).write.mode("append").parquet(path)
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def from_embeddings(embeddings: DataFrame) -> DataFrame:
    """The hard negatives of embeddings (vec_id, embedding, label), where every seventh row has a wrong label."""
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(
        embeddings.select(F.col("vec_id").alias("id"), noisy.alias("label"), F.col("embedding").alias("vector"))
    )


def sql() -> str:
    return """
        WITH kept AS (
            SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT DISTINCT a.id AS anchor, b.id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
            FROM kept a JOIN kept b ON a.id % 100 = 0
        ), positives AS (
            SELECT anchor, id AS positive, score FROM scored WHERE same AND id <> anchor
            QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5
        ), ranked AS (
            SELECT p.anchor, p.positive, p.score AS positive_score, n.id AS negative, n.score AS negative_score,
                row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY n.score DESC, n.id) AS rank
            FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
                AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
        )
        SELECT anchor AS anchor_id, positive AS positive_id, rank::INTEGER AS rank, negative AS negative_id,
            positive_score, negative_score
        FROM ranked WHERE rank <= 10
    """
