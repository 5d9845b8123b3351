"""Near-duplicates by SimHash: fingerprints meet at the anchors of a covering code and are compared there.

A fingerprint has a bit for each of the 64 bits of a hash: it is set if it is set in more than half of the text's shingle
hashes. Fingerprints that differ in at most `DISTANCE` bits are linked; classes are the connected components.

Two fingerprints with three differing bits or fewer have a half (32 bits) in which they differ in at most `NEAR` = 1 bit.
The anchors of a half are the words of a covering code: the [31, 26] Hamming code on its lower 31 bits, each with either
value of the top bit. Its covering radius is 1, so every half has exactly one anchor within 1 bit, its home. A half
that differs from it in one bit lies within radius plus threshold, 2 bits, of that anchor. So each fingerprint is
replicated to all anchors within 2 bits of its halves (17 or 2 for each), and at an anchor those that are at home there are
compared with all of them: no pair is missed, and of random fingerprints few meet.

Equal fingerprints are one node. An anchor with more than `BLOCK` fingerprints is worked through in blocks, each home block
against each block, in tasks of their own. Tasks return a spanning forest of the links they found, not the links, so a group
of near copies makes rows in proportion to its members.

Defined results: null and empty texts and texts without a word have the fingerprint zero, which links like any other; the
component is named by the smallest doc_id in it (nulls aside; null if all are null); repeated rows come out as often as they
go in; rows with equal doc_id and different texts are different documents. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.components import components
from kindred.runtime import stored

WIDTH = 3
SEED = 42
DISTANCE = 3
HALVES, HALF_BITS = 2, 32
# Bits in which the closer half of a linked pair may differ.
NEAR = DISTANCE // HALVES
CODE_BITS = HALF_BITS - 1
RADIUS = 1
# Fingerprints of an anchor that are compared side by side, and pairs that are looked at at once.
BLOCK = 4096
PAIRS = 1 << 22
# Links a task holds before it hands them on.
HELD_LINKS = 1 << 20
# Bytes of a text that are split into words at once.
TEXT_BYTES = 1 << 22
SPACE = re.compile(rb"[\x20\x09-\x0d]")


def word_runs(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a text in runs of about TEXT_BYTES; each run starts with the last WIDTH - 1 words so far."""
    start, carried = 0, []
    while start < len(raw):
        space = SPACE.search(raw, start + TEXT_BYTES)
        end = space.start() if space else len(raw)
        run = carried + raw[start:end].split()
        yield run
        carried, start = run[-(WIDTH - 1) :], end


def shingle_hashes(run: list[bytes]) -> list[int]:
    """XXH64 of every WIDTH words in a row, joined by spaces."""
    joined = b" ".join(run)
    ends = np.cumsum(np.fromiter(map(len, run), np.int64, len(run)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(run) - WIDTH + 1]
    return [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[WIDTH - 1 :].tolist())]


def bit_counts(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit set, the lowest bit first."""
    raw = np.array(hashes, np.uint64).astype("<u8").view(np.uint8)
    bits = np.unpackbits(raw.reshape(-1, 8), axis=1, bitorder="little")
    # Sums of up to 255 rows fit a byte, which is added up many at a time.
    whole = len(bits) // 255 * 255
    parts = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return parts + bits[whole:].sum(axis=0, dtype=np.uint8)


def fingerprint(text: str | None) -> int:
    """The fingerprint of a text as an unsigned number."""
    raw = (text or "").encode("utf-8").lower()  # of bytes: A to Z only
    counts, total, run = np.zeros(64, np.int64), 0, []
    for run in word_runs(raw):
        if len(run) >= WIDTH:
            hashes = shingle_hashes(run)
            counts += bit_counts(hashes)
            total += len(hashes)
    if run and not total:  # fewer words than a shingle has
        counts, total = bit_counts([xxhash.xxh64_intdigest(b" ".join(run), SEED)]), 1
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0]) if total else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed number) of every document."""
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(text.as_py()) for text in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, fp long")


def _syndromes(values: np.ndarray) -> np.ndarray:
    """The sum, without carries, of the places (1 to 31) of the set bits: zero for a word of the code."""
    found = np.zeros(len(values), np.uint32)
    for place in range(1, CODE_BITS + 1):
        found ^= ((values >> np.uint32(place - 1)) & np.uint32(1)) * np.uint32(place)
    return found


def anchors(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every (row, anchor, home) with the anchor within RADIUS + NEAR bits of the row's half."""
    top = halves & np.uint32(1 << CODE_BITS)
    low = halves ^ top
    wrong = _syndromes(low)
    rows = np.arange(len(halves))
    # A word with the syndrome s is one bit from a code word (place s), and two bits from those at places i and i ^ s.
    home = np.where(wrong > 0, low ^ (np.uint32(1) << (np.maximum(wrong, 1) - np.uint32(1))), low)
    found = [(rows, home | top, True), (rows, home | (top ^ np.uint32(1 << CODE_BITS)), False)]
    for place in range(1, CODE_BITS + 1):
        other = wrong ^ np.uint32(place)
        pair = np.flatnonzero((wrong > 0) & (other > place))
        flipped = np.uint32(1 << (place - 1)) | (np.uint32(1) << (other[pair] - np.uint32(1)))
        found.append((rows[pair], (low[pair] ^ flipped) | top[pair], False))
    return (
        np.concatenate([r for r, _, _ in found]),
        np.concatenate([a for _, a, _ in found]),
        np.concatenate([np.full(len(r), at_home) for r, _, at_home in found]),
    )


def replicated(prints: DataFrame) -> DataFrame:
    """anchor (half and code word), fp and home of every fingerprint at every anchor it is sent to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy(zero_copy_only=False)
            for half in range(HALVES):
                part = (values.view(np.uint64) >> np.uint64(HALF_BITS * half)).astype(np.uint32)
                rows, found, home = anchors(part)
                numbers = found.astype(np.int64) | (half << HALF_BITS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers), pa.array(values[rows]), pa.array(home)], ["anchor", "fp", "home"]
                )

    return prints.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same connected components: each node but the smallest of its component with the smallest."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, x, label[y])
        np.minimum.at(low, y, label[x])
        np.minimum.at(low, label, low.copy())
        while (low[low] != low).any():
            low = low[low]
        if (low == label).all():
            break
        label = low
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _linked(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = (np.bitwise_count(left.view(np.uint64) ^ right.view(np.uint64)) <= DISTANCE) & (left != right)
    return left[near], right[near]


def links_of_groups(group: np.ndarray, fp: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between the rows at home and all rows of each group; rows of a group stand together."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    homes = np.flatnonzero(home)
    mine = np.searchsorted(starts, homes, side="right") - 1
    # Each row at home meets a run of rows, its group; runs are unrolled PAIRS at a time.
    running = np.cumsum(sizes[mine])
    first = 0
    while first < len(homes):
        before = running[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(running, before + PAIRS, side="right")))
        some, width = mine[first:last], sizes[mine[first:last]]
        place = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        yield _linked(np.repeat(fp[homes[first:last]], width), fp[np.repeat(starts[some], width) + place])
        first = last


class Links:
    """Links found by a task, kept as a forest and handed on when there are many."""

    def __init__(self) -> None:
        self.a, self.b = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.a, self.b = forest(np.concatenate([self.a, a]), np.concatenate([self.b, b]))

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(self.a), pa.array(self.b)], ["a", "b"])
        self.__init__()
        return out


def compared(cells: DataFrame) -> DataFrame:
    """Links (a, b) found in cells (anchor, i, j, fp, home) whose rows lie together, sorted by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rest = Links(), None
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "i", "j", "fp", "home")]
            if rest is not None:
                columns = [np.concatenate([old, new]) for old, new in zip(rest, columns)]
            if not len(columns[0]):
                continue
            anchor, i, j, fp, home = columns
            changes = np.r_[True, (anchor[1:] != anchor[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
            # The last cell may go on in the next batch.
            last = int(np.flatnonzero(changes)[-1])
            rest = [c[last:] for c in columns]
            cell = np.cumsum(changes)
            for a, b in links_of_groups(cell[:last], fp[:last], home[:last]) if last else ():
                found.add(a, b)
            if len(found.a) > HELD_LINKS:
                yield found.batch()
        if rest is not None:
            for a, b in links_of_groups(np.zeros(len(rest[0])), rest[3], rest[4]):
                found.add(a, b)
        yield found.batch()

    return cells.mapInArrow(run, "a long, b long")


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that join all fingerprints (fp, distinct) within DISTANCE bits of each other, as forests."""
    sent = stored(replicated(prints), "anchors")
    sizes = sent.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if("home").alias("homes"))
    shared = stored(sizes.filter("n > 1 AND homes > 0").select("anchor", "n"), "shared")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK))
    met = sent.join(shared, "anchor").withColumn("at", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
    every = F.sequence(F.lit(0), (blocks - 1).cast("int"))
    # A block at home (i) meets every block (j). A row at home is in its own block as well.
    at_home = met.filter("home").select("anchor", F.col("at").alias("i"), F.explode(every).alias("j"), "fp", "home")
    away = met.select("anchor", F.explode(every).alias("i"), F.col("at").alias("j"), "fp", F.lit(False).alias("home"))
    cells = at_home.unionByName(away).repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    return compared(cells).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    table = stored(fingerprints(docs), "fingerprints")
    smallest = stored(table.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct")
    label = components(links(smallest))
    named = smallest.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = stored(named, "labelled")
    of_label = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_print = stored(named.select("fp", "label").join(of_label, "label").select("fp", "component_id"), "classes")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return table.join(of_print, "fp").select("doc_id", digits, "component_id")
