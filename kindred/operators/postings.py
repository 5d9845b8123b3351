"""An inverted index of channel lists: for each block of items the ids that have a channel, and searches that read only those.

A row of the index is a block of up to about BLOCK_ITEMS items of one group. It holds the ids in ascending order and the
postings of all channels, in BANDS columns of neighbouring channels: for each channel the places, in that order, of the items
that list it. A search reads the columns of its queries' channels and no others, wherever the rows lie; nothing is shuffled but
results. In a task the count that a query's n-th best item has is a bound for the rest: with T shared channels to reach and
m lists in a block, an item must stand in one of the m - T + 1 shortest, so only those are read for candidates, and none
if the block has fewer than T lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.operators.blocks import plain
from kindred.operators.skew import sent_if_small
from kindred.runtime import stored

# Places in a block are 16-bit numbers.
BLOCK_ITEMS = 1 << 14
MOST_PLACES = 1 << 16
BANDS = 32


@dataclass(frozen=True)
class ChannelIndex:
    """The stored blocks (group, block, ids and one column of postings for each band) and the channels of a band."""

    blocks: DataFrame
    width: int

    def bands_of(self, channels: np.ndarray) -> list[str]:
        """Columns that hold the postings of the channels."""
        bands = np.unique(channels[channels >= 0] // self.width)
        return [band_name(b) for b in bands.tolist() if b < BANDS]


def band_name(band: int) -> str:
    return f"band_{band:02d}"


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of every list entry."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def postings(rows: np.ndarray, channels: np.ndarray, width: int, band: int) -> bytes:
    """Postings of a band's channels: width + 1 starts as 32-bit numbers, then the places as 16-bit numbers."""
    own = (channels >= band * width) & (channels < (band + 1) * width)
    # A channel that an item lists twice counts once.
    pairs = np.unique((channels[own] - band * width) * MOST_PLACES + rows[own])
    starts = np.searchsorted(pairs, np.arange(width + 1) * MOST_PLACES).astype(np.uint32)
    return starts.tobytes() + (pairs % MOST_PLACES).astype(np.uint16).tobytes()


def places(raw: memoryview, width: int, channel: int) -> np.ndarray:
    """Places of the items that list a channel (its number within the band)."""
    starts = np.frombuffer(raw, np.uint32, width + 1)
    head = 4 * (width + 1)
    return np.frombuffer(raw, np.uint16, int(starts[channel + 1] - starts[channel]), head + 2 * int(starts[channel]))


def channel_index(items: DataFrame) -> ChannelIndex:
    """Index of items (group, id, payload: a list of channels from 0 on). Items are shuffled once, for the blocks."""
    ids = items.schema["id"].dataType
    known = items.agg(F.max(F.array_max("payload")).alias("most")).first()["most"]
    width = (0 if known is None else known) // BANDS + 1
    # Hashed blocks differ in size, so they are made half as large as they may be.
    sizes = items.groupBy("group").agg(F.ceil(F.count("*") / F.lit(BLOCK_ITEMS)).alias("_blocks"))
    sizes = stored(sizes, "groups")
    sized = items.join(sent_if_small(sizes, sizes.count()), "group")
    placed = sized.withColumn("block", F.pmod(F.xxhash64("id", "payload"), F.col("_blocks")).cast("int"))
    schema = T.StructType(
        [items.schema["group"], T.StructField("block", T.IntegerType()), T.StructField("ids", T.ArrayType(ids))]
        + [T.StructField(band_name(b), T.BinaryType()) for b in range(BANDS)]
    )

    def block_of(table: pa.Table) -> pa.Table:
        if table.num_rows > MOST_PLACES:
            raise ValueError(f"{table.num_rows} items with equal ids and channels")
        table = table.sort_by("id")
        rows, channels = _flat(table["payload"].combine_chunks())
        columns = [table["group"].slice(0, 1), table["block"].slice(0, 1), pa.array([table["id"].to_pylist()])]
        columns += [pa.array([postings(rows, channels, width, b)], pa.binary()) for b in range(BANDS)]
        return pa.table(dict(zip(schema.fieldNames(), columns)))

    made = placed.select("group", "block", "id", "payload").groupBy("group", "block").applyInArrow(block_of, schema)
    return ChannelIndex(stored(made, "postings"), width)


class Best:
    """Running n best items of each query: most shared channels first, then the smaller id."""

    def __init__(self, n: int):
        self.n = n
        self.held: dict = {}

    def floor(self, query) -> int:
        """Shared channels an item must have to matter."""
        counts = self.held[query][0] if query in self.held else ()
        return int(counts[-1]) if len(counts) == self.n else 1

    def add(self, query, counts: np.ndarray, ids: np.ndarray) -> None:
        if query in self.held:
            counts, ids = (np.concatenate(pair) for pair in zip(self.held[query], (counts, ids)))
        order = np.lexsort((ids, -counts))[: self.n]
        self.held[query] = counts[order], ids[order]


def shared_at_least(lists: list[np.ndarray], size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that stand in at least `least` of the lists of places (each ascending), and in how many."""
    lists = sorted((places for places in lists if len(places)), key=len)
    if len(lists) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lead, rest = lists[: len(lists) - least + 1], lists[len(lists) - least + 1 :]
    counts = np.bincount(np.concatenate(lead), minlength=size)
    found = np.flatnonzero(counts)
    if len(found) * 4 < sum(map(len, rest)):
        # Few candidates are looked up in the long lists.
        total = counts[found]
        for places_of_channel in rest:
            at = np.minimum(np.searchsorted(places_of_channel, found), len(places_of_channel) - 1)
            total = total + (places_of_channel[at] == found)
    else:
        total = (counts + np.bincount(np.concatenate(rest), minlength=size) if rest else counts)[found]
    kept = total >= least
    return found[kept], total[kept]


def shared_channels(index: ChannelIndex, blocks: DataFrame, queries: dict, n: int, schema: T.StructType, arrow: pa.Schema) -> DataFrame:
    """The n items of each task that share most channels with each query, at least one: group, query, id, score.

    blocks: rows of the index to search. queries: by group the ids and channel lists.
    """
    width = index.width
    asked = {
        group: [(number, np.unique(channels[channels >= 0])) for number, channels in zip(ids.tolist(), lists)]
        for group, (ids, lists) in queries.items()
    }
    every = np.unique(np.concatenate([channels for some in asked.values() for _, channels in some] or [np.zeros(0, np.int64)]))
    bands = index.bands_of(every)
    sent = blocks.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, asked = Best(n), sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                group = batch.column("group")[row].as_py()
                ids = plain(batch.column("ids")[row].values)
                held = {band: batch.column(band)[row].as_buffer() for band in bands}
                for query, channels in asked.get(group, ()):
                    lists = [
                        places(held[band_name(c // width)], width, c % width) for c in channels.tolist() if c // width < BANDS
                    ]
                    found, counts = shared_at_least(lists, len(ids), best.floor((group, query)))
                    other = ids[found] != query
                    if other.any():
                        best.add((group, query), counts[other], ids[found][other])
        columns = [[], [], [], []]
        for (group, query), (counts, ids) in best.held.items():
            for column, values in zip(columns, ([group] * len(ids), [query] * len(ids), ids.tolist(), counts.tolist())):
                column += values
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)

    return blocks.select("group", "ids", *bands).mapInArrow(run, schema)
