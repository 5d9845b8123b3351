"""Array work inside tasks: score blocks of items against blocks of queries, keep the best few.

Spark partitions the items and moves the results. Each task sees one Arrow batch at a time
and holds only the running best, so its memory does not grow with the partition.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kindred.constants import NORM_FLOOR

# Similarities are compared after rounding: the last bits of a matrix product depend on the block shape,
# and copies of one vector must tie so that the id decides.
COMPARED_DIGITS = 10


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column with rows of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    widths = pc.min_max(column.value_lengths())
    if widths["min"] != widths["max"]:
        raise ValueError(f"vectors of {widths['min']} to {widths['max']} values; filter them to one width")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def plain(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An id or group column as numbers or fixed-width text."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return np.array(column.to_pylist(), dtype=str)
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    return vectors / np.maximum(norms, NORM_FLOOR)[:, None]


def cosine(items: np.ndarray, queries: np.ndarray) -> np.ndarray:
    return np.round(unit_rows(items) @ unit_rows(queries).T, COMPARED_DIGITS)


def bit_agreement(items: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Minus the number of differing bits, so that higher is closer."""
    items, queries = items.astype(np.uint32), queries.astype(np.uint32)
    differing = np.zeros((len(items), len(queries)), np.int32)
    for word in range(items.shape[1]):
        differing += np.bitwise_count(items[:, word, None] ^ queries[None, :, word])
    return -differing.astype(np.float64)


def shared_channels(items: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Number of list entries in common; a pair without any is no candidate."""
    width = int(max(items.max(initial=0), queries.max(initial=0))) + 1

    def marks(lists: np.ndarray) -> np.ndarray:
        present = np.zeros((len(lists), width))
        np.put_along_axis(present, lists.astype(np.int64), 1.0, axis=1)
        return present

    shared = marks(items) @ marks(queries).T
    return np.where(shared > 0, shared, -np.inf)


SCORES = {"cosine": cosine, "hamming": bit_agreement, "channels": shared_channels}


# Queries and items that are scored at once; a block of scores takes 16 MB.
BLOCK_QUERIES = 512
BLOCK_ITEMS = 4096


class BestPerQuery:
    """Running k best items of every query seen so far, held as arrays for each block of queries."""

    def __init__(self, kind: str, k: int):
        self.kind, self.k = kind, k
        self.best: dict = {}

    def add(self, group, queries: tuple[np.ndarray, np.ndarray], ids: np.ndarray, payload: np.ndarray) -> None:
        """Score the items of a group against its queries, given as (ids, payload), block by block."""
        query_ids, query_payload = queries
        for first in range(0, len(query_ids), BLOCK_QUERIES):
            wanted = slice(first, first + BLOCK_QUERIES)
            for start in range(0, len(ids), BLOCK_ITEMS):
                some = slice(start, start + BLOCK_ITEMS)
                self._merge(group, first, query_ids[wanted], query_payload[wanted], ids[some], payload[some])

    def _merge(self, group, first: int, query_ids, query_payload, ids, payload) -> None:
        scores = SCORES[self.kind](payload, query_payload)
        scores[ids[:, None] == query_ids[None, :]] = -np.inf
        # A new item counts only if it reaches the k-th best of its block and of what is held.
        floor = self._floor(group, first, query_ids)
        if len(ids) > self.k:
            floor = np.maximum(floor, np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k])
        item, query = np.nonzero((scores >= floor) & (scores > -np.inf))
        self.keep(group, first, query_ids, query, scores[item, query], ids[item])

    def _held(self, group, first: int, query_ids, ids) -> tuple:
        return self.best.get((group, first), (query_ids, np.zeros(0, np.int64), np.zeros(0), ids[:0]))

    def _floor(self, group, first: int, query_ids) -> np.ndarray:
        _, rows, kept, _ = self._held(group, first, query_ids, query_ids)
        held = np.bincount(rows, minlength=len(query_ids))
        if not len(rows):
            return np.full(len(query_ids), -np.inf)
        last = np.cumsum(held) - 1
        return np.where(held >= self.k, kept[np.maximum(last, 0)], -np.inf)

    def keep(self, group, first: int, query_ids, query: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Add scored items of the queries (places in the block of queries that starts at first)."""
        _, rows, kept, kept_ids = self._held(group, first, query_ids, ids)
        rows = np.concatenate([rows, query])
        kept = np.concatenate([kept, scores])
        kept_ids = np.concatenate([kept_ids, ids])
        # Per query the highest scores first, the smaller id first among equals.
        order = np.lexsort((kept_ids, -kept, rows))
        rows = rows[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        order, rows = order[place < self.k], rows[place < self.k]
        self.best[group, first] = (query_ids, rows, kept[order], kept_ids[order])

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        groups, queries, items, scores = [], [], [], []
        for (group, _), (query_ids, rows, kept, ids) in self.best.items():
            groups += [group] * len(ids)
            queries += query_ids[rows].tolist()
            items += ids.tolist()
            scores += kept.tolist()
        columns = [groups, queries, items, scores]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def by_group(groups: np.ndarray):
    """Each distinct group with the mask of its rows."""
    for group in np.unique(groups):
        yield group.item(), groups == group
