"""Candidates of bit signatures by equal parts: who differs in fewer bits than there are parts has a part in common.

Signatures are cut into parts of 16 or 8 bits. The queries' parts are the index, sorted in every task; an item looks its own
parts up and meets only the queries that share one. With m parts, all items within m - 1 bits of a query are met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORD_BITS = 32


def parts(words: np.ndarray, bits: int) -> np.ndarray:
    """Rows of 32-bit words as rows of parts of 16 or 8 bits."""
    kind = {16: np.uint16, 8: np.uint8}[bits]
    return np.ascontiguousarray(words.astype(np.uint32)).view(kind).reshape(len(words), -1)


class PartIndex:
    """The parts of some queries, each part's values sorted."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words.astype(np.uint32), bits
        own = parts(words, bits)
        self.order = np.argsort(own, axis=0, kind="stable")
        self.values = np.take_along_axis(own, self.order, axis=0)

    @property
    def reach(self) -> int:
        """The greatest distance at which no item is missed."""
        return self.values.shape[1] - 1

    def met(self, items: np.ndarray) -> np.ndarray:
        """Whether an item (row) and a query (column) have an equal part."""
        own = parts(items, self.bits)
        marks = np.zeros((len(items), len(self.words)), bool)
        for part in range(own.shape[1]):
            values = self.values[:, part]
            first = np.searchsorted(values, own[:, part], side="left")
            width = np.searchsorted(values, own[:, part], side="right") - first
            rows = np.repeat(np.arange(len(items)), width)
            place = np.arange(len(rows)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first, width)
            marks[rows, self.order[place, part]] = True
        return marks

    def distances(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, query and number of differing bits of each pair that has met."""
        row, query = np.nonzero(self.met(items))
        differing = np.bitwise_count(items[row].astype(np.uint32) ^ self.words[query])
        return row, query, differing.sum(axis=1, dtype=np.int64)


def blocks(index_rows: int, item_rows: int, queries_at_once: int, items_at_once: int) -> Iterator[tuple[slice, slice]]:
    """Pairs of slices of queries and items."""
    for first in range(0, index_rows, queries_at_once):
        for start in range(0, item_rows, items_at_once):
            yield slice(first, first + queries_at_once), slice(start, start + items_at_once)
