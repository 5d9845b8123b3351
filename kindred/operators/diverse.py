"""Diverse query items per group: start at the smallest id, then always the item least similar to the chosen.

The rule is sequential, but not every step needs a pass over the data. The similarity of an item to
the chosen set can only grow. One pass therefore keeps, per group, the few items with the lowest values
(the frontier); picks are made inside it for as long as the next pick stays at or below its last key,
because no item outside can be lower. Only then the next pass starts. The picks equal those of one
pass per step.

A pass moves ids and keys only: the frontier is merged from the tasks' lowest rows, and the vectors of the few that are
left are then read where they lie.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kindred.constants import DIVERSITY_THRESHOLD, QUERIES_PER_CATEGORY
from kindred.operators.blocks import COMPARED_DIGITS, by_group, matrix, plain, unit_rows
from kindred.operators.skew import of_groups, sent_if_small
from kindred.runtime import fresh_path, stored

# Rows of a group kept by one pass.
FRONTIER_ROWS = 128
# Groups, and bytes of their chosen vectors, held at a time; more groups are worked through in turns.
TURN_GROUPS = 10_000
CHOSEN_BYTES = 256 << 20
# Results of this many tasks, then of this many merges, are merged at a time.
MERGE_FAN_IN = 64
# Below every similarity: the key of all items before the first pick.
NOTHING_CHOSEN = -2.0


def _highest(units: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Highest similarity of each row to the chosen vectors."""
    if len(chosen) == 0:
        return np.full(len(units), NOTHING_CHOSEN)
    return np.round(units @ chosen.T, COMPARED_DIGITS).max(axis=1)


def _pass(items: DataFrame, chosen: dict, limits: dict, schema: T.StructType) -> DataFrame:
    """Per task and group the keys (highest similarity, id) of the lowest rows, at most the group's limit."""
    arrow_schema = to_arrow_schema(schema)
    sent = items.sparkSession.sparkContext.broadcast((chosen, limits))

    def lowest_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, limits = sent.value
        kept: dict = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids, vectors = plain(batch["id"]), matrix(batch["embedding"])
            for group, rows in by_group(plain(batch["group"])):
                picked_ids, picked = chosen[group]
                group_ids = ids[rows]
                highest = _highest(unit_rows(vectors[rows]), picked)
                free = ~np.isin(group_ids, picked_ids)
                new = (highest[free], group_ids[free])
                if group in kept:
                    new = tuple(np.concatenate(pair) for pair in zip(kept[group], new))
                order = np.lexsort((new[1], new[0]))[: limits[group]]
                kept[group] = tuple(part[order] for part in new)
        part = TaskContext.get().partitionId()
        for group, (highest, group_ids) in kept.items():
            columns = [[group] * len(group_ids), group_ids.tolist(), highest.tolist(), [part] * len(group_ids)]
            arrays = [pa.array(c, t) for c, t in zip(columns, arrow_schema.types)]
            yield pa.record_batch(arrays, schema=arrow_schema)

    return items.mapInArrow(lowest_of_task, schema)


def _with_vectors(keys: DataFrame, items: DataFrame) -> DataFrame:
    """The frontier's keys (group, id, highest) with their vectors. Keys of a checked number go to the items' tasks, so no other
    vector is moved."""
    few = stored(keys, "frontier")
    return items.join(sent_if_small(few, few.count()), ["group", "id"]).select("group", "id", "highest", "embedding")


def _merged(passed: DataFrame, limit: int) -> DataFrame:
    """The lowest rows of each group over all tasks, merged as a tree so that no task takes them all.

    What is left of a group has at most limit rows for every MERGE_FAN_IN ** 2 tasks of the pass.
    """
    for tasks in (MERGE_FAN_IN, MERGE_FAN_IN**2):
        order = Window.partitionBy("group", F.floor(F.col("part") / tasks)).orderBy("highest", "id")
        passed = passed.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).drop("place")
    return passed.select("group", "id", "highest")


def _picks(frontier: DataFrame, chosen: dict, limits: dict, counts: dict, n: int, schema: T.StructType) -> DataFrame:
    """Greedy picks inside each group's frontier while nothing outside can be lower."""
    arrow_schema = to_arrow_schema(schema)
    sent = frontier.sparkSession.sparkContext.broadcast((chosen, limits, counts))

    def pick(rows: pa.Table) -> pa.Table:
        chosen, limits, counts = sent.value
        group = rows["group"][0].as_py()
        ids, vectors = plain(rows["id"]), matrix(rows["embedding"])
        highest = rows["highest"].to_numpy()
        order = np.lexsort((ids, highest))[: limits[group]]
        ids, vectors, highest = ids[order], vectors[order], highest[order].copy()
        units = unit_rows(vectors)
        picked_ids, picked = chosen[group]
        done, everything = len(picked_ids), counts[group] <= n
        complete = len(ids) + done >= counts[group]
        last = (highest[-1], ids[-1])
        out = []
        free = np.ones(len(ids), dtype=bool)
        while done + len(out) < n and free.any():
            left = np.flatnonzero(free)
            if everything:
                best = left[np.argmin(ids[left])] if ids.dtype.kind != "U" else min(left, key=lambda i: ids[i])
            else:
                best = left[np.lexsort((ids[left], highest[left]))[0]]
            if not complete and (highest[best], ids[best]) > last:
                break
            out.append((best, highest[best]))
            free[best] = False
            highest = np.maximum(highest, _highest(units, units[best : best + 1]))
        places = [b for b, _ in out]
        columns = [
            [group] * len(out),
            list(range(done, done + len(out))),
            ids[places].tolist(),
            [None if value == NOTHING_CHOSEN else float(value) for _, value in out],
            list(vectors[places]),
        ]
        return pa.table([pa.array(c, t) for c, t in zip(columns, arrow_schema.types)], schema=arrow_schema)

    return frontier.groupBy("group").applyInArrow(pick, schema)


def _first_rows(items: DataFrame, counts: dict, firsts: dict, n: int) -> DataFrame:
    """The rows with the smallest id of each group, and all rows of groups that are taken whole."""
    group, id_type = items.schema["group"], items.schema["id"].dataType
    shape = T.StructType([group, T.StructField("first", id_type), T.StructField("whole", T.BooleanType())])
    rows = [(g, firsts[g], rows <= n) for g, rows in counts.items()]
    # One row per group of this turn.
    marks = sent_if_small(items.sparkSession.createDataFrame(rows, shape), len(rows))
    wanted = F.col("whole") | (F.col("id") == F.col("first"))
    return items.join(marks, "group").filter(wanted).select(items.columns)


def _select_groups(items: DataFrame, counts: dict, firsts: dict, n: int, frontier_rows: int) -> list[tuple]:
    """Picks of all groups in counts: (group, ordinal, id, max_similarity)."""
    fields = {f.name: f.dataType for f in items.schema}
    passed_schema = T.StructType(
        [
            T.StructField("group", fields["group"]),
            T.StructField("id", fields["id"]),
            T.StructField("highest", T.DoubleType()),
            T.StructField("part", T.IntegerType()),
        ]
    )
    pick_schema = T.StructType(
        [
            T.StructField("group", fields["group"]),
            T.StructField("ordinal", T.IntegerType()),
            T.StructField("id", fields["id"]),
            T.StructField("max_similarity", T.DoubleType()),
            T.StructField("embedding", fields["embedding"]),
        ]
    )
    empty = np.zeros((0, 0))
    chosen = {g: (np.array([]), empty) for g in counts}
    picks: list[tuple] = []
    limits = {g: rows if rows <= n else 1 for g, rows in counts.items()}
    wanted = _first_rows(items, counts, firsts, n)
    while True:
        open_groups = [g for g in counts if len(chosen[g][0]) < min(n, counts[g])]
        if not open_groups:
            return picks
        if picks:
            limits = dict.fromkeys(open_groups, max(frontier_rows, 1))
            wanted = of_groups(items, open_groups)
        state = {g: chosen[g] for g in open_groups}
        keys = _merged(_pass(wanted, state, limits, passed_schema), max(limits.values()))
        frontier = _with_vectors(keys, wanted)
        table = _picks(frontier, state, limits, counts, n, pick_schema).toArrow()
        groups, ids = plain(table["group"]), plain(table["id"])
        ordinals, highest = table["ordinal"].to_numpy(), table["max_similarity"].to_pylist()
        units = unit_rows(matrix(table["embedding"]))
        for group, rows in by_group(groups):
            order = np.flatnonzero(rows)[np.argsort(ordinals[rows])]
            old_ids, old = chosen[group]
            chosen[group] = (
                np.concatenate([old_ids, ids[order]]) if len(old_ids) else ids[order],
                np.concatenate([old, units[order]]) if len(old_ids) else units[order],
            )
            picks += [(group, int(ordinals[i]), ids[i].item(), highest[i]) for i in order]


def diverse_queries(
    items: DataFrame,
    n: int = QUERIES_PER_CATEGORY,
    threshold: float = DIVERSITY_THRESHOLD,
    frontier_rows: int = FRONTIER_ROWS,
) -> DataFrame:
    """n diverse items per group: group, ordinal, id, max_similarity, over_threshold.

    items: group, id, embedding, all vectors of one width. A group with at most n items is taken whole, in id
    order. Rows without a vector are left out. max_similarity is the highest similarity to the earlier picks, null for the first. The threshold
    only flags. Items are read once per pass; pass in a stored table when computing them is costly.
    """
    usable = F.col("group").isNotNull() & F.col("embedding").isNotNull()
    items = items.filter(usable).select("group", "id", "embedding")
    head = items.select("embedding").first()
    width = max(len(head["embedding"]), 1) if head else 1
    per_turn = max(1, min(TURN_GROUPS, CHOSEN_BYTES // (8 * (n + frontier_rows) * width)))
    # Reads no vectors.
    sizes = items.groupBy("group").agg(F.count("*").alias("rows"), F.min("id").alias("first"))
    few = sizes.limit(per_turn + 1).collect()
    schema = T.StructType(
        [
            T.StructField("group", items.schema["group"].dataType),
            T.StructField("ordinal", T.IntegerType()),
            T.StructField("id", items.schema["id"].dataType),
            T.StructField("max_similarity", T.DoubleType()),
            T.StructField("over_threshold", T.BooleanType()),
        ]
    )

    def picks_of(rows: list) -> DataFrame:
        counts, firsts = {r["group"]: r["rows"] for r in rows}, {r["group"]: r["first"] for r in rows}
        picks = _select_groups(items, counts, firsts, n, frontier_rows)
        flagged = [(g, o, i, s, s is not None and counts[g] > n and s >= threshold) for g, o, i, s in picks]
        return items.sparkSession.createDataFrame(flagged, schema)

    if len(few) <= per_turn:
        return picks_of(few)
    sizes, path = stored(sizes, "sizes"), fresh_path(items.sparkSession, "picks")
    turns = math.ceil(sizes.count() / per_turn)
    for turn in range(turns):
        in_turn = F.pmod(F.xxhash64("group"), F.lit(turns)) == turn
        picks_of(sizes.filter(in_turn).collect()).write.mode("append").parquet(path)
    return items.sparkSession.read.schema(schema).parquet(path)


def max_query_similarity(picks: DataFrame) -> DataFrame:
    """Highest similarity between two picks of a group, at least 0.

    Each pick already carries its highest similarity to the earlier ones, so the pairs need not be built.
    """
    highest = F.greatest(F.coalesce(F.max("max_similarity"), F.lit(0.0)), F.lit(0.0))
    return picks.groupBy("group").agg(F.count("*").alias("queries"), highest.alias("max_similarity"))
