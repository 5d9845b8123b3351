"""Exact neighbours inside a group, and the cheaper cascade of channels, bits and cosine.

Input tables have one row per item: a group (category), an id and a payload array of one width.
"""

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kindred.functions import vectors
from kindred.operators import signatures, skew
from kindred.operators.blocks import BLOCK_ITEMS, BLOCK_QUERIES, BestPerQuery, by_group, matrix, plain
from kindred.operators.postings import ChannelIndex, channel_index, shared_channels
from kindred.runtime import bucketed, fresh_path, stored

# Queries up to this size are sent to the tasks at once, and so many results may a task hold; more queries are
# worked through in rounds, each of which reads the items once and moves none of them.
QUERY_BYTES = 64 << 20
TASK_RESULTS = 1_000_000
# Bits of a part in the rounds of the nearest signatures, and pairs from which rounds are worth a reading of the items.
PART_BITS = (16, 8)
LEAST_PAIRS = 100_000_000


def _found_schema(items: DataFrame, queries: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("group", items.schema["group"].dataType),
            T.StructField("query", queries.schema["id"].dataType),
            T.StructField("id", items.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def query_blocks(queries: DataFrame) -> dict:
    """Queries of a checked size, by group."""
    table = queries.toArrow()
    groups, ids, payload = plain(table["group"]), plain(table["id"]), matrix(table["payload"])
    return {g: (ids[rows], payload[rows]) for g, rows in by_group(groups)}


def _scan(items: DataFrame, queries: DataFrame, kind: str, k: int) -> DataFrame:
    """One pass over the items: every task returns at most k rows per query, nothing else is moved."""
    schema = _found_schema(items, queries)
    arrow_schema = to_arrow_schema(schema)
    collected = query_blocks(queries)
    sent = items.sparkSession.sparkContext.broadcast(collected)

    def best_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, best = sent.value, BestPerQuery(kind, k)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids, payload = plain(batch["id"]), matrix(batch["payload"])
            for group, rows in by_group(plain(batch["group"])):
                if group in blocks:
                    best.add(group, blocks[group], ids[rows], payload[rows])
        yield best.batch(arrow_schema)

    return skew.of_groups(items, list(collected)).mapInArrow(best_of_task, schema)


def _scan_parts(items: DataFrame, queries: DataFrame, bits: int, k: int) -> DataFrame:
    """One pass over the items that compares an item only with queries that share a part of `bits` bits: the k nearest of
    those within reach in each task."""
    schema = _found_schema(items, queries)
    arrow_schema = to_arrow_schema(schema)
    collected = query_blocks(queries)
    sent = items.sparkSession.sparkContext.broadcast(collected)

    def near_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, indexes = BestPerQuery("hamming", k), {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids, words = plain(batch["id"]), matrix(batch["payload"])
            for group, rows in by_group(plain(batch["group"])):
                if group not in sent.value:
                    continue
                query_ids, query_words = sent.value[group]
                group_ids, group_words = ids[rows], words[rows]
                for wanted, some in signatures.blocks(len(query_ids), len(group_ids), BLOCK_QUERIES, BLOCK_ITEMS):
                    key = (group, wanted.start)
                    if key not in indexes:
                        indexes[key] = signatures.PartIndex(query_words[wanted], bits)
                    item, query, distance = indexes[key].distances(group_words[some])
                    near = (distance <= indexes[key].reach) & (group_ids[some][item] != query_ids[wanted][query])
                    item, query, score = item[near], query[near], -distance[near].astype(float)
                    best.keep(group, wanted.start, query_ids[wanted], query, score, group_ids[some][item])
        yield best.batch(arrow_schema)

    return skew.of_groups(items, list(collected)).mapInArrow(near_of_task, schema)


def _scan_postings(index: ChannelIndex, queries: DataFrame, n: int) -> DataFrame:
    """One pass over the index's blocks of the queries' groups, in the columns of their channels."""
    blocks = index.blocks
    schema = _found_schema(blocks.select("group", F.explode("ids").alias("id")), queries)
    collected = query_blocks(queries)
    return shared_channels(index, skew.of_groups(blocks, list(collected)), collected, n, schema, to_arrow_schema(schema))


def in_rounds(queries: DataFrame, k: int, scan: Callable, query_bytes: int, task_results: int) -> DataFrame:
    """k best rows of a scan for every query: group, query, id, rank, score.

    The queries of a round are sent to the tasks, so a round has as many as fit the bounds; each reads the items once, and
    several are written one after the other. Queries are read more than once: pass in a stored table when they are the result of a scan.
    """
    size = queries.agg(
        F.coalesce(F.sum(F.size("payload") * 8 + 32), F.lit(0)).alias("bytes"), F.count("*").alias("rows")
    ).first()
    rounds = max(1, math.ceil(size["bytes"] / query_bytes), math.ceil(size["rows"] * k / task_results))

    def ranked(wanted: DataFrame) -> DataFrame:
        order = Window.partitionBy("group", "query").orderBy(F.desc("score"), "id")
        return (
            scan(wanted)
            .withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k)
            .select("group", "query", "id", "rank", "score")
        )

    if rounds == 1:
        return ranked(queries)
    path = fresh_path(queries.sparkSession, "neighbours")
    for at in range(rounds):
        in_round = F.pmod(F.xxhash64("group", "id"), F.lit(rounds)) == at
        found = ranked(queries.filter(in_round))
        found.write.mode("append").parquet(path)
    return queries.sparkSession.read.schema(found.schema).parquet(path)


def nearest(
    items: DataFrame,
    queries: DataFrame,
    kind: str,
    k: int,
    query_bytes: int = QUERY_BYTES,
    task_results: int = TASK_RESULTS,
) -> DataFrame:
    """k best items of the query's own group for every query, the query itself left out.

    items, queries: group, id, payload. Result: group, query, id, rank, score.
    A group with fewer than k others returns those it has.
    """
    return in_rounds(queries, k, lambda wanted: _scan(items, wanted, kind, k), query_bytes, task_results)


def _neighbours(items: DataFrame, queries: DataFrame, column: str, kind: str, k: int, **options) -> DataFrame:
    """nearest on a column; the queries, mostly picked from a large table, are scanned for once."""
    return nearest(_payload(items, column), stored(_payload(queries, column), "queries"), kind, k, **options)


def _payload(df: DataFrame, column: str) -> DataFrame:
    """group, id and payload of rows that have all of them. A code is null exactly if its vector is, which is
    cheaper to ask than to compute the code twice."""
    source = "embedding" if "embedding" in df.columns else column
    usable = F.col("group").isNotNull() & F.col(source).isNotNull()
    return df.filter(usable).select("group", "id", F.col(column).alias("payload"))


def cosine_topk(items: DataFrame, queries: DataFrame, k: int = 20, **options) -> DataFrame:
    """Exact cosine neighbours: group, query, id, rank, similarity (6 digits)."""
    found = _neighbours(items, queries, "embedding", "cosine", k, **options)
    return found.select("group", "query", "id", "rank", F.round("score", 6).alias("similarity"))


def hamming_topk(
    items: DataFrame,
    queries: DataFrame,
    k: int = 20,
    part_bits: Sequence[int] = PART_BITS,
    least_pairs: int = LEAST_PAIRS,
    query_bytes: int = QUERY_BYTES,
    task_results: int = TASK_RESULTS,
) -> DataFrame:
    """Nearest bit signatures: group, query, id, rank, distance.

    Rounds of growing reach: with parts of 16 bits, then of 8, an item is compared with the queries that share a part, which
    are all within as many bits as there are parts, less one. A query that has k items within reach is finished; those that
    are left at the end have neighbours so far away that they are compared with all items of their group. So are all, if
    there are fewer than least_pairs pairs of an item and a query. The rows are the same.
    """
    items, wanted = _payload(items, "words"), stored(_payload(queries, "words"), "queries")
    bounds = {"query_bytes": query_bytes, "task_results": task_results}
    finished = []
    if wanted.count() and items.count() * wanted.count() >= least_pairs:
        for bits in part_bits:
            found = in_rounds(wanted, k, lambda some, bits=bits: _scan_parts(items, some, bits, k), **bounds)
            found = stored(found, "near")
            whole = found.filter(F.col("rank") == k).select("group", "query")
            finished.append(found.join(whole, ["group", "query"], "left_semi"))
            done = whole.withColumnRenamed("query", "id")
            wanted = stored(wanted.join(done, ["group", "id"], "left_anti"), "queries")
            if wanted.isEmpty():
                break
    found = reduce(DataFrame.unionByName, [*finished, nearest(items, wanted, "hamming", k, **bounds)])
    return found.select("group", "query", "id", "rank", (-F.col("score")).cast("int").alias("distance"))


def compared_signatures(items: DataFrame, queries: DataFrame, bits: int = PART_BITS[0]) -> DataFrame:
    """How many items each query is compared with in the round of parts of so many bits: group, query, compared."""
    items, wanted = _payload(items, "words"), stored(_payload(queries, "words"), "queries")
    collected = query_blocks(wanted)
    sent = items.sparkSession.sparkContext.broadcast(collected)
    fields = _found_schema(items, wanted).fields
    schema = T.StructType([*fields[:2], T.StructField("compared", T.LongType())])
    arrow_schema = to_arrow_schema(schema)

    def counts_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids, words = plain(batch["id"]), matrix(batch["payload"])
            for group, rows in by_group(plain(batch["group"])):
                query_ids, query_words = sent.value.get(group, (ids[:0], words[:0]))
                for wanted, some in signatures.blocks(len(query_ids), int(rows.sum()), BLOCK_QUERIES, BLOCK_ITEMS):
                    met = signatures.PartIndex(query_words[wanted], bits).met(words[rows][some])
                    met &= ids[rows][some][:, None] != query_ids[wanted][None, :]
                    columns = [[group] * met.shape[1], query_ids[wanted].tolist(), met.sum(axis=0)]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, arrow_schema.types)], schema=arrow_schema)

    counted = skew.of_groups(items, list(collected)).mapInArrow(counts_of_task, schema)
    return counted.groupBy("group", "query").agg(F.sum("compared").alias("compared"))


def channel_overlap_topn(
    items: DataFrame | ChannelIndex, queries: DataFrame, n: int = 100, query_bytes: int = QUERY_BYTES, task_results: int = TASK_RESULTS
) -> DataFrame:
    """Items that share most top channels, at least one: group, query, id, rank, shared.

    items: the items, or their index (channel_index) where they are searched more than once.
    """
    index = items if isinstance(items, ChannelIndex) else channel_index(_payload(items, "channels"))
    wanted = stored(_payload(queries, "channels"), "queries")
    found = in_rounds(wanted, n, lambda some: _scan_postings(index, some, n), query_bytes, task_results)
    return found.select("group", "query", "id", "rank", F.col("score").cast("int").alias("shared"))


def _scored(
    shortlist: DataFrame, items: DataFrame, queries: DataFrame, rows: int | None, **numbers: tuple[str, Callable]
) -> DataFrame:
    """Shortlist pairs with numbers made of the item's and the query's code: name=(column, function of both).

    rows is a proven bound of the shortlist. A short one is sent to the items' tasks with its queries: no code is shuffled. A
    long one meets the items where Spark brings them together by id, while the queries' codes are still sent. If these do
    not fit QUERY_BYTES, they are worked through in rounds, written one after the other, over items that are dealt by id
    once. So a plan has one scan of the items and at most two broadcasts, however many queries there are.
    """
    columns = sorted({column for column, _ in numbers.values()})
    item_side = items.select("group", "id", *[F.col(c).alias(f"item_{c}") for c in columns])
    query_side = queries.select("group", F.col("id").alias("query"), *[F.col(c).alias(f"query_{c}") for c in columns])
    pairs = shortlist.select("group", "query", "id")
    results = [f(F.col(f"item_{c}"), F.col(f"query_{c}")).alias(name) for name, (c, f) in numbers.items()]

    def joined(some_items: DataFrame, some_pairs: DataFrame, some_queries: DataFrame) -> DataFrame:
        met = some_items.join(some_pairs, ["group", "id"]).join(some_queries, ["group", "query"])
        return met.select("group", "query", "id", *results)

    if rows is None:
        return joined(item_side, pairs, query_side)
    size = sum((F.coalesce(F.size(f"query_{c}"), F.lit(0)) for c in columns), F.lit(8)) * 8
    rounds = math.ceil((query_side.agg(F.sum(size).alias("bytes")).first()["bytes"] or 0) / QUERY_BYTES)
    if rounds <= 1:
        return joined(item_side, skew.sent_if_small(pairs, rows), F.broadcast(query_side))
    spark, path = items.sparkSession, fresh_path(items.sparkSession, "scored")
    pairs, query_side = stored(pairs, "shortlist"), stored(query_side, "queries")
    with bucketed(item_side, ["group", "id"], rows) as coded:
        for at in range(rounds):
            in_round = F.pmod(F.xxhash64("group", "query"), F.lit(rounds)) == at
            part = joined(coded, pairs.filter(in_round), F.broadcast(query_side.filter(in_round)))
            part.write.mode("append").parquet(path)
    return spark.read.schema(part.schema).parquet(path)


def _similarity(a: Column, b: Column) -> Column:
    return F.round(vectors.dot(vectors.unit_vector(a), vectors.unit_vector(b)), 10)


def rerank_cosine(
    shortlist: DataFrame, items: DataFrame, queries: DataFrame, k: int = 20, shortlist_rows: int | None = None
) -> DataFrame:
    """Shortlisted pairs (group, query, id) ordered by cosine: group, query, id, rank, similarity.

    shortlist_rows is a proven bound of the shortlist; without it Spark chooses the join.
    """
    scored = _scored(shortlist, items, queries, shortlist_rows, score=("embedding", _similarity))
    order = Window.partitionBy("group", "query").orderBy(F.desc("score"), "id")
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("group", "query", "id", "rank", F.round("score", 6).alias("similarity"))
    )


def three_stage_search(
    items: DataFrame,
    queries: DataFrame,
    n_channels: int = 200,
    n_bits: int = 100,
    k: int = 20,
    index: ChannelIndex | None = None,
) -> DataFrame:
    """Shared channels, then Hamming, then cosine: group, query, id, rank, similarity.

    The first stage reads the postings of the queries' channels if an index of the items is given, else the channel lists of
    all items. Bits and vectors are read for its shortlist alone and reduced to two numbers where they meet.
    """
    queries = stored(queries.select("group", "id", "channels", "words", "embedding"), "queries")
    if index is None:
        shortlist = nearest(_payload(items, "channels"), _payload(queries, "channels"), "channels", n_channels)
    else:
        shortlist = channel_overlap_topn(index, queries, n_channels)
    rows = queries.count() * n_channels
    codes = {"distance": ("words", vectors.hamming), "score": ("embedding", _similarity)}
    scored = _scored(shortlist, items, queries, rows, **codes)
    per_query = Window.partitionBy("group", "query")
    return (
        scored.withColumn("bit_rank", F.row_number().over(per_query.orderBy("distance", "id")))
        .filter(F.col("bit_rank") <= n_bits)
        .withColumn("rank", F.row_number().over(per_query.orderBy(F.desc("score"), "id")))
        .filter(F.col("rank") <= k)
        .select("group", "query", "id", "rank", F.round("score", 6).alias("similarity"))
    )
