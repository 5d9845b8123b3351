import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from kindred.operators import blocks, diverse, postings, search, skew

SCHEMA = "`group` string, id string, embedding array<float>, channels array<int>, words array<bigint>"


def catalogue(seed=0, rows=240):
    """A third of all rows are copies of one vector in one group; some vectors are zero."""
    rng = np.random.default_rng(seed)
    table = []
    for i in range(rows):
        group = "hot" if i < rows // 2 else f"g{i % 3}"
        vector = rng.normal(size=16).astype(np.float32)
        channels = rng.choice(40, 6, replace=False).tolist()
        words = rng.integers(0, 2**32, 2).tolist()
        if i < rows // 3:
            vector = np.ones(16, dtype=np.float32)
            channels, words = [1, 2, 3, 4, 5, 6], [7, 2**32 - 1]
        if i % 50 == 49:
            vector = np.zeros(16, dtype=np.float32)
        table.append((group, f"{i:03d}", vector.tolist(), channels, words))
    table.append(("lonely", "999", rng.normal(size=16).tolist(), [1] * 6, [0, 0]))
    return table


def unit(v):
    v = np.array(v, dtype=np.float64)
    return v / max(np.linalg.norm(v), 1e-12)


SCORE = {
    "cosine": lambda a, b: round(float(unit(a[2]) @ unit(b[2])), 10),
    "channels": lambda a, b: len(set(a[3]) & set(b[3])),
    "hamming": lambda a, b: -sum(bin(x ^ y).count("1") for x, y in zip(a[4], b[4])),
}


def brute_force(table, queries, kind, k):
    found = set()
    for q in queries:
        scored = [(-SCORE[kind](q, i), i[1]) for i in table if i[0] == q[0] and i[1] != q[1]]
        if kind == "channels":
            scored = [s for s in scored if s[0] < 0]
        for rank, (_, item) in enumerate(sorted(scored)[:k], 1):
            found.add((q[1], rank, item))
    return found


@pytest.mark.parametrize("task_results", [search.TASK_RESULTS, 70])
@pytest.mark.parametrize("kind", ["cosine", "channels", "hamming"])
def test_neighbours_equal_brute_force(spark, monkeypatch, kind, task_results):
    monkeypatch.setattr(blocks, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(blocks, "BLOCK_ITEMS", 17)
    table = catalogue()
    queries = [r for r in table if int(r[1]) % 9 == 0]
    items = spark.createDataFrame(table, SCHEMA).repartition(5)
    wanted = items.filter(F.col("id").isin([q[1] for q in queries]))
    operator = {
        "cosine": search.cosine_topk,
        "channels": search.channel_overlap_topn,
        "hamming": search.hamming_topk,
    }[kind]
    got = operator(items, wanted, 7, task_results=task_results).collect()
    assert {(r["query"], r["rank"], r["id"]) for r in got} == brute_force(table, queries, kind, 7)


def test_block_memory_and_time_stay_bounded():
    import time
    import tracemalloc

    draw = np.random.default_rng(4)
    items, queries = (draw.integers(0, 2**31, (n, 2)).astype(np.int32) for n in (10_000, 20_000))
    best = blocks.BestPerQuery("hamming", 20)
    tracemalloc.start()
    begun = time.monotonic()
    best.add("a", (np.arange(20_000) + 10_000, queries), np.arange(10_000), items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6 and time.monotonic() - begun < 120
    assert sum(len(ids) for _, _, _, ids in best.best.values()) == 400_000


def scans_and_broadcasts(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan"), plan.count("BroadcastExchange")


def test_plan_of_the_cascade_does_not_grow_with_the_queries(spark, tmp_path, monkeypatch):
    table = catalogue(3)
    spark.createDataFrame(table, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/items")
    items = spark.read.parquet(f"{tmp_path}/items")
    few, many = items.filter("cast(id as int) % 20 = 1"), items.filter("cast(id as int) % 2 = 1")
    monkeypatch.setattr(skew, "SENT_ROWS", 40)
    plans = [scans_and_broadcasts(search.three_stage_search(items, wanted, 15, 9, 4)) for wanted in (few, many)]
    assert plans[0] == plans[1] and max(plans[0]) <= 5


@pytest.mark.parametrize("query_bytes", [64 << 20, 600])
@pytest.mark.parametrize("sent", [500_000, 40])
def test_cascade_of_any_length_gives_the_same_rows(spark, monkeypatch, sent, query_bytes):
    items = spark.createDataFrame(catalogue(3), SCHEMA).repartition(3)
    wanted = items.filter("cast(id as int) % 20 = 1")
    whole = sorted(map(tuple, search.three_stage_search(items, wanted, 15, 9, 4).collect()))
    index = search.channel_index(items.select("group", "id", F.col("channels").alias("payload")))
    monkeypatch.setattr(skew, "SENT_ROWS", sent)
    monkeypatch.setattr(search, "QUERY_BYTES", query_bytes)
    assert sorted(map(tuple, search.three_stage_search(items, wanted, 15, 9, 4).collect())) == whole
    assert sorted(map(tuple, search.three_stage_search(items, wanted, 15, 9, 4, index).collect())) == whole


def test_rounds_deal_the_items_once(spark, monkeypatch):
    items = spark.createDataFrame(catalogue(3), SCHEMA)
    wanted = items.filter("cast(id as int) % 20 = 1")
    monkeypatch.setattr(search, "QUERY_BYTES", 600)
    shuffles, dealt = [], search.bucketed

    def watched(df, keys, rows):
        shuffles.append(keys)
        return dealt(df, keys, rows)

    monkeypatch.setattr(search, "bucketed", watched)
    assert search.three_stage_search(items, wanted, 15, 9, 4).count() > 0
    assert shuffles == [["group", "id"]]


@pytest.mark.parametrize("block_items", [7, 1 << 14])
@pytest.mark.parametrize("n", [1, 4, 500])
def test_postings_equal_brute_force(spark, monkeypatch, n, block_items):
    monkeypatch.setattr(postings, "BLOCK_ITEMS", block_items)
    table = catalogue(4)
    queries = [r for r in table if int(r[1]) % 9 == 0] + [table[-1]]
    items = spark.createDataFrame(table, SCHEMA).repartition(5)
    wanted = items.filter(F.col("id").isin([q[1] for q in queries]))
    index = search.channel_index(items.select("group", "id", F.col("channels").alias("payload")))
    got = search.channel_overlap_topn(index, wanted, n).collect()
    assert {(r["query"], r["rank"], r["id"]) for r in got} == brute_force(table, queries, "channels", n)
    assert all(r["shared"] == SCORE["channels"](*[next(t for t in table if t[1] == r[c]) for c in ("query", "id")]) for r in got)


def test_a_search_reads_only_the_postings_of_its_channels(spark):
    items = spark.range(300).select(
        F.lit("a").alias("group"), "id", F.expr("transform(sequence(0, 4), i -> cast((id * 7 + i * 61) % 320 as int))").alias("channels")
    )
    index = search.channel_index(items.select("group", "id", F.col("channels").alias("payload")))
    assert index.width == 10
    query = spark.createDataFrame([("a", 1000, [3, 7, 105])], "`group` string, id bigint, channels array<int>")
    found = search.channel_overlap_topn(index, query, 50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.rindex("ReadSchema") :]
    assert "band_00" in schema and "band_10" in schema and schema.count("band_") == 2
    lists = {r["id"]: set(r["channels"]) for r in items.collect()}
    expected = sorted((-len(c & {3, 7, 105}), i) for i, c in lists.items() if c & {3, 7, 105})[:50]
    assert [(-r["shared"], r["id"]) for r in sorted(found.collect(), key=lambda r: r["rank"])] == expected


def test_bound_reads_short_lists_first():
    draw = np.random.default_rng(5)
    lists = [np.sort(draw.choice(400, size, replace=False)).astype(np.uint16) for size in (3, 0, 390, 40, 200, 90)]
    counts = sum(np.bincount(places, minlength=400) for places in lists)
    for least in range(1, 8):
        found, shared = postings.shared_at_least(lists, 400, least)
        assert found.tolist() == np.flatnonzero(counts >= least).tolist()
        assert shared.tolist() == counts[counts >= least].tolist()


@pytest.mark.parametrize("words", [2, 3])
@pytest.mark.parametrize("part_bits", [(16, 8), (8,)])
def test_near_signatures_equal_brute_force(spark, monkeypatch, part_bits, words):
    monkeypatch.setattr(search, "BLOCK_QUERIES", 5)
    monkeypatch.setattr(search, "BLOCK_ITEMS", 17)
    draw, table = np.random.default_rng(6), []
    for i in range(300):
        # Families of signatures a few bits apart, copies, and some that are far from all.
        base = np.random.default_rng(i % 12).integers(0, 2**32, words)
        for bit in draw.choice(32 * words, draw.integers(0, 4), replace=False):
            base[bit // 32] ^= 1 << (bit % 32)
        if i % 29 == 0:
            base = draw.integers(0, 2**32, words)
        table.append((f"g{i % 2}", f"{i:03d}", None, [], base.tolist()))
    queries = [r for r in table if int(r[1]) % 7 == 0 or int(r[1]) % 29 == 0]
    items = spark.createDataFrame([(g, i, [1.0], [1], w) for g, i, _, _, w in table], SCHEMA).repartition(4)
    wanted = items.filter(F.col("id").isin([q[1] for q in queries]))
    got = search.hamming_topk(items, wanted, 6, part_bits, least_pairs=0).collect()
    assert {(r["query"], r["rank"], r["id"]) for r in got} == brute_force(table, queries, "hamming", 6)
    compared = {r["query"]: r["compared"] for r in search.compared_signatures(items, wanted, 16).collect()}
    # Queries meet their family, about 25 of the 150 items of their group, and hardly any other.
    assert max(compared.values()) < 60 and len(compared) == len(queries)


def test_rows_without_a_vector_are_left_out(spark):
    rows = [("a", 1, None), ("a", 2, [1.0, 0.0]), ("a", 3, [0.0, 1.0]), ("a", 4, [0.5, 0.5])]
    items = spark.createDataFrame(rows, "`group` string, id bigint, embedding array<float>").coalesce(1)
    assert {r["id"] for r in diverse.diverse_queries(items, 2).collect()} == {2, 3}
    assert {r["id"] for r in search.cosine_topk(items, items.filter("id = 2"), 5).collect()} == {3, 4}


def test_small_groups_return_the_others(spark):
    items = spark.createDataFrame(catalogue(), SCHEMA)
    lonely = items.filter("group = 'lonely'")
    assert search.cosine_topk(items, lonely, 5).count() == 0
    few = items.filter("id >= '230'")
    got = search.cosine_topk(few, few.filter("id = '231'"), 50).collect()
    group = few.filter("id = '231'").first()["group"]
    assert len(got) == few.filter(F.col("group") == group).count() - 1


def test_rerank_and_three_stages(spark):
    table = catalogue(3)
    items = spark.createDataFrame(table, SCHEMA).repartition(3)
    queries = [r for r in table if int(r[1]) % 20 == 1]
    wanted = items.filter(F.col("id").isin([q[1] for q in queries]))
    expected = set()
    for q in queries:
        group = [r for r in table if r[0] == q[0] and r[1] != q[1]]
        first = [r for r in group if SCORE["channels"](q, r) > 0]
        first = sorted(first, key=lambda r: (-SCORE["channels"](q, r), r[1]))[:15]
        second = sorted(first, key=lambda r: (-SCORE["hamming"](q, r), r[1]))[:9]
        third = sorted(second, key=lambda r: (-SCORE["cosine"](q, r), r[1]))[:4]
        expected |= {(q[1], rank, r[1]) for rank, r in enumerate(third, 1)}
    got = search.three_stage_search(items, wanted, 15, 9, 4).collect()
    assert {(r["query"], r["rank"], r["id"]) for r in got} == expected

    shortlist = search.hamming_topk(items, wanted, 9)
    for rows in (None, 9 * len(queries)):
        reranked = search.rerank_cosine(shortlist, items, wanted, 4, shortlist_rows=rows).collect()
        expected = set()
        for q in queries:
            group = [r for r in table if r[0] == q[0] and r[1] != q[1]]
            near = sorted(group, key=lambda r: (-SCORE["hamming"](q, r), r[1]))[:9]
            near = sorted(near, key=lambda r: (-SCORE["cosine"](q, r), r[1]))[:4]
            expected |= {(q[1], rank, r[1]) for rank, r in enumerate(near, 1)}
        assert {(r["query"], r["rank"], r["id"]) for r in reranked} == expected


def greedy(table, n):
    """The selection rule, one step at a time."""
    picks = {}
    for group in sorted({r[0] for r in table}):
        rows = sorted((r for r in table if r[0] == group), key=lambda r: r[1])
        if len(rows) <= n:
            picks[group] = [r[1] for r in rows]
            continue
        units, chosen = np.stack([unit(r[2]) for r in rows]), [0]
        while len(chosen) < n:
            highest = np.round(units @ units[chosen].T, 10).max(axis=1)
            highest[chosen] = 2.0
            chosen.append(int(np.argmin(highest)))
        picks[group] = [rows[i][1] for i in chosen]
    return picks


@pytest.mark.parametrize("frontier_rows", [1, 3, 128])
@pytest.mark.parametrize("n", [1, 6])
def test_diverse_queries_equal_the_stepwise_rule(spark, n, frontier_rows):
    table = catalogue(5)
    items = spark.createDataFrame(table, SCHEMA).repartition(4)
    got = diverse.diverse_queries(items, n, frontier_rows=frontier_rows).collect()
    for group, ids in greedy(table, n).items():
        rows = sorted((r for r in got if r["group"] == group), key=lambda r: r["ordinal"])
        assert [r["id"] for r in rows] == ids
        assert [r["ordinal"] for r in rows] == list(range(len(ids)))
        assert rows[0]["max_similarity"] is None


def test_groups_can_be_worked_in_turns(spark, monkeypatch):
    monkeypatch.setattr(diverse, "CHOSEN_BYTES", 1)
    table = catalogue(6)
    got = diverse.diverse_queries(spark.createDataFrame(table, SCHEMA), 4).collect()
    expected = {(g, i, x) for g, ids in greedy(table, 4).items() for i, x in enumerate(ids)}
    assert {(r["group"], r["ordinal"], r["id"]) for r in got} == expected


def test_threshold_only_flags(spark):
    same = [("a", i, [1.0, 0.0]) for i in range(4)] + [("b", i, [1.0, 0.0]) for i in range(2)]
    items = spark.createDataFrame(same, "`group` string, id bigint, embedding array<float>")
    got = {(r["group"], r["ordinal"]): r for r in diverse.diverse_queries(items, 3, threshold=1.0).collect()}
    assert [got["a", i]["over_threshold"] for i in range(3)] == [False, True, True]
    # A group that is taken whole is never flagged.
    assert [got["b", i]["over_threshold"] for i in range(2)] == [False, False]


def test_max_query_similarity_equals_all_pairs(spark):
    table = catalogue(8)
    vectors = {r[1]: unit(r[2]) for r in table}
    picks = diverse.diverse_queries(spark.createDataFrame(table, SCHEMA), 6)
    got = {r["group"]: r["max_similarity"] for r in diverse.max_query_similarity(picks).collect()}
    ids = {}
    for row in picks.collect():
        ids.setdefault(row["group"], []).append(row["id"])
    for group, members in ids.items():
        pairs = [float(vectors[a] @ vectors[b]) for a in members for b in members if a < b]
        assert got[group] == pytest.approx(max([0.0, *pairs]), abs=1e-9)


def test_mixed_widths_are_an_error(spark):
    items = spark.createDataFrame(
        [("a", 1, [1.0, 2.0]), ("a", 2, [1.0]), ("a", 3, [1.0, 2.0, 3.0])], "`group` string, id bigint, embedding array<float>"
    ).coalesce(1)
    with pytest.raises(PythonException, match="one width"):
        search.cosine_topk(items, items.filter("id = 1"), 1).collect()


def test_no_items(spark):
    items = spark.createDataFrame([], "`group` string, id string, embedding array<float>")
    assert diverse.diverse_queries(items).count() == 0


def test_the_frontier_is_merged_without_vectors(spark, monkeypatch):
    items = spark.createDataFrame(catalogue(5), SCHEMA).select("group", "id", "embedding").repartition(4)
    plans, put = [], diverse.stored

    def watched(df, name, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return put(df, name, *more)

    monkeypatch.setattr(diverse, "stored", watched)
    diverse.diverse_queries(items, 6).collect()
    assert plans
    for plan in plans:
        # Below the Python pass the vectors are read; above it, where rows are merged, there is none.
        above = plan[: plan.index("MapInArrow")]
        assert "Exchange" in above and "embedding" not in above
