"""Row numbers, splits and joins with one key on a large share of the rows."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kindred.operators import skew
from kindred.operators.positions import chunk_number, numbered, numbered_as_stored, smallest_share
from kindred.operators.skew import hot_keys, join_unique


def test_numbered_is_a_dense_order(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("k")).repartition(7)
    got = {r["k"]: r["position"] for r in numbered(df, "k").collect()}
    assert got == {k: k for k in range(1000)}


def test_copies_of_one_key_are_numbered_too(spark):
    df = spark.createDataFrame([("a",)] * 300 + [(f"b{i:03d}",) for i in range(300)], "k string").repartition(4)
    got = [(r["position"], r["k"]) for r in numbered(df, "k").collect()]
    assert sorted(p for p, _ in got) == list(range(600))
    assert [k for _, k in sorted(got)] == sorted(k for _, k in got)


@pytest.mark.parametrize(
    "rows, sizes", [(0, {}), (10, {4: 10}), (1000, {4: 500, 5: 500}), (1203, {4: 500, 5: 500, 6: 203})]
)
def test_chunk_number(spark, rows, sizes):
    df = spark.range(rows).repartition(5)
    got = Counter(r["file_no"] for r in chunk_number(df, "id", start=3).collect())
    assert got == sizes


def test_smallest_share_is_exact_in_groups_of_any_size(spark):
    rows = [("hot", f"s{i}") for i in range(2001)] + [("small", f"t{i}") for i in range(4)] + [("mid", f"u{i}") for i in range(37)]
    df = spark.createDataFrame(rows, "g string, stem string").repartition(6)
    got = smallest_share(df, "g", F.md5("stem"), "stem", 0.2, "taken").collect()
    expected = set()
    for group, share in (("hot", 400), ("small", 0), ("mid", 7)):
        stems = sorted((s for g, s in rows if g == group), key=lambda s: hashlib.md5(s.encode()).hexdigest())
        expected |= {(group, s) for s in stems[:share]}
    assert len(got) == len(rows)
    assert {(r["g"], r["stem"]) for r in got if r["taken"]} == expected


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("min_rows", [1, 50, 10**6])
def test_join_unique_equals_a_plain_join(spark, how, min_rows):
    many = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 0), (None, 5), (9, 1)], "k int, v int")
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "n")], "k int, w string")
    key = lambda df: sorted(map(repr, df.select("k", "v", "w").collect()))
    assert key(join_unique(one, many, "k", how, min_rows)) == key(one.join(many, "k", how))


def test_hot_keys(spark):
    df = spark.createDataFrame([(1,)] * 100 + [(2,)] * 60 + [(3,), (None,)], "k int")
    assert hot_keys(df, "k", 50) == [1, 2]


def test_hot_keys_shuffle_no_rows(spark):
    df = spark.range(10_000).select((F.col("id") % 3000).alias("k"))
    plans = []
    find = type(df).agg

    def watched(self, *columns):
        found = find(self, *columns)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    type(df).agg = watched
    try:
        assert hot_keys(df.unionByName(spark.range(5000).select(F.lit(7).cast("bigint").alias("k"))), "k", 2000) == [7]
    finally:
        type(df).agg = find
    assert "hashpartitioning" not in plans[0] and "SinglePartition" in plans[0]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_keys_that_are_hot_in_the_base_table_only(spark, how):
    base = spark.createDataFrame([(k, i) for k in (1, 2, 4) for i in range(60)], "k int, v int")
    many = base.filter("k <> 2 and v < 3")
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (None, "n")], "k int, w string")
    key = lambda df: sorted(map(repr, df.select("k", "v", "w").collect()))
    assert key(join_unique(one, many, "k", how, 50, base)) == key(one.join(many, "k", how))


def test_many_groups_are_joined_instead_of_listed(spark, monkeypatch):
    items = spark.range(100).select((F.col("id") % 10).alias("group"), "id")
    for listed in (1000, 2):
        monkeypatch.setattr(skew, "LISTED_GROUPS", listed)
        assert {r["id"] % 10 for r in skew.of_groups(items, [1, 4, 7]).collect()} == {1, 4, 7}


def test_rows_numbered_as_they_are_stored(spark, tmp_path):
    spark.range(1000).repartition(7).write.partitionBy().parquet(f"{tmp_path}/t")
    table = numbered_as_stored(spark.read.parquet(f"{tmp_path}/t"))
    assert sorted(r["position"] for r in table.collect()) == list(range(1000))
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("min_rows", [1, 50, 10**6])
def test_join_unique_with_a_condition(spark, how, min_rows):
    many = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 0), (None, 5), (9, 1)], "k int, v int")
    one = spark.createDataFrame([(1, [3, 5]), (2, [7]), (3, [0]), (None, [5])], "k int, w array<int>")
    key = lambda df: sorted(map(repr, df.select("k", "v", "w").collect()))
    got = join_unique(one, many, "k", how, min_rows, only=F.array_contains("w", F.col("v")))
    plain = one.join(many, "k").filter(F.array_contains("w", F.col("v")))
    alone = one.filter("k is null or k > 1").withColumn("v", F.lit(None).cast("int"))
    assert key(got) == key(plain.unionByName(alone) if how == "left" else plain)
