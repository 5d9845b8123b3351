"""Plans: what is read, moved and limited."""

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from kindred.operators import catalogue, dataset, evaluation, ranking, search
from kindred.plans import derived
from kindred.plans.derived import Tables


@pytest.fixture
def tables(spark):
    return Tables(spark, "/root/testdata/sf0.001")


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranking_limits_before_the_shuffle(tables):
    plan = executed(ranking.rank_queries(derived.answer_lists(tables), derived.queries(tables)))
    first = plan.rindex("WindowGroupLimit")
    assert "Partial" in plan and "Exchange" in plan[:first]


def test_meta_dedup_limits_before_the_shuffle(tables):
    plan = executed(catalogue.image_meta(derived.line_images(tables), "l_orderkey", "l_linenumber", "l_extendedprice"))
    assert "Partial" in plan


def test_neighbours_move_only_results(tables):
    items = derived.with_codes(derived.vector_items(tables))
    queries = items.filter("id < 10")
    plan = executed(search.cosine_topk(items, queries, 5))
    # One shuffle, above the Python scan; nothing below it but the file.
    assert plan.count("Exchange") == 1
    assert plan.index("Exchange") < plan.index("MapInArrow") < plan.index("FileScan")
    scan = plan[plan.index("ReadSchema") :]
    assert "vec_id" in scan and "embedding" in scan


def test_channel_scan_groups_filter_at_the_scan(tables):
    items = derived.with_codes(derived.vector_items(tables))
    plan = executed(search.cosine_topk(items, items.filter("id < 10"), 5))
    assert "PushedFilters: [" in plan and "In(label" in plan


def test_todo_reads_only_keys_of_the_results(tables):
    rows = tables.lineitem.select(F.col("l_orderkey").alias("image_uuid"), "l_partkey")
    done = tables.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("image_uuid"), "o_totalprice")
    plan = executed(catalogue.incremental_todo(rows, done))
    assert "LeftAnti" in plan and "o_totalprice" not in plan
    assert "EqualTo(o_orderstatus,F)" in plan


def test_labels_need_no_shuffle(tables):
    assert "Exchange" not in executed(dataset.labelme_to_yolo(derived.labelme(tables)))


def test_evaluation_adds_up_before_it_shuffles(tables):
    plan = executed(evaluation.per_query(*derived.retrieval(tables)))
    assert plan.count("Exchange") == 2 and "partial_max" in plan and "partial_sum" in plan


@pytest.mark.parametrize("name", ["gt_status", "latency_by_backbone", "load_stats", "rank_cutoff"])
def test_no_product_joins(tables, name):
    from kindred.plans.checks import QUERIES

    plan = plan_of(QUERIES[name](tables))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
