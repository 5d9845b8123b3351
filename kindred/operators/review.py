"""Human review: progress, query list and detail, validation, upsert, export, navigation.

queries: query_id, category, image_uuid, image_url.
candidates: query_id, rank, image_uuid, image_url, similarity.
selections: query_id, selected_image_ids, completed_at, one row per query.
submissions: submission_id, query_id, selected_image_ids, completed_at.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.constants import MAX_SELECTED, MIN_SELECTED
from kindred.functions import text
from kindred.operators.positions import numbered
from kindred.operators.skew import HOT_ROWS, hot_keys_and_nulls, join_unique


def query_list(queries: DataFrame, selections: DataFrame) -> DataFrame:
    """Every query with a completed flag."""
    answered = selections.select("query_id", F.lit(True).alias("_answered"))
    return queries.join(answered, "query_id", "left").select(
        "query_id", "category", "image_uuid", "image_url", F.coalesce("_answered", F.lit(False)).alias("completed")
    )


def status(queries: DataFrame, selections: DataFrame) -> DataFrame:
    """Progress per category and overall (category null): total, completed, percent, badge."""
    counted = (
        query_list(queries, selections)
        .rollup("category")
        .agg(F.count("*").alias("total"), F.count_if("completed").alias("completed"), F.grouping("category").alias("g"))
    )
    return counted.select(
        F.when(F.col("g") == 1, F.lit("overall")).otherwise(F.col("category")).alias("category"),
        "total",
        "completed",
        F.when(F.col("total") > 0, F.col("completed") / F.col("total") * 100).otherwise(F.lit(0.0)).alias("percent"),
        F.when(F.col("completed") == F.col("total"), F.lit("done")).otherwise(F.lit("pending")).alias("badge"),
    )


def query_detail(
    queries: DataFrame, candidates: DataFrame, selections: DataFrame, query_id: str | None = None
) -> DataFrame:
    """Queries with their candidates in rank order, one row each, and whether the stored selection has them.

    selected is null while a query has no selection. A query_id looks one query up; an unknown one is empty.
    """
    if query_id is not None:
        queries = queries.filter(F.col("query_id") == query_id)
    found = queries.select(
        "query_id",
        "category",
        F.col("image_uuid").alias("query_image_uuid"),
        F.col("image_url").alias("query_image_url"),
    )
    chosen = found.join(selections.select("query_id", "selected_image_ids"), "query_id", "left")
    return join_unique(chosen, candidates, "query_id", "left").select(
        *found.columns,
        *[c for c in candidates.columns if c != "query_id"],
        F.array_contains("selected_image_ids", F.col("image_uuid")).alias("selected"),
    )


def validate(submissions: DataFrame, candidates: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every submission with its valid ids in submitted order and whether their number is allowed.

    Valid ids are candidates of the query, each once at its first mention. Submissions and candidates move once, to where their
    query is, the submissions as lists; ids are looked up there by a sort, so a task holds no list longer than the submitted
    ones. Queries with at least hot_rows submissions are matched by query and id, which spreads them over all tasks, and so are
    as many submissions without a query.
    Result: submission_id, query_id, completed_at, selected_image_ids, valid_ids, accepted.
    """
    key = ["submission_id", "query_id", "completed_at"]
    given = submissions.select(*key, F.array_distinct("selected_image_ids").alias("ids"))
    shown = candidates.select("query_id", "image_uuid").dropna()
    hot, nulls = hot_keys_and_nulls(submissions, "query_id", hot_rows)
    if hot or nulls >= hot_rows:
        is_hot = F.when(F.col("query_id").isNull(), nulls >= hot_rows).otherwise(F.col("query_id").isin(hot))
        found = _found_at_query(given.filter(~is_hot), shown.filter(~is_hot)).unionByName(
            _found_by_pair(given.filter(is_hot), shown.filter(is_hot))
        )
    else:
        found = _found_at_query(given, shown)
    valid = F.size("selected_image_ids")
    return (
        found.select(*key, F.transform(F.array_sort(F.array_distinct("found")), lambda s: s["image_uuid"]).alias("selected_image_ids"))
        .withColumn("valid_ids", valid)
        .withColumn("accepted", valid.between(MIN_SELECTED, MAX_SELECTED))
    )


def _found_at_query(given: DataFrame, shown: DataFrame) -> DataFrame:
    """submission_id, query_id, completed_at, found (position and id of the ids that are shown, in any order).

    Everything of a query goes to one task, and stays there for what follows by query.
    """
    lists = given.withColumn("shown", F.lit(False))
    singles = shown.select("query_id", F.array("image_uuid").alias("ids"), F.lit(True).alias("shown"))
    met = lists.unionByName(singles, allowMissingColumns=True).repartition("query_id")
    mentioned = met.select(
        "submission_id", "query_id", "completed_at", "shown", F.posexplode_outer("ids").alias("position", "image_uuid")
    )
    any_shown = F.max("shown").over(Window.partitionBy("query_id", "image_uuid"))
    checked = mentioned.withColumn("_found", any_shown).filter(~F.col("shown"))
    # The first id, or the null of an empty list, stands for its submission, found or not.
    needed = checked.filter(F.col("_found") | (F.coalesce("position", F.lit(0)) == 0))
    return _gathered(needed, F.col("_found"))


def _found_by_pair(given: DataFrame, shown: DataFrame) -> DataFrame:
    """The same by a join on query and id: every id moves, but a query is spread over all tasks."""
    mentioned = given.select(
        "submission_id", "query_id", "completed_at", F.posexplode_outer("ids").alias("position", "image_uuid")
    )
    checked = mentioned.join(shown.withColumn("shown", F.lit(True)), ["query_id", "image_uuid"], "left")
    return _gathered(checked, F.col("shown"))


def _gathered(mentioned: DataFrame, found: Column) -> DataFrame:
    entry = F.when(found, F.struct("position", "image_uuid"))
    return mentioned.groupBy("submission_id", "query_id", "completed_at").agg(F.collect_list(entry).alias("found"))


def latest(selections: DataFrame, *newest: str) -> DataFrame:
    """The newest row of each query; newest names the ordering columns, completed_at first."""
    order = Window.partitionBy("query_id").orderBy(*[F.desc(c) for c in newest])
    return selections.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") == 1).drop("_place")


def upsert(selections: DataFrame, validated: DataFrame) -> DataFrame:
    """Stored selections with the accepted submissions put over them; the later completion wins."""
    columns = ["query_id", "selected_image_ids", "completed_at"]
    old = selections.select(*columns, F.lit(None).cast("string").alias("submission_id"))
    new = validated.filter("accepted").select(*columns, F.col("submission_id").cast("string").alias("submission_id"))
    return latest(old.unionByName(new), "completed_at", "submission_id").select(*columns)


def export_rows(queries: DataFrame, candidates: DataFrame, selections: DataFrame) -> DataFrame:
    """Answered queries and their selected candidates, in candidate rank order.

    Answered queries without a matching candidate keep one row with null candidate columns.
    """
    ids = selections.select("query_id", F.explode_outer("selected_image_ids").alias("id"))
    lists = ids.groupBy("query_id").agg(F.collect_set("id").alias("ids"))
    answered = queries.select(
        "query_id",
        "category",
        F.col("image_uuid").alias("query_image_uuid"),
        F.col("image_url").alias("query_image_url"),
    ).join(lists, "query_id")
    columns = [*[c for c in answered.columns if c != "ids"], *[c for c in candidates.columns if c != "query_id"]]
    # Candidates move once, to their query's list.
    chosen = F.array_contains("ids", F.col("image_uuid"))
    return join_unique(answered, candidates, "query_id", "left", only=chosen).select(*columns)


def navigation(queries: DataFrame) -> DataFrame:
    """Previous and next query over all categories in their fixed order, without wrapping.

    Neighbours are found by joining places, not by one window over all queries.
    """
    ordered = numbered(
        queries.select("query_id", "category", text.category_position(F.col("category")).alias("_category")),
        "_category",
        "category",
        "query_id",
        name="place",
    )
    before = ordered.select((F.col("place") + 1).alias("place"), F.col("query_id").alias("previous_query_id"))
    after = ordered.select((F.col("place") - 1).alias("place"), F.col("query_id").alias("next_query_id"))
    return (
        ordered.join(before, "place", "left")
        .join(after, "place", "left")
        .select("place", "category", "query_id", "previous_query_id", "next_query_id")
    )


def totals(items: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: images, categories with queries, queries."""
    counted = items.agg(F.count("*").alias("total_images")).unionByName(
        queries.agg(F.count_distinct("category").alias("categories"), F.count("*").alias("total_queries")),
        allowMissingColumns=True,
    )
    return counted.agg(*[F.sum(c).alias(c) for c in ("total_images", "categories", "total_queries")])
