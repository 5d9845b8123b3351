"""Joins that stay even when one key holds a large share of the rows, and broadcasts of checked size."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# At most this many keys are treated apart; every other key then holds less than 1/HOT_KEYS of the rows.
HOT_KEYS = 1000
# A key with fewer rows needs no treatment.
HOT_ROWS = 1_000_000
# Keys that a task counts at once when it looks for the largest.
TRACKED_KEYS = 10_000
# Groups that are named in the scan's filter; more are joined.
LISTED_GROUPS = 1000


# Tables of at most this many narrow rows are sent to every task.
SENT_ROWS = 500_000


def sent_if_small(df: DataFrame, rows: int | None) -> DataFrame:
    """df marked for broadcast when its row count, or a proven bound of it, is small."""
    return F.broadcast(df) if rows is not None and rows <= SENT_ROWS else df


def of_groups(items: DataFrame, groups: list) -> DataFrame:
    """Items of the groups: by a list in the scan if there are few, by a join of checked size otherwise."""
    if len(groups) <= LISTED_GROUPS:
        return items.filter(F.col("group").isin(groups))
    shape = T.StructType([T.StructField("group", items.schema["group"].dataType)])
    wanted = items.sparkSession.createDataFrame([(g,) for g in groups], shape)
    return items.join(sent_if_small(wanted, len(groups)), "group", "left_semi")


def hot_keys(df: DataFrame, key: str, min_rows: int = HOT_ROWS) -> list:
    """The keys with at least min_rows rows, among the HOT_KEYS largest, by a summary of bounded size.

    Tasks count in sketches of TRACKED_KEYS entries, which are merged: the keys are read once and nothing is shuffled by key.
    A key that a sketch does not hold has less than about 1/TRACKED_KEYS of all rows.
    """
    return hot_keys_and_nulls(df, key, min_rows)[0]


def hot_keys_and_nulls(df: DataFrame, key: str, min_rows: int = HOT_ROWS) -> tuple[list, int]:
    """hot_keys, and the number of rows without a key, found in the same reading."""
    sketch = F.expr(f"approx_top_k(`{key}`, {HOT_KEYS}, {TRACKED_KEYS}) FILTER (WHERE `{key}` IS NOT NULL)")
    found = df.agg(sketch.alias("keys"), F.count_if(F.col(key).isNull()).alias("nulls")).first()
    return [r["item"] for r in found["keys"] or [] if r["count"] >= min_rows], found["nulls"]


def join_unique(
    one: DataFrame,
    many: DataFrame,
    key: str,
    how: str = "inner",
    min_rows: int = HOT_ROWS,
    base: DataFrame | None = None,
    only: Column | None = None,
) -> DataFrame:
    """one, with one row per key, joined with many. how: inner, or left to keep the rows of one alone.

    Rows of the hot keys meet their at most HOT_KEYS partners by broadcast and are not shuffled; all other
    keys are joined as usual. For use where one side is an aggregate or a join, since Spark's own skew
    handling needs plain shuffles on both sides. base: a table that has at least as many rows of every key as many has, to look
    for hot keys in; many itself would be computed once more for it. only: a condition on columns of both besides the key.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be 'inner' or 'left', not {how!r}")
    hot = hot_keys(many if base is None else base, key, min_rows)

    def joined(some: DataFrame, partners: DataFrame, how: str) -> DataFrame:
        if only is None:
            return some.join(partners, key, how)
        keyed = partners.withColumnRenamed(key, "_key")
        return some.join(keyed, (F.col(key) == F.col("_key")) & only, how).drop("_key")

    if not hot:
        return joined(one, many, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = F.broadcast(one.filter(is_hot))
    cold = joined(one.filter(~is_hot), many.filter(~is_hot), how)
    met = joined(few, many.filter(is_hot), "inner")
    if how == "left" and (base is not None or only is not None):
        # A hot key may have no row in many that is wanted: its row of one stands alone.
        have = met if only is not None else many.filter(is_hot)
        alone = few.join(have.select(key).distinct(), key, "left_anti")
        cold = cold.unionByName(alone, allowMissingColumns=True)
    return cold.unionByName(met)
