"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.runtime import stored


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node it is connected with) of every end of a link (a, b).

    Each round takes the smallest label among the neighbours and then the label of that label, so long chains shorten
    by jumps. Joins run on stored tables: a node with a great share of the links is split by Spark's skew handling.
    Links to itself only give a node its own label; no link at all gives an empty table.
    """
    both = stored(
        links.select(F.col("a").alias("here"), F.col("b").alias("there"))
        .union(links.select("b", "a"))
        .distinct(),
        "links",
    )
    labels = stored(both.groupBy(F.col("here").alias("node")).agg(F.min("here").alias("label")), "labels")
    while True:
        seen = both.join(labels, both["here"] == labels["node"]).groupBy("there").agg(F.min("label").alias("seen"))
        lower = stored(
            labels.join(seen, labels["node"] == seen["there"], "left").select(
                "node", F.least("label", "seen").alias("label"), F.col("label").alias("old")
            ),
            "lower",
        )
        target = lower.select(F.col("node").alias("at"), F.col("label").alias("next"))
        jumped = stored(
            lower.join(target, lower["label"] == target["at"]).select("node", F.col("next").alias("label"), "old"),
            "labels",
        )
        labels = jumped.select("node", "label")
        if jumped.filter("label <> old").isEmpty():
            return labels
