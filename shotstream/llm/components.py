"""Connected components of an edge table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotstream.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); the root is the least node of the component.

    Labels start as the least neighbour and, round by round, take the least label around and then the
    label of their label, until none changes. Every round is stored. Rounds grow with the logarithm of
    the longest path; work per round with the edges. Edges with a null end are left out.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    ways = stored(edges.union(edges.select("b", "a")).distinct(), "ways")
    labels = stored(ways.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "labels")
    while True:
        around = ways.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("least"))
        lower = labels.join(around, F.col("node") == F.col("a")).select(
            "node", F.col("root").alias("old"), F.least("root", "least").alias("root")
        )
        lower = stored(lower, "labels")
        up = lower.select(F.col("node").alias("root"), F.col("root").alias("top"))
        moved = stored(
            lower.join(up, "root", "left").select("node", "old", F.least("root", F.coalesce("top", "root")).alias("root")),
            "labels",
        )
        changed = moved.filter(F.col("root") != F.col("old")).limit(1).count()
        labels = moved.select("node", "root")
        if not changed:
            return labels
