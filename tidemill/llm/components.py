"""Connected components of an edge table, by labels that move to neighbours and jump to their label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, label (the least node that can be reached). Each round is written to the shared
    folder; the rounds needed grow with the log of the longest path."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        above = labels.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        jumped = moved.join(above, F.col("label") == F.col("up")).select("node", "was", F.least("label", "up_label").alias("label"))
        now = stored(jumped, "labels", done=[labels])
        changed = now.where("label != was").limit(1).count()
        labels = now.select("node", "label")
        labels._scratch = now._scratch
        if not changed:
            discard(both)
            return labels
