"""Connected components of an edge list, by minimum labels and pointer jumping.

Every round is two joins and one partially aggregated minimum, written to the checkpoint folder, so a
lost executor costs one round (the files of a round go when the next one is written); nothing but a count of changes reaches the driver.  A hub's edges are
many rows on one side of a join whose other side has one row per vertex, which adaptive execution
splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, drop_checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of ``edges`` (a, b): the smallest vertex reachable from it."""
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "v").where("u <> v").distinct())
    held = labels = checkpointed(both.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m")).select("v", F.least("v", "m").alias("label")))
    while True:
        nearest = both.join(labels, "v").groupBy(F.col("u").alias("v")).agg(F.min("label").alias("m"))
        stepped = labels.join(nearest, "v").select("v", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        # a label is itself a vertex: take that vertex's label at once, which halves the paths
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("further"))
        jumped = checkpointed(stepped.join(jump, "label").select("v", F.least("label", "further").alias("label"), "old"))
        drop_checkpoint(held)
        held, labels = jumped, jumped.select("v", "label")
        if jumped.where("label <> old").isEmpty():
            drop_checkpoint(both)
            return labels
