"""Connected components of a written table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """vertex, component (its smallest vertex) for links ``a``, ``b``: least label of the neighbours, then of the label's own label, until nothing changes."""
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("vertex"), F.least("a", "m").alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(label.withColumnRenamed("vertex", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        lower = label.join(near, F.col("vertex") == F.col("a")).select("vertex", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        lower = staged(lower, "labels")
        up = lower.select(F.col("vertex").alias("v"), F.col("component").alias("further"))
        nxt = staged(lower.join(up, F.col("component") == F.col("v"), "left").select("vertex", "old", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        label = nxt.select("vertex", "component")
        if nxt.where("component <> old").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return label
