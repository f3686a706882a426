"""Components and near links send no table through the driver."""

from pyspark.sql import functions as F

from gridlark.operators import dedup


def plan(df):
    return (df.queryExecution if hasattr(df, "queryExecution") else df._jdf.queryExecution()).toString()


def test_no_broadcast_in_components(spark):
    v = spark.range(60).select(F.col("id").alias("k"), (F.col("id") / 7).cast("long").alias("g"))
    edges = dedup.star_edges(v, "k", "g")
    out = dedup.components(v, edges, "k")
    assert {(x.k, x.component) for x in out.collect()} == {(i, i // 7 * 7) for i in range(60)}
    near = dedup.near_edges(v.select("k", F.array("g").alias("h")), 1, "k", ["h"])
    assert near.count()
    audit = dedup.partition_audit(v.join(dedup.by_shuffle(out), "k").select("component", F.lit("x").alias("sha"), F.lit("A").alias("role")))
    assert [tuple(x) for x in audit.collect()] == [("A", 60, 9, 0, 0)]
    for df in (edges, out, near, audit):
        assert "BroadcastHashJoin" not in plan(df)
