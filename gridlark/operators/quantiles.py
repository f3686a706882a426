"""Exact quantiles of any number of groups in a few passes, without a group's values in one task.

A pass brackets each wanted rank between two quantiles of Spark's sketch, which are off by a known share of the rows at
most, and counts exactly what lies below, on and inside the bounds.  A rank on a bound is settled, so values that fill many
ranks cost nothing.  The next pass looks strictly inside the brackets, some hundred times fewer rows; when a bracket holds
few rows its ranks are read off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: The sketch errs by 1 / ACCURACY of the rows; brackets of at most SMALL rows are sorted.
ACCURACY = 2000
SMALL = 20_000


def exact_quantiles(values: DataFrame, keys: list[str], value: str, shares: list[float], small: int = SMALL, accuracy: int = ACCURACY) -> DataFrame:
    """keys, ``quantiles``: an array with the value at each of ``shares``, between neighbours by proportion, as ``percentile``
    gives it.  Null values do not count; a group of nulls has a row of nulls."""
    rows = written(values.select(*keys, F.col(value).cast("double").alias("_v")), "quantile-rows")
    groups = rows.groupBy(*keys).agg(F.count("_v").alias("_n"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("at")) for i, p in enumerate(shares)])
    spots = written(groups.withColumn("_spot", F.explode(wanted)).select(*keys, "_n", "_spot.i", "_spot.at"), "quantile-spots")
    ranks = spots.where("_n > 0").select(*keys, F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("_rank")).distinct()
    open_ = ranks.select(*keys, "_rank", F.lit(float("-inf")).alias("_lo"), F.lit(float("inf")).alias("_hi"))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    found = None
    while True:
        brackets = open_.groupBy(*keys, "_lo", "_hi").agg(F.collect_set("_rank").alias("_ranks"))  # two ranks a share at most
        on = [*same("r", "b"), F.col("r._v") <= F.col("b._hi")]
        held = rows.where("_v IS NOT NULL").alias("r").join(brackets.alias("b"), on)
        inside = (F.col("r._v") > F.col("b._lo")) & (F.col("r._v") < F.col("b._hi"))
        picked = [F.col(f"b.{c}") for c in (*keys, "_lo", "_hi", "_ranks")]
        counts = {"_below": F.col("r._v") < F.col("b._lo"), "_on": F.col("r._v") == F.col("b._lo"), "_size": inside}
        sizes = written(held.groupBy(*picked).agg(*[F.count_if(c).alias(n) for n, c in counts.items()]), "quantile-brackets")
        each = sizes.withColumn("_rank", F.explode("_ranks")).withColumn("_nth", F.col("_rank") - F.col("_below") - F.col("_on"))
        bounds = each.where("_nth < 0 OR _nth >= _size").select(*keys, "_rank", F.when(F.col("_nth") < 0, F.col("_lo")).otherwise(F.col("_hi")).alias("_v"))
        within = written(each.where("_nth >= 0 AND _nth < _size"), "quantile-ranks")
        short = within.where(F.col("_size") <= small)
        few = held.where(inside).join(short.select(*keys, "_lo", "_hi").distinct().alias("s"), [*same("r", "s"), F.col("b._lo") == F.col("s._lo"), F.col("b._hi") == F.col("s._hi")])
        few = few.groupBy(*[F.col(f"s.{c}") for c in (*keys, "_lo", "_hi")]).agg(F.array_sort(F.collect_list("r._v")).alias("_sorted"))
        meet = lambda x: [*same("e", x), F.col("e._lo") == F.col(f"{x}._lo"), F.col("e._hi") == F.col(f"{x}._hi")]
        read = short.alias("e").join(few.alias("f"), meet("f")).select(*[F.col(f"e.{k}") for k in keys], "_rank", F.get("_sorted", F.col("_nth").cast("int")).alias("_v"))
        done = written(bounds.unionByName(read), "quantile-values")
        found = done if found is None else found.unionByName(done)
        wide = within.where(F.col("_size") > small)
        if wide.isEmpty():
            break
        # the sketch of what is inside, at each rank less and more the error
        sketch = held.where(inside).groupBy(*[F.col(f"b.{c}") for c in (*keys, "_lo", "_hi")]).agg(F.percentile_approx("r._v", [k / accuracy for k in range(accuracy + 1)], 4 * accuracy).alias("_steps"))
        spot = F.col("_nth") * accuracy / F.col("_size")
        bound = lambda x: F.get("_steps", x.cast("int"))
        # beyond the first and the last step the bracket keeps its own bound
        low = F.when(F.floor(spot) - 1 <= 0, F.col("e._lo")).otherwise(bound(F.floor(spot) - 1))
        high = F.when(F.ceil(spot) + 2 >= accuracy, F.col("e._hi")).otherwise(bound(F.ceil(spot) + 2))
        open_ = written(wide.alias("e").join(sketch.alias("k"), meet("k")).select(*[F.col(f"e.{k}") for k in keys], "_rank", low.alias("_lo"), high.alias("_hi")), "quantile-brackets")
    low, high = found.select(*keys, F.col("_rank").alias("_f"), F.col("_v").alias("_a")), found.select(*keys, F.col("_rank").alias("_c"), F.col("_v").alias("_b"))
    placed = spots.alias("x").join(low.alias("l"), [*same("x", "l"), F.floor("at") == F.col("_f")], "left").join(high.alias("h"), [*same("x", "h"), F.ceil("at") == F.col("_c")], "left")
    between = F.when((F.col("_f") == F.col("_c")) | (F.col("_a") == F.col("_b")), F.col("_a")).otherwise((F.col("_c") - F.col("at")) * F.col("_a") + (F.col("at") - F.col("_f")) * F.col("_b"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("i"), between.alias("v"))))
    return placed.groupBy(*[F.col(f"x.{k}") for k in keys]).agg(F.transform(listed, lambda s: s["v"]).alias("quantiles"))


def counted_quantiles(counted: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """keys, ``quantiles`` like ``exact_quantiles``, from a row a distinct value: keys, ``v``, ``n`` (how often it occurs).

    The values are dealt once, in ranges of their order; counts of ranges are carried over, so each rank is read off one row."""
    parts = max(2, int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(counted.where("v IS NOT NULL").select(*keys, "v", "n").repartitionByRange(parts, *keys, "v").withColumn("_b", F.spark_partition_id()), "quantile-ranges")
    above = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ranges = dealt.groupBy(*keys, "_b").agg(F.sum("n").alias("_t"))
    start = ranges.select(*keys, "_b", F.coalesce(F.sum("_t").over(above), F.lit(0)).alias("_t0"), F.sum("_t").over(Window.partitionBy(*keys)).alias("_all"))
    same = lambda a, b, *more: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in (*keys, *more)]
    rows = dealt.alias("r").join(start.alias("s"), same("r", "s", "_b")).select(*[F.col(f"r.{k}") for k in keys], "r._b", "v", "n", "_t0", "_all")
    inside = Window.partitionBy(*keys, "_b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("_to", F.col("_t0") + F.sum("n").over(inside))
    held = lambda rank: (F.col("_to") - F.col("n") <= rank) & (rank < F.col("_to"))
    places = [F.lit(float(p)) * (F.col("_all") - 1) for p in shares]
    read = [F.max(F.when(held(f(at)), F.col("v"))).alias(f"_{side}{i}") for i, at in enumerate(places) for side, f in (("a", F.floor), ("b", F.ceil))]
    found = ends.groupBy(*keys, "_all").agg(*read)
    between = [F.when((F.floor(at) == F.ceil(at)) | (F.col(f"_a{i}") == F.col(f"_b{i}")), F.col(f"_a{i}")).otherwise((F.ceil(at) - at) * F.col(f"_a{i}") + (at - F.floor(at)) * F.col(f"_b{i}")) for i, at in enumerate(places)]
    groups = counted.select(*keys).distinct()
    none = F.array(*[F.lit(None).cast("double") for _ in shares])
    listed = found.select(*keys, F.array(*between).alias("quantiles")).alias("f")
    return groups.alias("g").join(listed, same("g", "f"), "left").select(*[F.col(f"g.{k}") for k in keys], F.coalesce("quantiles", none).alias("quantiles"))
