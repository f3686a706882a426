"""Sorting, sampling and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def box_order(tie: str) -> list:
    return [F.desc("score"), F.col("category_id"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col(tie)]


def topk_per_image(df: DataFrame, k: int, tie: str = "det_id") -> DataFrame:
    """The window keeps only its best k rows before the shuffle (Spark's window group limit)."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy(*box_order(tie)))).where(F.col("place") <= k)


def activate_fraction(scores: DataFrame, rate: float) -> DataFrame:
    """The highest round(n * rate) images, one at least; ties by id as text.  Two jobs: a count, then a distributed top-n."""
    n = scores.count()
    return scores.orderBy(F.desc("gate"), F.col("image_id").cast("string")).limit(max(1, round(n * rate)) if n else 0)


def activate_threshold(scores: DataFrame, t: float) -> DataFrame:
    return scores.withColumn("active", F.col("gate") >= t)


def route_outputs(scores: DataFrame, active: DataFrame, bypass: DataFrame) -> DataFrame:
    """Boxes of the active output for active images, of the bypass for the others."""
    on = scores.where("active").select("image_id")
    off = scores.where("not active").select("image_id")
    return active.join(on, "image_id", "left_semi").unionByName(bypass.join(off, "image_id", "left_semi"))


def select_regions(df: DataFrame, value: str, budget: float, most: int) -> DataFrame:
    """Greedy by value within an area budget: an ordered fold over the regions of an image (a small array), in the JVM."""
    ranked = df.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("v"), F.col("region_id").alias("r"), F.col("area_ratio").alias("a")))).alias("rows"))
    zero = F.struct(F.lit(0.0).alias("used"), F.expr("cast(array() as array<int>)").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["ids"]) < most) & (acc["used"] + x["a"] <= budget + 1e-12)
        return F.struct(F.when(fits, acc["used"] + x["a"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["ids"], F.array(x["r"].cast("int")))).otherwise(acc["ids"]).alias("ids"))

    return ranked.select("image_id", F.aggregate("rows", zero, step).alias("s")).select("image_id", F.col("s.ids").alias("selected"), F.col("s.used").alias("used_area"))


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return df.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key).limit(n)


def hash_order(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Position of every row in the order of its hash: range partitions, per-partition counts (one number each to the driver), then offsets."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    hashed = df.withColumn("_h", h)
    # the first 15 bits split the hash space evenly, so buckets are ranges of the order
    bucket = F.shiftright(F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"), 6)
    placed = hashed.withColumn("_b", bucket)
    counts = placed.groupBy("_b").count()
    before = counts.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")  # 1024 buckets at most
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    return placed.join(F.broadcast(before), "_b").withColumn("position", F.col("_before") + inside - 1).drop("_h", "_b", "_before")


def compare_orders(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many rows two orders (key, position) of one set have, how many keys stand at the same position in both and how
    many are displaced, whether both hold the same keys equally often, and whether each key stands once."""
    from ..functions.hashing import fingerprint

    left, right = a.select("position", F.col(key).alias("ka")), b.select("position", F.col(key).alias("kb"))
    places = left.join(right, "position", "full_outer").agg(F.count("ka").alias("n"), F.count_if(F.col("ka") == F.col("kb")).alias("positional_matches"), F.count_if(~F.col("ka").eqNullSafe(F.col("kb"))).alias("displaced"))
    same = fingerprint(a.select(key), [key]).select(F.col("fingerprint").alias("fa")).crossJoin(fingerprint(b.select(key), [key]).select(F.col("fingerprint").alias("fb")))
    once = a.groupBy(key).count().agg((F.coalesce(F.max("count"), F.lit(0)) <= 1).alias("distinct_keys"))
    return places.crossJoin(same).crossJoin(once).select("n", "positional_matches", "displaced", (F.col("fa") == F.col("fb")).alias("same_multiset"), "distinct_keys")  # one row each


def every_nth(frames: DataFrame, k: int) -> DataFrame:
    return frames.where(F.col("frame_index") % k == 0)


def evenly_spaced(frames: DataFrame, start: int, stop: int, n: int) -> DataFrame:
    """Frames start + i * span div (n - 1); both ends are in."""
    if n < 2 or stop - start + 1 < n:
        raise ValueError("cannot take that many distinct frames")
    wanted = [start + i * (stop - start) // (n - 1) for i in range(n)]
    return frames.where(F.col("frame_index").isin(wanted))


def choose_best(candidates: DataFrame, group: list[str]) -> DataFrame:
    """The candidate with the largest q above 0; the earliest round wins ties."""
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("q"), "round"))
    return candidates.where("q > 0").withColumn("nth", nth).where("nth = 1").drop("nth")


def early_stop(candidates: DataFrame, group: list[str], q: float, stability: float, unsupported: float, first: int | None = None) -> DataFrame:
    """Rounds that still run: none after the first one that is good enough (``early_stopped``).  With ``first`` only so many rounds can be."""
    good = (F.col("q") >= q) & (F.col("stability") >= stability) & (F.col("unsupported") <= unsupported)
    if first is not None:
        good = good & (F.col("round") <= first)
    stop = F.min(F.when(good, F.col("round"))).over(Window.partitionBy(*group))
    kept = candidates.withColumn("stop", stop).where("stop is null or round <= stop")
    return kept.withColumn("early_stopped", F.coalesce(F.col("round") == F.col("stop"), F.lit(False))).drop("stop")


def route_operations(components: dict[str, str | None], available: list[str], k: int) -> Column:
    """At most k different operations for the largest components, in their order; ties go by the order of ``components``.
    Components without an available operation are passed over."""
    rows = F.array(*[F.struct((-F.col(c)).alias("v"), F.lit(i).alias("at"), F.lit(op if op in available else None).cast("string").alias("op")) for i, (c, op) in enumerate(components.items())])
    chosen = F.filter(F.transform(F.array_sort(rows), lambda x: x["op"]), lambda op: op.isNotNull())
    return F.slice(F.array_distinct(chosen), 1, k)


def maximin_intervals(cells: DataFrame, cell: str, retention: str, worst: str) -> DataFrame:
    """For each retention breakpoint the feasible cell with the best worst-view value; neighbours with one choice are merged.

    A breakpoint's choice is the best cell of it and all greater ones: a running best over ranges of breakpoints, with the best
    of the ranges above carried in.  A choice once left never comes back, so its breakpoints are neighbours."""
    n = max(2, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rank = F.struct(F.col(worst).isNull().alias("unknown"), (-F.col(worst)).alias("less"), (-F.col(retention)).alias("nearer"), F.col(cell).alias("choice"), F.col(worst).alias("value"))
    points = cells.where(F.col(retention).isNotNull()).groupBy(F.col(retention).alias("point")).agg(F.min(rank).alias("best"))
    ranged = written(points.repartitionByRange(n, F.desc("point")).withColumn("_b", F.spark_partition_id()), "breakpoints")
    above, carried = None, []
    order = lambda b: (b["unknown"], b["less"] or 0, b["nearer"], b["choice"])
    for r in sorted(ranged.groupBy("_b").agg(F.min("best").alias("best")).collect(), key=lambda r: r["_b"]):  # one row a range
        carried.append((r["_b"], above))
        above = r["best"] if above is None else min(r["best"], above, key=order)
    schema = f"_b int, above {ranged.schema['best'].dataType.simpleString()}"
    best = ranged.join(F.broadcast(cells.sparkSession.createDataFrame(carried, schema)), "_b")
    run = Window.partitionBy("_b").orderBy(F.desc("point")).rowsBetween(Window.unboundedPreceding, 0)
    chosen = best.withColumn("best", F.least(F.min("best").over(run), "above"))
    return chosen.groupBy("best").agg(F.min("point").alias("from_point"), F.max("point").alias("to_point"), F.count("*").alias("n_points")).select("best.choice", "best.value", "from_point", "to_point", "n_points")
