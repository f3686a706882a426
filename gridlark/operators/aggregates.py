"""Aggregations: dataset statistics, view features, timing and run summaries."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.shared import written
from .matching import greedy_match, greedy_matches
from .quantiles import counted_quantiles, exact_quantiles

SCORE_LEVELS = (0.10, 0.15, 0.20, 0.25, 0.35, 0.50, 0.70)
#: Degrees of freedom with a tabulated quantile; beyond, the expansion around the normal quantile is as good.
TABULATED = 200


@lru_cache
def t_quantile(dof: int) -> float:
    """The 97.5 % quantile of Student's t: bisection on its distribution, a finite sum of powers of cos(atan(t / sqrt(dof)))."""

    def inside(t: float) -> float:
        angle = math.atan(t / math.sqrt(dof))
        c2, odd = math.cos(angle) ** 2, dof % 2
        term = total = (math.cos(angle) if odd else 1.0) if dof > 1 else 0.0
        for k in range(3 if odd else 2, dof - 1, 2):
            term *= c2 * (k - 1) / k
            total += term
        return 2 / math.pi * (angle + math.sin(angle) * total) if odd else math.sin(angle) * total

    low, high = 0.0, 13.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if inside(mid) < 0.95 else (low, mid)
    return (low + high) / 2


def t_critical(dof: Column) -> Column:
    """The 97.5 % quantile for a column of degrees of freedom; null below 1."""
    table = F.array(*[F.lit(t_quantile(n)) for n in range(1, TABULATED + 1)])
    z, n = 1.959963984540054, dof.cast("double")
    far = F.lit(z) + (z**3 + z) / (4 * n) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * n**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * n**3)
    return F.when((dof >= 1) & (dof <= TABULATED), F.get(table, (dof - 1).cast("int"))).when(dof > TABULATED, far)


def dataset_stats(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """(category_id, size, n) over the rollup of class and size bucket; null stands for all."""
    per = annotations.join(images.select("image_id"), "image_id", "left_semi").select("category_id", G.size_bucket(F.col("w"), F.col("h")).alias("size"))
    return per.rollup("category_id", "size").agg(F.count("*").alias("n"))


def dataset_gaps(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row: images, those without annotations, images that annotations name but the table lacks, and boxes dropped for want of area."""
    named = annotations.groupBy("image_id").agg(F.count("*").alias("boxes"), F.count_if((F.col("w") <= 0) | (F.col("h") <= 0)).alias("flat"))
    known = images.select("image_id").distinct().withColumn("known", F.lit(True))
    both = known.join(named, "image_id", "full")
    return both.agg(
        F.count("known").alias("n_images"), F.count_if(F.col("boxes").isNull()).alias("n_without_annotations"), F.count_if(F.col("known").isNull()).alias("n_orphans"),
        F.coalesce(F.sum("flat"), F.lit(0)).alias("n_dropped"),
    )


def _stats(value: Column, name: str) -> list[Column]:
    z = F.lit(0.0)
    q = F.percentile(value, F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75, 0.9)]))
    return [
        F.coalesce(F.avg(value), z).alias(f"{name}_mean"), F.coalesce(F.stddev_pop(value), z).alias(f"{name}_std"), F.coalesce(F.min(value), z).alias(f"{name}_min"),
        *[F.coalesce(F.get(q, i), z).alias(f"{name}_{n}") for i, n in enumerate(("q25", "q50", "q75", "q90"))], F.coalesce(F.max(value), z).alias(f"{name}_max"),
    ]


def view_features(detections: DataFrame, images: DataFrame, classes: list[int]) -> DataFrame:
    """One row an image, zeros where it has no boxes."""
    b = G.Box.of()
    df = images.select("image_id", "width", "height").join(detections, "image_id", "left")
    w, h = b.width / F.col("width"), b.height / F.col("height")
    cx, cy = (F.col("x1") + F.col("x2")) / (2 * F.col("width")), (F.col("y1") + F.col("y2")) / (2 * F.col("height"))
    n = F.count("score")
    some = F.greatest(n, F.lit(1))
    border = (cx < 0.1) | (cx > 0.9) | (cy < 0.1) | (cy > 0.9)
    out = [n.cast("double").alias("count"), F.log1p(n).alias("log_count"), (n / (F.first("width") * F.first("height") / 1e6)).alias("count_per_megapixel"), *_stats(F.col("score"), "score")]
    for t in SCORE_LEVELS:
        c = F.count_if(F.col("score") >= t)
        out += [c.cast("double").alias(f"count_ge_{round(t * 100)}"), (c / some).alias(f"fraction_ge_{round(t * 100)}")]
    for k in classes:
        c = F.count_if(F.col("category_id") == k)
        out += [c.cast("double").alias(f"class_{k}_count"), (c / some).alias(f"class_{k}_fraction")]
    for name, value in (("area", w * h), ("width", w), ("height", h), ("center_x", cx), ("center_y", cy)):
        out += _stats(value, f"box_{name}")
    out += [
        (F.count_if(border) / some).alias("border_fraction"), (F.abs(F.count_if(cx < 0.5) - F.count_if(cx >= 0.5)) / some).alias("left_right_imbalance"),
        (F.abs(F.count_if(cy < 0.5) - F.count_if(cy >= 0.5)) / some).alias("top_bottom_imbalance"),
    ]
    return df.groupBy("image_id").agg(*out)


CONFIDENCES = (0.25, 0.35, 0.50)


def _hundredths(score: float) -> str:
    return f"{score:.2f}".replace("0.", "")


def unmatched_at(base: DataFrame, scout: DataFrame, pairs: DataFrame, level: float) -> DataFrame:
    """image_id, boxes of ``level`` or better that each view has and the other does not confirm: of the pairs of such boxes with
    IoU 0.5 or more, the best are matched first."""
    met = greedy_match(pairs.where((F.col("iou") >= 0.5) & (F.col("l_score") >= level) & (F.col("r_score") >= level))).groupBy("image_id").agg(F.count("*").alias("m"))
    sides = [df.where(F.col("score") >= level).groupBy("image_id").agg(F.count("*").alias(n)) for df, n in ((base, "b"), (scout, "s"))]
    both = sides[0].join(sides[1], "image_id", "full_outer").join(met, "image_id", "left").fillna(0)
    return both.select("image_id", *[(F.col(x) - F.col("m")).cast("double").alias(f"unmatched_{view}_ge_{_hundredths(level)}") for x, view in (("b", "base"), ("s", "scout"))])


def cross_view_features(base: DataFrame, scout: DataFrame, pairs: DataFrame, images: DataFrame, classes: list[int], confident: bool = False) -> DataFrame:
    """Per image: count and score differences of two views and statistics of their matched boxes at three IoUs; if ``confident``
    also the boxes of three scores that the other view lacks (``unmatched_at``).

    ``pairs`` holds (image_id, left_id, right_id, iou, l_*, r_*) of overlapping boxes, IoU 0.3 or more; they are dealt once for all
    matches.  Best pairs are matched first, so the matches at a greater IoU are those at the least that reach it."""
    scores = CONFIDENCES if confident else ()

    def side(df: DataFrame, p: str) -> DataFrame:
        kinds = [F.count_if(F.col("category_id") == k).alias(f"{p}_c{k}") for k in classes]
        return df.groupBy("image_id").agg(F.count("*").alias(f"{p}_n"), F.sum("score").alias(f"{p}_sum"), *kinds, *[F.count_if(F.col("score") >= s).alias(f"{p}_{i}") for i, s in enumerate(scores)])

    out = images.select("image_id", "width", "height").join(side(base, "b"), "image_id", "left").join(side(scout, "s"), "image_id", "left").fillna(0)
    cols = [
        (F.col("s_n") - F.col("b_n")).cast("double").alias("count_delta"), ((F.col("s_n") + 1) / (F.col("b_n") + 1)).alias("count_ratio"),
        (F.col("s_sum") - F.col("b_sum")).alias("score_sum_delta"), ((F.col("s_sum") + 1e-6) / (F.col("b_sum") + 1e-6)).alias("score_sum_ratio"),
    ]
    for k in classes:
        cols += [(F.col(f"s_c{k}") - F.col(f"b_c{k}")).cast("double").alias(f"class_{k}_delta"), ((F.col(f"s_c{k}") + 1) / (F.col(f"b_c{k}") + 1)).alias(f"class_{k}_ratio")]
    a, b = G.Box.of("l_"), G.Box.of("r_")
    (ax, ay), (bx, by) = a.center, b.center
    area_ratio = F.log(F.greatest(F.lit(1e-12), b.area) / F.greatest(F.lit(1e-12), a.area))
    # what the statistics take of a pair, and no more, goes through the kernel
    slim = pairs.select("image_id", "left_id", "right_id", "iou", "l_score", "r_score", (ax - bx).alias("dx"), (ay - by).alias("dy"), area_ratio.alias("ratio"))
    sure = [(F.col("iou") >= 0.5) & (F.col("l_score") >= s) & (F.col("r_score") >= s) for s in scores]
    m = greedy_matches(slim, [F.col("iou") >= 0.3, *sure]).select("image_id", "iou", (F.col("r_score") - F.col("l_score")).alias("delta"), "dx", "dy", "ratio", "taken")
    m = m.join(images.select("image_id", "width", "height"), "image_id")
    move = F.hypot(F.col("dx") / F.col("width"), F.col("dy") / F.col("height"))
    bit = lambda k: F.col("taken").bitwiseAND(F.lit(1 << k)) > 0
    levels = (0.3, 0.5, 0.7)
    stats = [F.count_if(bit(i + 1)).alias(f"sure_{i}") for i in range(len(scores))]
    for t in levels:
        of, n = (lambda c, t=t: F.when(bit(0) & (F.col("iou") >= t), c)), round(t * 100)
        stats += [
            F.count(of(F.col("iou"))).alias(f"{n}_matches"), F.avg(of(F.col("iou"))).alias(f"{n}_overlap_mean"), F.min(of(F.col("iou"))).alias(f"{n}_overlap_min"),
            F.avg(of(F.col("delta"))).alias(f"{n}_score_delta_mean"), F.avg(of(F.abs("delta"))).alias(f"{n}_score_abs_delta_mean"), F.avg(of(move)).alias(f"{n}_shift_mean"), F.max(of(move)).alias(f"{n}_shift_max"),
            F.avg(of(F.col("ratio"))).alias(f"{n}_log_area_ratio_mean"), F.avg(of(F.abs("ratio"))).alias(f"{n}_log_area_ratio_abs_mean"),
        ]
    met = out.join(m.groupBy("image_id").agg(*stats), "image_id", "left").fillna(0.0)
    for t in (round(x * 100) for x in levels):
        cols += [F.col(f"{t}_{n}").cast("double").alias(f"iou_{t}_{n}") for n in ("matches", "overlap_mean", "overlap_min", "score_delta_mean", "score_abs_delta_mean", "shift_mean", "shift_max", "log_area_ratio_mean", "log_area_ratio_abs_mean")]
        cols += [(F.col("b_n") - F.col(f"{t}_matches")).cast("double").alias(f"iou_{t}_unmatched_base"), (F.col("s_n") - F.col(f"{t}_matches")).cast("double").alias(f"iou_{t}_unmatched_scout")]
        cols += [(F.col(f"{t}_matches") / F.greatest(F.lit(1), F.col("b_n"))).alias(f"iou_{t}_base_fraction"), (F.col(f"{t}_matches") / F.greatest(F.lit(1), F.col("s_n"))).alias(f"iou_{t}_scout_fraction")]
    for i, s in enumerate(scores):
        cols += [(F.col(f"{p}_{i}") - F.col(f"sure_{i}")).cast("double").alias(f"unmatched_{view}_ge_{_hundredths(s)}") for p, view in (("b", "base"), ("s", "scout"))]
    return met.select("image_id", *cols)


def timing_summary(timings: DataFrame, by: str, total: str = "total_ms", load: str | None = None, stages: list[str] | None = None, memory: str | None = None) -> DataFrame:
    """Count, means, spread and frames a second; the mean of each of ``stages`` as ``<stage>_mean`` and the largest ``memory`` as ``peak_memory`` where given."""
    more = [F.avg(s).alias(f"{s}_mean") for s in stages or []] + ([F.max(memory).alias("peak_memory")] if memory else [])
    t = F.col(total)
    own = t - F.col(load) if load else t
    means = timings.groupBy(by).agg(
        F.count("*").alias("n"), F.avg(t).alias("mean_ms"), F.avg(own).alias("mean_without_load_ms"), F.stddev_pop(t).alias("std_ms"), (F.lit(1000.0) / F.avg(t)).alias("fps"), F.max(t).alias("max_ms"), *more
    )
    ranked = exact_quantiles(timings, [by], total, [0.5, 0.95]).select(F.col(by).alias("_by"), F.col("quantiles")[0].alias("p50_ms"), F.col("quantiles")[1].alias("p95_ms"))
    front = ["n", "mean_ms", "mean_without_load_ms", "std_ms", "p50_ms", "p95_ms"]
    joined = means.join(ranked, F.col(by).eqNullSafe(F.col("_by")))
    return joined.select(by, *front, *[c for c in means.columns if c not in (by, *front)])


def repeat_statistics(runs: DataFrame, keys: list[str], value: str, run_id: str) -> DataFrame:
    """Mean and spread over repeats beside every run: an aggregate joined back, so no window holds a whole group."""
    g = runs.groupBy(*keys).agg(F.avg(value).alias(f"{value}_mean"), F.stddev_pop(value).alias(f"{value}_std"), F.count("*").alias("n_repeats"), F.array_join(F.array_sort(F.collect_list(F.col(run_id).cast("string"))), ",").alias("repeat_ids"))
    return runs.join(g, keys)


def gain_cost(df: DataFrame, baseline: str) -> DataFrame:
    """Extra milliseconds and cost for each unit of AP gained over the baseline of the seed; null without a gain."""
    base = df.where(F.col("method") == baseline).select("seed", F.col("ap").alias("base_ap"), F.col("latency_mean_ms").alias("base_ms"), F.col("eic_mean").alias("base_eic"))
    gain = F.col("ap") - F.col("base_ap")
    return df.join(base, "seed").select(
        "method", "seed", "ap", F.when(gain > 0, (F.col("latency_mean_ms") - F.col("base_ms")) / gain).alias("ms_per_ap"), F.when(gain > 0, (F.col("eic_mean") - F.col("base_eic")) / gain).alias("cost_per_ap")
    )


def trajectory_summary(runs: DataFrame, baseline: str, value: str = "ap") -> DataFrame:
    """Per method: mean, sample deviation, range, and the paired difference to the baseline with its t interval."""
    base = runs.where(F.col("method") == baseline).select("seed", F.col(value).alias("base"))
    d = F.col(value) - F.col("base")
    g = runs.join(base, "seed").groupBy("method").agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(d).alias("delta"), F.stddev_samp(d).alias("delta_std")
    )
    half = t_critical(F.col("n") - 1) * F.col("delta_std") / F.sqrt("n")
    return g.withColumn("delta_low", F.col("delta") - half).withColumn("delta_high", F.col("delta") + half)


def threshold_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    out = df.withColumns(checks)
    every = F.lit(True)
    for name in checks:
        every = every & F.col(name)
    return out.withColumn("all_pass", every)


def latency_contrast(timings: DataFrame, baseline: int, band: tuple[float, float] = (0.85, 1.15), ceiling: float = 1.5) -> DataFrame:
    """Chunk means, cycle means, then per model the median of the cycle ratios to the baseline."""
    chunks = timings.groupBy("model_id", "cycle", "chunk").agg(F.avg("total_ms").alias("ms"))
    cycles = chunks.groupBy("model_id", "cycle").agg(F.avg("ms").alias("ms"))
    base = cycles.where(F.col("model_id") == baseline).select("cycle", F.col("ms").alias("base_ms"))
    ratio = F.col("ms") / F.col("base_ms")
    m = cycles.join(base, "cycle").groupBy("model_id").agg(
        F.percentile("ms", 0.5).alias("median_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.percentile(ratio, 0.5).alias("median_ratio"), F.max(ratio).alias("max_ratio")
    )
    return m.withColumn("equivalent", F.col("median_ratio").between(*band)).withColumn("under_ceiling", F.col("max_ratio") <= ceiling)


def latency_ratio_max(timings: DataFrame, baseline: int) -> DataFrame:
    """Mean per view, then the worst ratio to the baseline over views."""
    views = timings.groupBy("model_id", "cycle").agg(F.avg("total_ms").alias("ms"))
    base = views.where(F.col("model_id") == baseline).select("cycle", F.col("ms").alias("base_ms"))
    return views.join(base, "cycle").groupBy("model_id").agg(F.max(F.col("ms") / F.col("base_ms")).alias("worst_ratio"))


def mechanism_images(traits: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Mean scores over the selected regions of each image beside its outcome."""
    g = traits.where("selected").groupBy("image_id").agg(F.avg("d").alias("d_mean"), F.avg("u").alias("u_mean"), F.avg(F.col("d") * F.col("u")).alias("du_mean"), F.count("*").alias("n_regions"))
    return g.join(outcomes, "image_id")


def outcome_summary(df: DataFrame, groups: list[str], delta: str, eps: float = 1e-12) -> DataFrame:
    d = F.col(delta)
    return df.groupBy(*groups).agg(
        F.count("*").alias("n"), F.avg(d).alias("mean_delta"), F.avg(F.when(d > eps, 1.0).otherwise(0.0)).alias("positive_rate"), F.avg(F.when(d < -eps, 1.0).otherwise(0.0)).alias("harm_rate"),
        F.avg(F.when(F.abs(d) <= eps, 1.0).otherwise(0.0)).alias("neutral_rate"),
    )


def delta_vs_reference(df: DataFrame, keys: list[str], reference: Column, value: str) -> DataFrame:
    ref = df.where(reference).select(*keys, F.col(value).alias("reference"))
    return df.join(ref, keys).withColumn("delta", F.col(value) - F.col("reference"))


def allocation_profile(cells: DataFrame, cell: str, coordinate: str, value: str, primary: str, coordinates: list) -> DataFrame:
    """Cells by coordinates, each beside its difference to the primary cell."""
    ref = cells.where(F.col(cell) == primary).select(F.col(coordinate), F.col(value).alias("primary"))
    d = cells.join(ref, coordinate).withColumn("delta", F.col(value) - F.col("primary"))
    return d.groupBy(cell).pivot(coordinate, coordinates).agg(F.round(F.first("delta"), 6))


def coordinate_ranges(cells: DataFrame, axis: list[str], coordinate: str, value: str) -> DataFrame:
    """axis, coordinate, minimum and maximum over the cells of an axis, and the distance between them."""
    return cells.groupBy(*axis, coordinate).agg(F.min(value).alias("minimum"), F.max(value).alias("maximum"), (F.max(value) - F.min(value)).alias("spread"))


def run_rows(runs: DataFrame, timings: DataFrame, selections: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row a run: the columns of ``runs`` (run_id, ap, metrics, baseline_ap, baseline_ms), its timing summary, how much was selected,
    what came of its candidates, and extra milliseconds and cost for each unit of AP gained; null without a gain.

    ``timings``: run_id, total_ms, inference_cost; ``selections``: run_id, image_id, n_regions, area_ratio; ``candidates``: run_id, q, chosen."""
    t = timing_summary(timings, "run_id").select("run_id", F.col("n").alias("n_timed"), "mean_ms", "std_ms", "p50_ms", "p95_ms", "fps")
    cost = timings.groupBy("run_id").agg(F.avg("inference_cost").alias("cost_mean"))
    s = selections.groupBy("run_id").agg(F.avg("n_regions").alias("regions_mean"), F.avg("area_ratio").alias("area_ratio_mean"), F.avg((F.col("n_regions") > 0).cast("double")).alias("active_share"))
    c = candidates.groupBy("run_id").agg(F.count("*").alias("n_candidates"), F.avg("q").alias("q_mean"), F.avg((F.col("q") > 0).cast("double")).alias("useful_share"), F.count_if("chosen").alias("n_chosen"))
    out = runs.join(t, "run_id", "left").join(cost, "run_id", "left").join(s, "run_id", "left").join(c, "run_id", "left").fillna(0, ["n_candidates", "n_chosen"])
    gain = F.col("ap") - F.col("baseline_ap")
    extra = F.col("mean_ms") - F.coalesce("baseline_ms", "mean_ms")
    return out.withColumns({"extra_ms_per_ap": F.when(gain > 0, extra / gain), "extra_cost_per_ap": F.when(gain > 0, (F.col("cost_mean") - 1) / gain)})


def median_mad(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, median and median absolute deviation over all rows.  Rows are read once and counted by value; all else is over distinct values."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])))
    counted = written(long.groupBy("feature", "v").agg(F.count("*").alias("n")), "counted-values")
    med = written(counted_quantiles(counted, ["feature"], [0.5]).select("feature", F.col("quantiles")[0].alias("median")), "medians")
    apart = counted.join(F.broadcast(med), "feature").groupBy("feature", F.abs(F.col("v") - F.col("median")).alias("v")).agg(F.sum("n").alias("n"))  # a row a feature
    mad = counted_quantiles(apart, ["feature"], [0.5]).select("feature", F.col("quantiles")[0].alias("mad"))
    return med.join(mad, "feature")


def metric_long_table(reports: list[DataFrame]) -> DataFrame:
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def timing_rows(images: DataFrame, regions: DataFrame, stages: DataFrame) -> DataFrame:
    """Per image: sum of stage times, calls and cost."""
    area = regions.groupBy("image_id").agg(F.sum((F.col("rx2") - F.col("rx1")) * (F.col("ry2") - F.col("ry1"))).alias("area"), F.count("*").alias("n_crops"))
    ms = stages.groupBy("image_id").agg(F.sum("total_ms").alias("stage_ms"))
    df = images.join(area, "image_id", "left").join(ms, "image_id", "left").fillna(0)
    calls = F.col("n_crops") + 1
    return df.select("image_id", "stage_ms", calls.alias("calls"), G.inference_cost(F.col("area"), F.col("width") * F.col("height"), calls).alias("cost"))


