"""Ranks, region scores and blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import spread
from . import segments as S

EPSILON = 1e-12
SIDES = ["x1", "y1", "x2", "y2"]


def avg_rank(value: str, keys: list[str]) -> Column:
    """1-based rank, ties share their mean rank."""
    order = Window.partitionBy(*keys).orderBy(value)
    return F.rank().over(order) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2


def rank01(value: str, keys: list[str]) -> Column:
    n = F.count("*").over(Window.partitionBy(*keys))
    return F.when(n == 1, 0.5).otherwise((avg_rank(value, keys) - 1) / (n - 1))


def _clip01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def mixed_normalize(value: str, keys: list[str], mix: float) -> Column:
    """Rank and clipped value mixed; only the clipped value where all values are as good as equal."""
    w = Window.partitionBy(*keys)
    n, first = F.count("*").over(w), F.min(value).over(w)
    spread = F.max(value).over(w) - first
    flat = (n <= 1) | (spread <= 1e-8 + 1e-5 * F.abs(first))
    return F.when(flat, _clip01(F.col(value))).otherwise(mix * rank01(value, keys) + (1 - mix) * _clip01(F.col(value)))


def score_degradation(df: DataFrame, statistics: DataFrame, weights: dict[str, float], mix: float, image: str = "image_id") -> DataFrame:
    """Weighted mix of in-image ranks and calibrated robust scores; ``statistics`` has a row a feature."""
    table = {r["feature"]: (r["median"], r["mad"]) for r in statistics.collect()}  # one row a feature
    total = F.lit(0.0)
    for f, w in weights.items():
        med, mad = table[f]
        z = F.least(F.lit(60.0), F.greatest(F.lit(-60.0), (F.col(f) - med) / (1.4826 * mad + EPSILON)))
        total = total + w * (mix * rank01(f, [image]) + (1 - mix) / (1 + F.exp(-z)))
    return df.withColumn("degradation", _clip01(total))


def class_conflict(boxes: DataFrame, keys: list[str], box_id: str) -> DataFrame:
    """Sum of IoU * sqrt(s1 s2) over pairs of different classes, by the number of such pairs; groups without such pairs have no row.

    Pairs are counted from the sizes of classes; only boxes whose spans in x meet are compared, and no pair becomes a row."""
    per_class = boxes.groupBy(*keys, "category_id").agg(F.count("*").alias("_c"))
    n_pairs = per_class.groupBy(*keys).agg(((F.sum("_c") * F.sum("_c") - F.sum(F.col("_c") * F.col("_c"))) / 2).alias("_pairs")).where("_pairs > 0")
    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema}
    rows = boxes.select(*keys, "category_id", "score", *SIDES)

    def kernel(c: S.Columns, starts: np.ndarray) -> dict:
        group, box, root = S.numbered(starts, len(c["score"])), np.stack([c[s] for s in SIDES], axis=1), np.sqrt(c["score"])
        total = np.zeros(len(starts))
        for i, j in S.touching(group, box, group, box):
            other = (i < j) & (c["category_id"][i] != c["category_id"][j])
            i, j = i[other], j[other]
            total += np.bincount(group[i], S.pair_iou(box[i], box[j]) * root[i] * root[j], len(starts))
        return {k: c[k][starts] for k in keys} | {"_sum": total}

    sums = S.segmented(rows, keys, ["category_id", F.desc("score"), *SIDES], kernel, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", _sum double")
    return n_pairs.join(sums, keys).select(*keys, (F.col("_sum") / (F.col("_pairs") + EPSILON)).alias("class_conflict"))


def score_uncertainty(boxes: DataFrame, regions: DataFrame, weights: dict[str, float], publish: float = 0.25, sigma: float = 0.1, kappa: float = 1e-4, mix: float = 0.5) -> DataFrame:
    """Per region: entropy, closeness to the publishing threshold, class conflict and weak-box density, normalised within the image and weighted.  ``boxes`` carry region_id."""
    s = F.least(F.lit(1 - EPSILON), F.greatest(F.lit(EPSILON), F.col("score")))
    entropy = (-s * F.log(s) - (1 - s) * F.log(1 - s)) / F.log(F.lit(2.0))
    g = boxes.groupBy("image_id", "region_id").agg(
        F.avg(entropy).alias("entropy"), F.avg(F.exp(-F.abs(F.col("score") - publish) / sigma)).alias("proximity"), F.sum(1 - F.col("score")).alias("residual"), F.count("*").alias("candidates")
    )
    area = (F.col("rx2") - F.col("rx1")) * (F.col("ry2") - F.col("ry1"))
    raw = regions.join(g, ["image_id", "region_id"], "left").join(class_conflict(boxes, ["image_id", "region_id"], "det_id"), ["image_id", "region_id"], "left").fillna(0.0, ["entropy", "proximity", "residual", "class_conflict"]).fillna(0, ["candidates"])
    raw = raw.withColumn("density", 1 - F.exp(-F.col("residual") / (kappa * area)))
    raw = spread(raw, regions.count(), "image_id")  # the windows sort every task's rows once a feature, all at the same time
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + w * mixed_normalize(name, ["image_id"], mix)
    return raw.withColumn("uncertainty", _clip01(total))


def combine_scores(df: DataFrame, alpha: float, interaction: float, damping: float) -> DataFrame:
    """Difficulty from degradation and uncertainty; the quarter of regions with the least edges is damped where it has no candidates."""
    w = Window.partitionBy("image_id")
    nth = F.row_number().over(w.orderBy("edge", "region_id"))
    blank = (F.col("candidates") == 0) & (nth <= F.ceil(F.count("*").over(w) * 0.25))
    raw = (alpha * F.col("d") + (1 - alpha) * F.col("u") + interaction * F.col("d") * F.col("u")) / (1 + interaction)
    return df.withColumn("blank", blank).withColumn("difficulty", _clip01(F.when(F.col("blank"), raw * damping).otherwise(raw)))


def make_grid(images: DataFrame, rows: int, cols: int, padding: float = 0.0) -> DataFrame:
    """Cores of a grid with padded crops, one row a cell."""
    cell = images.withColumn("region_id", F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1))))
    r, c = F.floor(F.col("region_id") / cols), F.col("region_id") % cols
    x1, x2 = F.floor(c * F.col("width") / cols), F.floor((c + 1) * F.col("width") / cols)
    y1, y2 = F.floor(r * F.col("height") / rows), F.floor((r + 1) * F.col("height") / rows)
    px, py = F.bround((x2 - x1) * padding).cast("long"), F.bround((y2 - y1) * padding).cast("long")
    zero = F.lit(0).cast("long")
    return cell.select(
        "image_id", "region_id", x1.alias("rx1"), y1.alias("ry1"), x2.alias("rx2"), y2.alias("ry2"),
        F.greatest(zero, x1 - px).alias("cx1"), F.greatest(zero, y1 - py).alias("cy1"), F.least(F.col("width").cast("long"), x2 + px).alias("cx2"), F.least(F.col("height").cast("long"), y2 + py).alias("cy2"),
        ((x2 - x1) * (y2 - y1) / (F.col("width") * F.col("height"))).alias("area_ratio"),
    )


def quantile_bins(df: DataFrame, keys: list[str], value: str, tie: str, k: int) -> DataFrame:
    w = Window.partitionBy(*keys)
    at = F.row_number().over(w.orderBy(value, tie)) - 1
    return df.withColumn("bin", F.least(F.lit(k - 1), F.floor(at * k / F.count("*").over(w)).cast("int")))


def temporal_blocks(frames: DataFrame, k: int) -> DataFrame:
    return frames.withColumn("block", F.ntile(k).over(Window.partitionBy("sequence").orderBy("frame_index")))


def panel_labels(df: DataFrame, panel: str, order: list[str], prefix: str = "V") -> DataFrame:
    n = F.row_number().over(Window.partitionBy(panel).orderBy(*order))
    return df.withColumn("label", F.concat(F.lit(prefix), F.lpad(n.cast("string"), 2, "0")))
