"""Joins of box and run tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

SIDES = ("x1", "y1", "x2", "y2")


def iou_join(a: DataFrame, b: DataFrame, threshold: float, a_id: str, b_id: str, same_class: bool = True) -> DataFrame:
    """Pairs of one image (and class) with an IoU of the threshold or more.  An equi-join on image and class; the overlap test is part of the join condition, so pairs that do not touch never leave it."""
    left = a.select(F.col(a_id).alias("left_id"), "image_id", "category_id", *[F.col(c).alias(f"l_{c}") for c in SIDES], *([F.col("score").alias("l_score")] if "score" in a.columns else []))
    right = b.select(F.col(b_id).alias("right_id"), F.col("image_id").alias("r_image"), F.col("category_id").alias("r_category"), *[F.col(c).alias(f"r_{c}") for c in SIDES], *([F.col("score").alias("r_score")] if "score" in b.columns else []))
    on = (F.col("image_id") == F.col("r_image")) & (F.col("l_x1") < F.col("r_x2")) & (F.col("r_x1") < F.col("l_x2")) & (F.col("l_y1") < F.col("r_y2")) & (F.col("r_y1") < F.col("l_y2"))
    if same_class:
        on = on & (F.col("category_id") == F.col("r_category"))
    value = G.iou(G.Box.of("l_"), G.Box.of("r_"))
    return left.join(right, on).withColumn("iou", value).where(F.col("iou") >= threshold).drop("r_image")


def mutual_best(pairs: DataFrame) -> DataFrame:
    """Pairs that are each other's best by IoU, ties by id."""
    a = F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("iou"), "right_id"))
    b = F.row_number().over(Window.partitionBy("right_id").orderBy(F.desc("iou"), "left_id"))
    return pairs.withColumn("ra", a).withColumn("rb", b).where("ra = 1 and rb = 1").drop("ra", "rb")


def point_in_region(boxes: DataFrame, regions: DataFrame, box_id: str) -> DataFrame:
    """The first region (by id) of the image whose half-open core holds the box centre."""
    cx, cy = G.Box.of().center
    pts = boxes.select(F.col(box_id), F.col("image_id").alias("p_image"), cx.alias("cx"), cy.alias("cy"))
    on = (F.col("image_id") == F.col("p_image")) & (F.col("rx1") <= F.col("cx")) & (F.col("cx") < F.col("rx2")) & (F.col("ry1") <= F.col("cy")) & (F.col("cy") < F.col("ry2"))
    return pts.join(regions, on).groupBy(box_id, "p_image").agg(F.min("region_id").alias("region_id")).withColumnRenamed("p_image", "image_id")


def covering_join(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Inner join that fails when either side has a key that the other lacks."""
    left, right = a.withColumn("_l", F.lit(1)), b.withColumn("_r", F.lit(1))
    both = left.join(right, key, "full_outer")
    ok = F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.raise_error(F.lit(f"{key} is not on both sides"))).otherwise(F.lit(True))
    return both.where(ok).drop("_l", "_r")


def restrict_to_images(detections: DataFrame, images: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Evaluated images with their detections; images without any stay."""
    chosen = images.join(evaluated.select("image_id").distinct(), "image_id", "left_semi").select("image_id")
    return chosen.join(detections, "image_id", "left")


def decontaminate(valid: DataFrame, train: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``valid`` that share none of the keys with ``train``: one anti join a key."""
    for k in keys:
        valid = valid.join(train.select(F.col(k).alias("_k")).where("_k is not null").distinct(), F.col(k) == F.col("_k"), "left_anti")
    return valid


def lookup_exactly_one(requests: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Each request with its match and a status: one, none or several."""
    n = table.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("n_found"))
    status = F.when(F.col("n_found").isNull(), "none").when(F.col("n_found") == 1, "one").otherwise("several")
    return requests.join(n, F.col(key) == F.col("_k"), "left").withColumn("status", status).drop("_k")


def paired_runs(runs: DataFrame, cell: list[str], baseline: str, method: str, value: str, equal: list[str] | None = None) -> DataFrame:
    """Both runs of each cell and their difference.  Columns named in ``equal`` (a fingerprint of the weights, of the list of images, ...)
    must not differ inside a pair: that is an error."""
    same = equal or []
    a = runs.where(F.col("method") == baseline).select(*cell, F.col(value).alias("baseline"), F.struct(F.lit(0), *same).alias("_a"))
    b = runs.where(F.col("method") == method).select(*cell, F.col(value).alias("candidate"), F.struct(F.lit(0), *same).alias("_b"))
    fair = F.when(~F.col("_a").eqNullSafe(F.col("_b")), F.raise_error(F.lit(f"paired runs differ in one of {same}"))).otherwise(F.lit(True))
    return a.join(b, cell).where(fair).withColumn("delta", F.col("candidate") - F.col("baseline")).drop("_a", "_b")


def ablation_long(registry: DataFrame, runs: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(axis, level, metric, value): registry rows with an array of levels, expanded and met with the run of each level."""
    flat = registry.select("axis", F.explode("levels").alias("level"))
    met = flat.join(runs, F.col("level") == F.col(key))
    pairs = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])
    return met.select("axis", "level", F.inline(pairs))


def axis_grid(images: DataFrame, kinds: list[str], levels: list[int]) -> DataFrame:
    """Every image under every kind and level: literals exploded beside each row, without a shuffle."""
    return images.select("image_id", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind")).select("image_id", "kind", F.explode(F.array(*[F.lit(x) for x in levels])).alias("severity"))


def as_box(df: DataFrame) -> tuple[Column, ...]:
    return tuple(F.col(c) for c in SIDES)
