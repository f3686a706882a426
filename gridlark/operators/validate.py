"""Filters, predicates and validation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

TOLERANCE = 1e-6


def publish_filter(df: DataFrame, floor: float) -> DataFrame:
    return df.where(F.col("score") >= floor)


def valid_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    finite = [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))) for c in (x, y, w, h)]
    return finite[0] & finite[1] & finite[2] & finite[3] & (w > 0) & (h > 0) & (x >= 0) & (y >= 0)


def validate_annotations(images: DataFrame, annotations: DataFrame, categories: list[int], lenient: bool = False) -> DataFrame:
    """ann_id and one outcome a row; later rows of a repeated box are duplicates.  Two hash joins at most: categories are a literal list."""
    known = images.select(F.col("image_id").alias("img"), "width", "height")
    df = annotations.join(known, F.col("image_id") == F.col("img"), "left")
    x, y, w, h = (F.col(c) for c in "xywh")
    finite = valid_box(F.abs(x), F.abs(y), F.lit(1.0), F.lit(1.0)) & valid_box(F.lit(0.0), F.lit(0.0), F.abs(w) + 1, F.abs(h) + 1)
    outside = (x + w > F.col("width") + TOLERANCE) | (y + h > F.col("height") + TOLERANCE)
    gone = (x >= F.col("width")) | (y >= F.col("height"))
    nth = F.row_number().over(Window.partitionBy("image_id", "category_id", "x", "y", "w", "h").orderBy("ann_id"))
    if lenient:
        beyond = F.when(outside & gone, "outside_dropped").when(outside, "clipped")
    else:
        beyond = F.when(outside, "out_of_bounds")
    outcome = (
        F.when(F.col("img").isNull(), "unknown_image")
        .when(~F.col("category_id").isin(categories), "unknown_category")
        .when(~finite, "non_finite")
        .when((x < -TOLERANCE) | (y < -TOLERANCE), "negative_origin")
        .when((w <= 0) | (h <= 0), "non_positive")
    )
    return df.withColumn("outcome", F.coalesce(outcome, beyond, F.when(nth > 1, "duplicate"), F.lit("valid"))).select("ann_id", "outcome")


def dedup_boxes(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """First annotation of each (image, category, clipped box)."""
    sized = annotations.join(images.select("image_id", "width", "height"), "image_id")
    c = G.clip(G.xywh_to_xyxy(*(F.col(n) for n in "xywh")), F.col("width"), F.col("height"))
    keyed = sized.select(*annotations.columns, *c.named("c_"))
    first = F.row_number().over(Window.partitionBy("image_id", "category_id", "c_x1", "c_y1", "c_x2", "c_y2").orderBy("ann_id"))
    return keyed.withColumn("nth", first).where("nth = 1").select(*annotations.columns)


def size_mismatch(df: DataFrame) -> DataFrame:
    """Declared against actual sizes: equal, swapped (and corrected) or error."""
    equal = (F.col("width") == F.col("actual_width")) & (F.col("height") == F.col("actual_height"))
    swapped = (F.col("width") == F.col("actual_height")) & (F.col("height") == F.col("actual_width"))
    return df.withColumn("size_status", F.when(equal, "equal").when(swapped, "swapped").otherwise("error"))


def pairing_coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    left, right = a.select(F.col(key).alias("a")).distinct(), b.select(F.col(key).alias("b")).distinct()
    both = left.join(right, F.col("a") == F.col("b"), "full_outer")
    paired = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
    return both.agg(
        F.count("a").alias("n_left"), F.count("b").alias("n_right"), paired.alias("paired"), F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"),
        F.round(paired / F.count("*"), 9).alias("coverage"),
    )


def frame_gaps(frames: DataFrame, every: int = 1) -> DataFrame:
    """Per sequence: frames, gaps in 1..n and frames off the sampling rule."""
    last = F.lag("frame_index").over(Window.partitionBy("sequence").orderBy("frame_index"))
    return frames.withColumn("step", F.col("frame_index") - F.coalesce(last, F.lit(0))).groupBy("sequence").agg(
        F.count("*").alias("n_frames"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"), F.count_if(F.col("step") != 1).alias("gaps"), F.count_if(F.col("frame_index") % every != 0).alias("off_rule")
    )


def group_completeness(df: DataFrame, group: str, kind: str, required: list[str]) -> DataFrame:
    kinds = F.array_sort(F.collect_set(kind))
    return df.groupBy(group).agg((kinds == F.array(*[F.lit(r) for r in sorted(required)])).alias("complete"), F.array_join(kinds, ",").alias("kinds"))


def cell_coverage(df: DataFrame, axes: list[str]) -> DataFrame:
    """Cells of the cross product of all axis values that are missing or occur more than once."""
    grid = None
    for a in axes:  # each axis holds a few registered values
        values = df.select(a).distinct()
        grid = values if grid is None else grid.crossJoin(values)
    counts = df.groupBy(*axes).agg(F.count("*").alias("n"))
    full = grid.join(counts, axes, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.where("n <> 1").select(*axes, F.when(F.col("n") == 0, "missing").otherwise("duplicate").alias("problem"), F.col("n").cast("long").alias("n"))


def validate_detections(detections: DataFrame, images: DataFrame, classes: list[int]) -> DataFrame:
    """det_id and the first problem of each row, with missing images, images listed twice and repeated det_ids of an image as rows of their own (det_id null but for the last)."""
    img = images.select(F.col("image_id").alias("img"), "width", "height").dropDuplicates(["img"])
    df = detections.join(img, F.col("image_id") == F.col("img"), "left")
    numbers = [F.col(c) for c in ("x1", "y1", "x2", "y2", "score")]
    bad = F.exists(F.array(*numbers), lambda v: v.isNull() | F.isnan(v))
    problem = (
        F.when(F.col("img").isNull(), "unknown_image")
        .when(bad, "not_a_number")
        .when((F.col("x1") < 0) | (F.col("y1") < 0) | (F.col("x2") > F.col("width")) | (F.col("y2") > F.col("height")) | (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1")), "outside_image")
        .when((F.col("score") < 0) | (F.col("score") > 1), "score_range")
        .when(~F.col("category_id").isin(classes), "class_range")
    )
    rows = df.withColumn("problem", problem).where("problem is not null").select("image_id", F.col("det_id").cast("long").alias("det_id"), "problem")
    absent = images.join(detections.select("image_id").distinct(), "image_id", "left_anti").select("image_id", F.lit(None).cast("long").alias("det_id"), F.lit("missing_image").alias("problem"))
    twice = images.groupBy("image_id").agg(F.count("*").alias("n")).where("n > 1").select("image_id", F.lit(None).cast("long").alias("det_id"), F.lit("duplicate_image").alias("problem"))
    again = detections.groupBy("image_id", F.col("det_id").cast("long").alias("det_id")).agg(F.count("*").alias("n")).where("n > 1").select("image_id", "det_id", F.lit("duplicate_row").alias("problem"))
    return rows.unionByName(absent).unionByName(twice).unionByName(again)


def compare_sources(a: DataFrame, b: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """How keys relate: same, changed, only left, only right."""
    from ..functions.hashing import row_hash

    left, right = a.select(F.col(key).alias("ka"), row_hash(payload).alias("ha")), b.select(F.col(key).alias("kb"), row_hash(payload).alias("hb"))
    status = F.when(F.col("kb").isNull(), "only_left").when(F.col("ka").isNull(), "only_right").when(F.col("ha") == F.col("hb"), "same").otherwise("changed")
    return left.join(right, F.col("ka") == F.col("kb"), "full_outer").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def compare_by_kind(a: DataFrame, b: DataFrame, key: list[str], kind: str, payload: list[str]) -> DataFrame:
    """kind, keys of each status, and rows of each side: whether two sources of several kinds of rows are the same."""
    from ..functions.hashing import row_hash

    parts = [F.sum(F.conv(F.substring("h", 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    rows = [df.select(*key, kind, row_hash(payload).alias("h")) for df in (a, b)]
    # a key may have any number of rows: its payload is their number and the sums of their hashes, in whatever order they come
    sides = [df.groupBy(*key, kind).agg(F.count("*").alias("n"), *parts).select(*key, kind, F.struct("n", *[f"s{k}" for k in range(4)]).alias(f"h{i}"), F.col("n").alias(f"n{i}")) for i, df in enumerate(rows)]
    met = sides[0].join(sides[1], [*key, kind], "full_outer")
    return met.groupBy(kind).agg(
        F.count_if(F.col("h0") == F.col("h1")).alias("same"), F.count_if(F.col("h0") != F.col("h1")).alias("changed"), F.count_if(F.col("h1").isNull()).alias("only_left"), F.count_if(F.col("h0").isNull()).alias("only_right"),
        F.coalesce(F.sum("n0"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("n1"), F.lit(0)).alias("right_rows"),
    )


def category_check(df: DataFrame, expected: list[int], column: str = "category_id") -> DataFrame:
    """One row: the classes seen, those expected and not seen, those seen and not expected, and whether both sets are one."""
    seen = df.agg(F.array_sort(F.collect_set(column)).alias("observed"))
    want = F.array(*[F.lit(int(x)) for x in sorted(expected)]).cast("array<int>")
    have = F.col("observed").cast("array<int>")
    return seen.select(have.alias("observed"), F.array_except(want, have).alias("missing"), F.array_except(have, want).alias("unexpected"), (F.size(F.array_except(want, have)) + F.size(F.array_except(have, want)) == 0).alias("complete"))


def tables_identical(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of either table that the other lacks."""
    left = a.exceptAll(b).agg(F.count("*").alias("only_left"))
    return left.crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_right"))).withColumn("identical", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def accept_runs(runs: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Each run with the first rule that it breaks (null: accepted)."""
    reason = F.coalesce(*[F.when(~ok, name) for name, ok in rules], F.lit(None).cast("string"))
    return runs.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


# The files that a finished run has, the fields that its configuration has, the splits that must not be tuned on.
RUN_MARKER = "SUCCESS"
RUN_ARTIFACTS = ["config_resolved.yaml", "data_manifest.json", "model_fingerprint.json", "metrics.json", "metrics_provenance.json", "predictions/final.coco.json"]
RUN_FIELDS = ["dataset_name", "dataset_split", "detector_name", "detector_max_det", "method_name", "experiment_name", "runtime_tune"]
RUN_HASHES = {"metrics_sha256": "metrics.json", "prediction_sha256": "predictions/final.coco.json", "config_sha256": "config_resolved.yaml"}
TEST_SPLITS = ["test", "test-dev", "rddts"]


def run_evidence(runs: DataFrame, artifacts: DataFrame, provenance: DataFrame, manifest: DataFrame, timings: DataFrame) -> DataFrame:
    """Each run beside what its files, hashes, images and timing rows say.

    ``runs``: run_id, the fields of ``RUN_FIELDS``, images_evaluated, model_sha256, annotation_sha256 (of the manifest; null: none);
    ``artifacts``: run_id, path, sha256 of the files found; ``provenance``: run_id, the hashes of ``RUN_HASHES``, annotation_sha256;
    ``manifest``: run_id, image_id; ``timings``: run_id (whose folder), row_run_id (what the row says)."""
    found = artifacts.groupBy("run_id").agg(F.collect_set("path").alias("paths"), F.map_from_entries(F.collect_set(F.struct("path", "sha256"))).alias("hashes"))  # a handful of files a run
    claims = provenance.select("run_id", *[F.col(h).alias(f"claimed_{h}") for h in (*RUN_HASHES, "annotation_sha256")])
    images = manifest.groupBy("run_id").agg(F.count("*").alias("n_images"))
    rows = timings.groupBy("run_id").agg(F.count("*").alias("n_timed"), F.count_if(~F.col("row_run_id").eqNullSafe(F.col("run_id"))).alias("n_foreign"))
    out = runs
    for more in (found, claims, images, rows):
        out = out.join(more, "run_id", "left")
    return out.fillna(0, ["n_images", "n_timed", "n_foreign"])


def run_rules() -> list[tuple[str, Column]]:
    """Rules of ``accept_runs`` over ``run_evidence``, in the order in which they are reported."""
    has = lambda path: F.coalesce(F.array_contains("paths", path), F.lit(False))
    every = F.lit(True)
    for path in RUN_ARTIFACTS:
        every = every & has(path)
    fields = F.lit(True)
    for name in RUN_FIELDS:
        fields = fields & F.col(name).isNotNull()
    split = F.lower("dataset_split")
    tuned_test = (split.isin(TEST_SPLITS) | split.startswith("test-")) & F.col("runtime_tune")
    proven = [(name, F.coalesce(F.col(f"claimed_{name}") == F.col("hashes")[path], F.lit(False))) for name, path in RUN_HASHES.items()]
    return [
        ("no success marker", has(RUN_MARKER)), ("missing artifact", every), ("missing configuration field", fields), ("tuned on a test split", ~F.coalesce(tuned_test, F.lit(False))), *proven,
        ("no images", F.col("n_images") > 0), ("annotation_sha256", F.coalesce(F.col("annotation_sha256") == F.col("claimed_annotation_sha256"), F.lit(False))),
        ("model fingerprint", F.coalesce(F.length("model_sha256") == 64, F.lit(False))), ("timing rows", F.col("n_timed") == F.col("n_images")), ("foreign timing rows", F.col("n_foreign") == 0),
        ("evaluated images", F.coalesce(F.col("images_evaluated") == F.col("n_images"), F.lit(False))),
    ]


def fair_group(runs: DataFrame, group: str, hashes: list[str]) -> DataFrame:
    fair = [F.count_distinct(h) == 1 for h in hashes]
    out = fair[0]
    for f in fair[1:]:
        out = out & f
    return runs.groupBy(group).agg(out.alias("fair"), *[F.count_distinct(h).alias(f"n_{h}") for h in hashes])


def verify_manifest(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """path and status of each manifest row against the files that exist."""
    have = inventory.select(F.col("path").alias("p"), F.col("size").alias("have_size"), F.col("sha256").alias("have_sha"))
    status = F.when(F.col("p").isNull(), "missing").when(F.col("size") != F.col("have_size"), "size").when(F.col("sha256") != F.col("have_sha"), "hash").otherwise("ok")
    return manifest.join(have, F.col("path") == F.col("p"), "left").select("path", status.alias("status"))


def anchor_check(df: DataFrame, value: str, anchor: str, tolerance: float) -> DataFrame:
    return df.withColumn("within", F.abs(F.col(value) - F.col(anchor)) <= tolerance)
