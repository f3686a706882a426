"""Sinks and table updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


def _must(ok: Column, message: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)))


def prediction_rows(df: DataFrame, class_map: dict[int, int]) -> DataFrame:
    """COCO prediction rows; unmapped classes, NaN and boxes without area are errors."""
    table = F.create_map(*[F.lit(x) for kv in class_map.items() for x in kv])
    b = G.Box.of()
    numbers = [F.col(c) for c in ("x1", "y1", "x2", "y2", "score")]
    ok = ~F.exists(F.array(*numbers), lambda v: v.isNull() | F.isnan(v)) & (b.width > 0) & (b.height > 0) & F.try_element_at(table, F.col("category_id")).isNotNull()
    return df.where(_must(ok, "bad prediction")).select("image_id", F.try_element_at(table, F.col("category_id")).alias("category_id"), F.array(*G.xyxy_to_xywh(b)).alias("bbox"), "score")


def write_predictions(df: DataFrame, path: str, class_map: dict[int, int]) -> None:
    prediction_rows(df, class_map).write.json(path)


def write_timings(df: DataFrame, path: str, columns: tuple[str, ...]) -> None:
    """Fixed columns, finite and not negative."""
    ok = F.lit(True)
    for c in columns[2:]:
        ok = ok & (F.col(c) >= 0) & (F.col(c) < F.lit(float("inf"))) & ~F.isnan(F.col(c).cast("double"))
    df.select(*columns).where(_must(ok, "bad timing row")).write.parquet(path)


def yolo_label_lines(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """image_id, text (one line a box, sorted; empty for images without boxes) and counts of outside, clipped and degenerate boxes."""
    df = boxes.join(images.select("image_id", "width", "height"), "image_id")
    b = G.Box.of()
    c = G.clip(b, F.col("width"), F.col("height"))
    cx, cy, w, h = G.normalized(b, F.col("width"), F.col("height"))
    keep = (c.width > 0) & (c.height > 0)
    line = F.when(keep, F.format_string("%d %.8f %.8f %.8f %.8f", F.col("category_id"), cx, cy, w, h))
    moved = G.largest_shift(b, c) > 0
    g = df.groupBy("image_id").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.count_if(moved).alias("outside"), F.count_if(moved & keep).alias("clipped"), F.count_if(~keep).alias("degenerate"))
    text = F.when(F.size("lines") > 0, F.concat(F.array_join("lines", "\n"), F.lit("\n"))).otherwise("")
    return images.select("image_id").join(g.withColumn("text", text).drop("lines"), "image_id", "left").fillna("", ["text"]).fillna(0)


BLOCKS = 256


def assign_coco_ids(df: DataFrame, bucket: str, order: list[str]) -> DataFrame:
    """Dense 1-based ids in the order of (bucket, order), ``bucket`` a number: rows are numbered inside their bucket, buckets inside one of
    ``BLOCKS`` ranges, and the ranges summed up, so that no task sees all buckets."""
    counts = df.groupBy(bucket).count()
    cuts = sorted(set(counts.select(F.col(bucket).cast("double").alias("c")).approxQuantile("c", [i / BLOCKS for i in range(1, BLOCKS)], 1 / BLOCKS)))
    block = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(bucket))) if cuts else F.lit(0)
    blocks = counts.withColumn("_block", block)
    total = blocks.groupBy("_block").agg(F.sum("count").alias("_n"))
    above = total.select("_block", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_above"))  # BLOCKS rows at most
    earlier = F.coalesce(F.sum("count").over(Window.partitionBy("_block").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = blocks.join(F.broadcast(above), "_block").select(F.col(bucket).alias("_b"), (F.col("_above") + earlier).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
    return df.withColumn("_nth", inside).join(before, F.col(bucket) == F.col("_b")).withColumn("coco_id", F.col("_before") + F.col("_nth")).drop("_nth", "_b", "_before")


def composite_id(sequence: Column, frame: Column) -> Column:
    return sequence * 1_000_000 + frame


def _short(number: Column) -> Column:
    """Without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(number, r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")


def metric_table(df: DataFrame, preferred: list[str]) -> DataFrame:
    """Preferred columns first, the rest by name; numbers as text with ten significant digits, non-finite ones empty."""
    names = [c for c in preferred if c in df.columns] + sorted(c for c in df.columns if c not in preferred)
    types = dict(df.dtypes)

    def text(c: str) -> Column:
        if types[c] not in ("double", "float"):
            return F.col(c).cast("string").alias(c)
        v = F.col(c)
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit("")).otherwise(_short(F.format_string("%.10g", v))).alias(c)

    return df.select(*[text(c) for c in names])


def upsert_manifest(old: DataFrame, new: DataFrame, splits: list[str], key: list[str]) -> DataFrame:
    """Old rows of other splits and all new rows; a repeated key is an error."""
    out = old.where(~F.col("source_split").isin(splits)).unionByName(new)
    n = out.groupBy(*key).agg(F.count("*").alias("_n"))
    return out.join(n, key).where(_must(F.col("_n") == 1, "repeated manifest key")).drop("_n")


def replace_prefix(old: DataFrame, new: DataFrame, column: str, prefix: str) -> DataFrame:
    return old.where(~F.col(column).startswith(prefix)).unionByName(new)


def merge_preserving(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows, and the old rows whose key was not made again."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def discover_runs(runs: DataFrame, filters: dict[str, object]) -> DataFrame:
    for field, wanted in filters.items():
        runs = runs.where(F.col(field).isin(wanted) if isinstance(wanted, (list, tuple, set)) else F.col(field) == wanted)
    return runs


def join_run_predictions(a: DataFrame, b: DataFrame, model: str, cover: list[str] | None = None) -> DataFrame:
    """Union of two registries; a model in both is an error, and so is a model that lacks one of the combinations of the columns in ``cover`` that others have."""
    both = a.select(model).distinct().join(b.select(model).distinct(), model, "left_semi")
    if not both.isEmpty():
        raise ValueError("a model is in both registries")
    out = a.unionByName(b)
    if cover:
        cells = out.select(model, *cover).distinct()
        every = cells.select(*cover).distinct().count()
        if not cells.groupBy(model).count().where(F.col("count") < every).isEmpty():
            raise ValueError("a model lacks views or methods that others have")
    return out
