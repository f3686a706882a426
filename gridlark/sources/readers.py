"""Sources.  Every schema is explicit; parsers work on DataFrames of lines or documents, so any text source can feed them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COCO = """images array<struct<id: long, file_name: string, width: int, height: int>>,
annotations array<struct<id: long, image_id: long, category_id: int, bbox: array<double>, area: double, iscrowd: int>>,
categories array<struct<id: int, name: string>>"""
PREDICTION = "image_id long, category_id int, bbox array<double>, score double"
# The columns of a timing table, in order.
TIMING = (
    "run_id",
    "image_id",
    "load_ms",
    "base_ms",
    "flip_ms",
    "scoring_ms",
    "crop_ms",
    "enhance_ms",
    "candidate_ms",
    "utility_ms",
    "fusion_ms",
    "total_ms",
    "num_regions",
    "num_candidates",
    "num_calls",
    "num_full_calls",
    "eic",
    "peak_vram_mb",
    "cpu_memory_mb",
)


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations, categories of COCO documents; a document without one of the three lists is an error."""
    doc = spark.read.schema(COCO).json(path, multiLine=True)
    for k in ("images", "annotations", "categories"):
        doc = doc.withColumn(k, F.when(F.col(k).isNull(), F.raise_error(F.lit(f"COCO document without {k}"))).otherwise(F.col(k)))
    return tuple(doc.select(F.inline(k)) for k in ("images", "annotations", "categories"))


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """stem, line of text files."""
    return spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1).alias("stem"), F.col("value").alias("line"))


def parse_csv_boxes(lines: DataFrame) -> DataFrame:
    """Lines of x,y,w,h,score,category,truncation,occlusion: score 0 is ignored, boxes without area are dropped and counted as warnings by ``dropped``."""
    f = F.split(F.regexp_replace("line", r",\s*$", ""), ",")
    v = [F.expr(f"try_cast(trim(get(f, {i})) as double)") for i in range(8)]
    df = lines.withColumn("f", f).select("*", *[c.alias(n) for c, n in zip(v, ("x", "y", "w", "h", "flag", "cat", "truncation", "occlusion"), strict=True)])
    used = df.where("f is not null and flag <> 0")
    return used.select(
        *[c for c in lines.columns if c != "line"], (F.col("cat") - 1).cast("int").alias("category_id"), "x", "y", "w", "h", F.col("truncation").cast("int").alias("truncation"), F.col("occlusion").cast("int").alias("occlusion"), ((F.col("w") <= 0) | (F.col("h") <= 0)).alias("dropped")
    )


def read_csv_boxes_per_image(spark: SparkSession, path: str) -> DataFrame:
    return parse_csv_boxes(lines_of(spark, path)).where("not dropped")


def parse_sequence_boxes(lines: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nine-integer rows (frame, track, x, y, w, h, out, occlusion, category) against the frame list: boxes, and the ignore rows (category 0 or less) apart."""
    names = ("frame_index", "track_id", "x", "y", "w", "h", "out_of_view", "occlusion", "category_id")
    v = [F.expr(f"try_cast(get(split(line, ','), {i}) as int)").alias(n) for i, n in enumerate(names)]
    rows = lines.select("sequence", *v).join(frames, ["sequence", "frame_index"], "left").withColumn("known_frame", F.col("event_id").isNotNull())
    return rows.where("category_id > 0"), rows.where("category_id <= 0")


def parse_obb_labels(lines: DataFrame, names: list[str], ignored: list[str]) -> DataFrame:
    """Lines of class and four normalised corners: hulls, with ``skipped`` for ignored classes."""
    f = F.split(F.trim("line"), r"\s+")
    df = lines.withColumn("f", f).where(F.size("f") == 9)
    xs, ys = (F.array(*[F.expr(f"try_cast(get(f, {i}) as double)") for i in range(k, 9, 2)]) for k in (1, 2))
    name = F.get(F.array(*[F.lit(n) for n in names]), F.expr("try_cast(get(f, 0) as int)"))
    return df.select(*[c for c in lines.columns if c != "line"], name.alias("class_name"), F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"), name.isin(ignored).alias("skipped"))


TRACK = "_id long, _label string, box array<struct<_frame: int, _outside: int, _xtl: double, _ytl: double, _xbr: double, _ybr: double, _rotation: double>>"


def read_track_xml(spark: SparkSession, path: str, first: int, last: int, width: int, height: int) -> DataFrame:
    """Track boxes with an outcome: outside, out of range, empty after rotation, or kept with their hull.  A file that is no single well-formed document is an error."""
    from ..functions import geometry as G

    rows = spark.read.format("xml").option("rowTag", "track").option("mode", "FAILFAST").schema(TRACK).load(path).select(F.col("_id").alias("track_id"), F.col("_label").alias("label"), F.inline("box"))
    b = G.Box(F.col("_xtl"), F.col("_ytl"), F.col("_xbr"), F.col("_ybr"))
    hull = G.rotated_enclosure(b, F.coalesce("_rotation", F.lit(0.0)), F.lit(width), F.lit(height))
    outcome = F.when(F.col("_outside") == 1, "outside").when(~F.col("_frame").between(first, last), "out_of_range").when(hull.x1.isNull(), "empty").otherwise("kept")
    return rows.select("track_id", "label", F.col("_frame").alias("frame_index"), *hull.named(), outcome.alias("outcome"))


FRAME = "image_name string, image_width int, image_height int, bbox array<struct<top: double, left: double, height: double, width: double, class: int>>"


def read_frame_json(spark: SparkSession, path: str, class_map: dict[int, int]) -> DataFrame:
    """One box a row from frame documents, classes mapped exactly; boxes without area are marked."""
    table = F.create_map(*[F.lit(x) for kv in class_map.items() for x in kv])
    rows = spark.read.schema(FRAME).json(path).select("image_name", F.inline("bbox"))
    known = F.try_element_at(table, F.col("class"))
    return rows.select("image_name", F.col("left").alias("x"), F.col("top").alias("y"), F.col("width").alias("w"), F.col("height").alias("h"), F.coalesce(known, F.raise_error(F.lit("class without a mapping")).cast("int")).alias("category_id"), ((F.col("width") <= 0) | (F.col("height") <= 0)).alias("dropped"))


OBJECT = """name string, polygon struct<x1: double, y1: double, x2: double, y2: double, x3: double, y3: double, x4: double, y4: double>,
bndbox struct<xmin: double, ymin: double, xmax: double, ymax: double>, point struct<x: double, y: double>"""


def read_object_xml(spark: SparkSession, path: str, labels: dict[str, int]) -> DataFrame:
    """Objects with exactly one of polygon, bndbox or point; points have no box and are marked unresolvable.  A file that is no single well-formed document is an error."""
    rows = spark.read.format("xml").option("rowTag", "object").option("mode", "FAILFAST").schema(OBJECT).load(path)
    n = sum((F.col(c).isNotNull().cast("int") for c in ("polygon", "bndbox", "point")), F.lit(0))
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    side = {
        "x1": F.coalesce(F.least(*[F.col(f"polygon.x{i}") for i in range(1, 5)]), F.col("bndbox.xmin")), "y1": F.coalesce(F.least(*[F.col(f"polygon.y{i}") for i in range(1, 5)]), F.col("bndbox.ymin")),
        "x2": F.coalesce(F.greatest(*[F.col(f"polygon.x{i}") for i in range(1, 5)]), F.col("bndbox.xmax")), "y2": F.coalesce(F.greatest(*[F.col(f"polygon.y{i}") for i in range(1, 5)]), F.col("bndbox.ymax")),
    }
    status = F.when(n != 1, "ambiguous").when(F.col("point").isNotNull(), "unresolvable").otherwise("box")
    return rows.select("name", F.try_element_at(table, F.col("name")).alias("category_id"), *[c.alias(k) for k, c in side.items()], status.alias("status"))


def read_predictions(spark: SparkSession, path: str, classes: dict[int, int]) -> DataFrame:
    """Box rows of a COCO prediction list; bad geometry and unknown classes are errors."""
    table = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    x, y, w, h = (F.get("bbox", i) for i in range(4))
    cls = F.try_element_at(table, F.col("category_id"))
    ok = (F.size("bbox") == 4) & (w > 0) & (h > 0) & cls.isNotNull()
    df = spark.read.schema(PREDICTION).json(path)
    df = df.where(F.when(~F.coalesce(ok, F.lit(False)), F.raise_error(F.lit("bad prediction row"))).otherwise(F.lit(True)))
    return df.select("image_id", cls.alias("class_id"), "score", x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))


def read_traces(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet where there is any under ``path``, otherwise JSON lines of the same schema.  Only a folder that is not there means no traces."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        raise ValueError(f"no traces under {path}")
    return spark.read.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path) if _has(spark, path, ".parquet") else spark.read.schema(schema).json(path)


def _has(spark: SparkSession, path: str, suffix: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return any(s.getPath().getName().endswith(suffix) for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p))


def file_inventory(spark: SparkSession, path: str, block: int = 1 << 20) -> DataFrame:
    """path, size, sha256 of every file, empty ones too, once each.  Spark lists the files; a task reads each in blocks, so any size will do."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            names, sizes, found = [], [], []
            for uri in batch.column(0).to_pylist():
                where, name = fs.FileSystem.from_uri("file:///" + uri[5:].lstrip("/") if uri.startswith("file:") else uri)
                sha, size = hashlib.sha256(), 0
                with where.open_input_stream(name, compression=None) as stream:  # bytes as they are stored
                    while data := stream.read(block):
                        sha.update(data)
                        size += len(data)
                names.append(unquote(uri))
                sizes.append(size)
                found.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(found, pa.string())], ["path", "size", "sha256"])

    uris = sorted(set(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).inputFiles()))
    files = spark.createDataFrame([(u,) for u in uris], "uri string").repartition(max(1, min(len(uris), 4 * spark.sparkContext.defaultParallelism)))
    return files.mapInArrow(digest, "path string, size long, sha256 string")
