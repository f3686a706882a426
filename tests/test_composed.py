"""Composed operators, selection and pixel jobs against plain versions of their rules."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.operators import images, select
from gridlark.plans import pipelines
from gridlark.sources import readers

from test_segments import by_image, got, iou, nms, said, some, table

WIDTH = 40.0
ORDER = lambda x: (*x.best_first(), x.source, x.det)


def plain(df):
    return df.select("image_id", "det_id", "category_id", "score", "x1", "y1", "x2", "y2")


def parts(rows, *names):
    return [[x for x in rows if x.source == n] for n in names]


def sizes(spark, n=40):
    return spark.range(n).select(F.col("id").alias("image_id"), F.lit(40).alias("width"), F.lit(30).alias("height"))


def test_flip_merge(spark):
    rows = some(11, sources=("base", "flip"))
    base, flip = parts(rows, "base", "flip")
    want = []
    for x in flip:
        x.box = (WIDTH - x.box[2], x.box[1], WIDTH - x.box[0], x.box[3])
    for g in by_image(rows):
        want += [x for x in nms(sorted(g, key=ORDER), lambda v: v > 0.5, 300) if x.score >= 0.25]
    mirrored = plain(table(spark, flip)).withColumns({"x1": F.lit(WIDTH) - F.col("x2"), "x2": F.lit(WIDTH) - F.col("x1")})
    out = pipelines.flip_merge(plain(table(spark, base)), mirrored, sizes(spark), 0.5, 0.25)
    assert got(out) == said((x.image, x.cls, x.score, x.box, x.source) for x in want)


@pytest.mark.parametrize("method", ["hard_nms", "wbf"])
def test_candidate_banks(spark, method):
    """Banks become local boxes; images without any pass the threshold only."""
    rows = [x for x in some(12) if not (x.source == "local" and x.image < 10)]
    base, local = parts(rows, "base", "local")
    full = table(spark, local).drop("source")
    banks = [full.where("det_id % 2 = 0"), full.where("det_id % 2 = 1")]
    options = {"threshold": 0.5, "max_det": 5} | ({"probe": 0.05, "base_weight": 1.0, "low": 0.5, "high": 1.5} if method == "wbf" else {})
    out = pipelines.candidate_bank_fuse(plain(table(spark, base)), banks, method, 0.25, **options)
    crops = {x.image for x in local}
    alone = said((x.image, x.cls, x.score, x.box, "base") for x in base if x.image not in crops and x.score >= 0.25)
    assert [r for r in got(out) if r[0] not in crops] == alone and alone
    if method == "hard_nms":
        want = []
        for g in by_image([x for x in rows if x.image in crops]):
            want += nms(sorted((x for x in g if x.score >= 0.25), key=ORDER), lambda v: v >= 0.5, 5)
        assert [r for r in got(out) if r[0] in crops] == said((x.image, x.cls, x.score, x.box, x.source) for x in want)


def test_guarded_share_of_images(spark):
    """The most uncertain share gets the merged views, the others their published base boxes."""
    rows = some(13, sources=("base", "flip", "local"))
    base, flip, local = parts(rows, "base", "flip", "local")
    regions = sizes(spark).select("image_id", F.lit(0).alias("region_id"), *[F.lit(v).alias(c) for c, v in (("rx1", 0), ("ry1", 0), ("rx2", 40), ("ry2", 30))])
    weights = {"entropy": 0.4, "proximity": 0.3, "class_conflict": 0.2, "density": 0.1}
    crop = table(spark, local).drop("source").withColumn("region_id", F.lit(0))
    gate = {x.image_id: x.gate for x in pipelines.image_gate(crop, regions, weights).collect()}
    out = pipelines.guarded_fusion(plain(table(spark, base)), plain(table(spark, flip)), crop, regions, sizes(spark), weights, 0.3, consensus=False)
    on = {x.image_id for x in select.activate_fraction(pipelines.image_gate(crop, regions, weights), 0.3).select("image_id").collect()}
    assert len(on) == round(0.3 * len(gate)) and min(gate[i] for i in on) >= max(v for i, v in gate.items() if i not in on)
    for x in flip:
        x.box = (WIDTH - x.box[2], x.box[1], WIDTH - x.box[0], x.box[3])
    want = [x for x in base if x.image not in on and x.score >= 0.25]
    for g in by_image([x for x in rows if x.image in on]):
        want += [x for x in nms(sorted(g, key=ORDER), lambda v: v > 0.7, 300) if x.score >= 0.25]
    assert got(out) == said((x.image, x.cls, x.score, x.box, x.source) for x in want)


@pytest.mark.parametrize("seed", range(3))
def test_regions_within_a_budget(spark, seed):
    r = random.Random(seed)
    rows = [(i, k, r.choice([0.1, 0.5, r.random()]), r.choice([0.05, 0.1, 0.2, 0.3])) for i in range(30) for k in range(r.randint(1, 9))]
    df = spark.createDataFrame(rows, "image_id long, region_id int, value double, area_ratio double").repartition(3)
    want = {}
    for i in range(30):
        ids, used = [], 0.0
        for _, k, _, area in sorted((x for x in rows if x[0] == i), key=lambda x: (-x[2], x[1])):
            if len(ids) < 3 and used + area <= 0.4 + 1e-12:
                ids.append(k)
                used += area
        want[i] = (ids, used)
    assert {x.image_id: (x.selected, x.used_area) for x in select.select_regions(df, "value", 0.4, 3).collect()} == want


def pixel_rows(spark, seed):
    r = np.random.default_rng(seed)
    made = {i: r.integers(200, 256, (int(r.integers(8, 20)), int(r.integers(8, 20)), 3)).astype(np.uint8) for i in range(6)}
    rows = [(i, a.shape[0], a.shape[1], bytearray(a.tobytes())) for i, a in made.items()]
    return made, spark.createDataFrame(rows, "image_id long, height int, width int, data binary")


def test_border_statistics(spark):
    made, df = pixel_rows(spark, 1)
    got_ = {x.image_id: (x.border_mean, x.white_fraction) for x in images.border_stats(df, 2, white=230).collect()}
    for i, a in made.items():
        h, w, _ = a.shape
        edge = [a[y, x] for y in range(h) for x in range(w) if y < 2 or x < 2 or y >= h - 2 or x >= w - 2]
        assert got_[i][0] == pytest.approx(np.mean(edge)) and got_[i][1] == pytest.approx(np.mean([all(p >= 230) for p in edge]))


def test_a_users_image_operation(spark):
    import hashlib

    made, df = pixel_rows(spark, 2)
    out = images.enhanced_views(df, {"invert": 0.0}, {"invert": lambda image, value, seed: 255 - image}).collect()
    assert {x.image_id: x.output_sha256 for x in out} == {i: hashlib.sha256((255 - a).astype(np.uint8).tobytes()).hexdigest() for i, a in made.items()}


def test_traces_that_are_not_there_and_those_that_are_wrong(spark, tmp_path):
    with pytest.raises(ValueError, match="no traces"):
        readers.read_traces(spark, str(tmp_path / "none"), "a int")
    with pytest.raises(Exception) as e:
        readers.read_traces(spark, str(tmp_path), "a no_such_type")
    assert "no traces" not in str(e.value)


def test_tracks_and_objects(spark, tmp_path):
    (tmp_path / "t.xml").write_text('<a><track id="4" label="car"><box frame="1" outside="0" xtl="10" ytl="20" xbr="50" ybr="60" rotation="90"/><box frame="2" outside="1" xtl="1" ytl="1" xbr="2" ybr="2"/><box frame="9" outside="0" xtl="1" ytl="1" xbr="2" ybr="2"/></track></a>')
    rows = {x.frame_index: x for x in readers.read_track_xml(spark, str(tmp_path / "t.xml"), 1, 5, 100, 100).collect()}
    assert [rows[k].outcome for k in (1, 2, 9)] == ["kept", "outside", "out_of_range"]
    assert [round(v, 6) for v in (rows[1].x1, rows[1].y1, rows[1].x2, rows[1].y2)] == [10.0, 20.0, 50.0, 60.0]  # a square turned by 90 degrees
    (tmp_path / "o.xml").write_text("<a><object><name>car</name><polygon><x1>3</x1><y1>9</y1><x2>1</x2><y2>2</y2><x3>8</x3><y3>4</y3><x4>5</x4><y4>7</y4></polygon></object><object><name>bus</name><point><x>1</x><y>2</y></point></object><object><name>car</name><point><x>1</x><y>2</y></point><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></a>")
    rows = readers.read_object_xml(spark, str(tmp_path / "o.xml"), {"car": 1}).collect()
    assert sorted((x.status, x.category_id, x.x1, x.y2) for x in rows if x.status != "unresolvable") == [("ambiguous", 1, 1.0, 4.0), ("box", 1, 1.0, 9.0)]
    assert [(x.status, x.category_id) for x in rows if x.name == "bus"] == [("unresolvable", None)]


def test_a_malformed_document_is_an_error(spark, tmp_path):
    (tmp_path / "two.xml").write_text("<object><name>car</name><point><x>1</x><y>2</y></point></object>\n<object><name>bus</name><point><x>1</x><y>2</y></point></object>")
    with pytest.raises(Exception):
        readers.read_object_xml(spark, str(tmp_path / "two.xml"), {"car": 1}).collect()


def test_overlap_helper():
    assert iou((0, 0, 2, 2), (1, 1, 3, 3)) == pytest.approx(1 / 7)


def test_gated_regions_read_written_tables(spark):
    """The gate and the boxes are made once: what is published no longer computes them again from the tables for each of its inputs."""
    from __spark_entry__ import queries

    plan = queries()["c4_uncertainty_gate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan and "l_orderkey" not in plan
