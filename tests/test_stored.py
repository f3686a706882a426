"""Stored tables: interrupted and repeated updates, partitions that stay untouched, errors before anything is written; checks that raise."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridlark.functions import categories, hooks
from gridlark.operators import fusion, select, stats, validate
from gridlark.sources import stored
from gridlark.sources.shared import new_folder


def files(path):
    root = path.removeprefix("file://")
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def manifest(spark, rows):
    return spark.createDataFrame(rows, "image long, source_split string, version int")


def test_named_splits_are_written_and_no_others(spark):
    path = new_folder(spark, "manifest")
    stored.upsert_splits(path, manifest(spark, [(1, "train", 1), (2, "val", 1), (3, "test a/b", 1)]), ["train", "val", "test a/b"], ["image"])
    before = files(path)
    out = stored.upsert_splits(path, manifest(spark, [(2, "val", 2), (4, "val", 2)]), ["val"], ["image"])
    assert sorted(map(tuple, out.collect())) == [(1, "train", 1), (2, "val", 2), (3, "test a/b", 1), (4, "val", 2)]
    same = {f for f, t in files(path).items() if before.get(f) == t}
    assert len(same) == 2 and not any("val" in f for f in same)
    for wrong in ([(1, "val", 3)], [(9, "val", 3), (9, "val", 3)], [(9, "train", 3)], [(9, None, 3)]):  # a key of another split, twice, another split, none
        with pytest.raises(ValueError):
            stored.upsert_splits(path, manifest(spark, wrong), ["val"], ["image"])
    emptied = stored.upsert_splits(path, manifest(spark, []), ["test a/b"], ["image"])
    assert sorted(x.image for x in emptied.collect()) == [1, 2, 4]


def test_merge_and_prefix_touch_their_partitions_only(spark):
    path, schema = new_folder(spark, "runs"), "name string, part int, v int"
    rows = [("a1", 1, 0), ("a2", 2, 0), ("b1", 1, 0), ("b3", 3, 0)]
    stored.merge_stored(path, spark.createDataFrame(rows, schema), ["name"], "part")
    before = files(path)
    out = stored.merge_stored(path, spark.createDataFrame([("a2", 1, 5), ("c1", 1, 5)], schema), ["name"], "part")  # a2 moves to another partition
    assert sorted(map(tuple, out.collect())) == [("a1", 1, 0), ("a2", 1, 5), ("b1", 1, 0), ("b3", 3, 0), ("c1", 1, 5)]
    assert [f for f in files(path) if "part=3" in f] == [f for f in before if "part=3" in f] and not any("part=2" in f for f in files(path))
    out = stored.replace_stored_prefix(path, spark.createDataFrame([("b9", 4, 9)], schema), "name", "b", "part")
    assert sorted(map(tuple, out.collect())) == [("a1", 1, 0), ("a2", 1, 5), ("b9", 4, 9), ("c1", 1, 5)]


def test_a_stopped_bootstrap_goes_on(spark):
    rows = [(c, u, u * 0.1 * k, (u * 7 % 5) * 0.3) for k, c in enumerate(("x", "y/z"), 1) for u in range(20)]
    pairs = spark.createDataFrame(rows, "contrast string, unit int, baseline double, method double")
    at_once = {tuple(r) for r in stored.stored_deltas(new_folder(spark, "deltas"), pairs, 20, 70, 3, stats.weighted_mean_delta, block=10).collect()}
    want = {(c, r.resample, r.delta) for c in ("x", "y/z") for r in stats.paired_bootstrap(pairs.where(F.col("contrast") == c), 20, 70, 3, stats.weighted_mean_delta).collect()}
    assert {(c, r, d) for c, _, r, d in at_once} == want and len(at_once) == 140
    path = new_folder(spark, "deltas")
    stored.stored_deltas(path, pairs.where("contrast = 'x'"), 20, 35, 3, stats.weighted_mean_delta, block=10)
    before = files(path)
    lost = next(f for f in before if "block=1/" in f)
    os.remove(lost)  # a block that a stopped job did not finish
    assert {tuple(r) for r in stored.stored_deltas(path, pairs, 20, 70, 3, stats.weighted_mean_delta, block=10).collect()} == at_once
    kept = {f for f, t in files(path).items() if before.get(f) == t}
    assert {f.split("block=")[1][0] for f in kept} == {"0", "2"}  # whole blocks stay, 1 was lost, 3 was not whole
    now = files(path)
    stored.stored_deltas(path, pairs, 20, 70, 3, stats.weighted_mean_delta, block=10)
    assert files(path) == now
    changed = pairs.withColumn("method", F.when(F.col("contrast") == "x", F.col("method") + 1).otherwise(F.col("method")))
    again = stored.stored_deltas(path, changed, 20, 70, 3, stats.weighted_mean_delta, block=10).collect()
    assert len(again) == 140 and {tuple(r) for r in again if r.contrast == "y/z"} == {r for r in at_once if r[0] == "y/z"}
    assert all(abs(r.delta - d - 1) < 1e-9 for r in again for c, _, k, d in at_once if (c, k) == ("x", r.resample) == (r.contrast, r.resample))


def test_published_boxes(spark):
    images = spark.createDataFrame([(1, 100, 80)], "image_id long, width int, height int")

    def made(*rows):
        return spark.createDataFrame([(1, 1, *x, "wbf") for x in rows], fusion.FUSED)

    out = fusion.published(made((0.5, -0.5, 0.0, 50.0, 80.4), (0.5, 99.2, 0.0, 100.0, 50.0), (0.5, 0.0, 79.5, 10.0, 80.0)), images).collect()
    assert [(x.x1, x.y1, x.x2, x.y2) for x in out] == [(0.0, 0.0, 50.0, 80.0)]  # clipped; too narrow; too low
    for bad in ((0.5, -3.0, 0.0, 5.0, 5.0), (0.5, float("nan"), 0.0, 5.0, 5.0), (1.5, 0.0, 0.0, 5.0, 5.0), (0.5, 0.0, 0.0, float("inf"), 5.0)):
        with pytest.raises(Exception, match="fused box of image 1"):
            fusion.published(made(bad), images).collect()
    with pytest.raises(Exception, match="unknown image"):
        fusion.published(made((0.5, 0.0, 0.0, 5.0, 5.0)), images.where("image_id = 2")).collect()


def test_class_maps_and_flags(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (2, 2, 0.5), (3, 2, None)], "id long, category_id int, score double")
    done = categories.remap_category(df, {1: 0, 2: 1, 7: 6})
    assert [x.category_id for x in done.orderBy("id").collect()] == [0, 1, 1] and done.schema["category_id"].dataType == df.schema["category_id"].dataType
    with pytest.raises(Exception, match="class without an entry: 2"):
        categories.remap_category(df, {1: 0}).collect()
    audit = {x.source: (x.n_before, x.n_after, x.others_unchanged, x.same_count) for x in categories.remap_audit(df, done, {1: 0, 2: 1, 7: 6}).collect()}
    assert audit == {1: (1, 1, True, True), 2: (2, 2, True, True), 7: (0, 0, True, True)}
    wrong = categories.remap_audit(df, done.withColumn("score", F.lit(0.5)), {1: 0, 2: 1}).collect()
    assert not any(x.others_unchanged for x in wrong) and all(x.same_count for x in wrong)
    names = lambda rows: spark.createDataFrame(rows, "id int, name string")
    assert categories.name_mapping(names([(1, "Car "), (2, "bus")]), names([(5, "bus"), (9, "car"), (3, "van")])) == {1: 9, 2: 5}
    with pytest.raises(ValueError, match="tram"):
        categories.name_mapping(names([(1, "tram")]), names([(5, "bus")]))
    bits = spark.createDataFrame([([1, 0, 0],), ([1, 1, 0],), ([0, 0, 0],), ([1, 0],), ([2, 0, 0],), (None,)], "bits array<int>")
    got = [tuple(x) for x in bits.select(*categories.attribute_flags(F.col("bits"), ["a", "b", "c"], {"one": ["a", "b"]}, {"some": ["b", "c"]})).collect()]
    assert got == [(True, False, False, True, False), (True, True, False, False, True), (False, False, False, False, False)] + [(None,) * 5] * 3


def test_a_detector_is_checked(spark):
    images = spark.createDataFrame([(1, 50, 40), (2, 50, 40)], "image_id long, width int, height int")

    def make(box, told=None):
        def predict(batch, **options):
            assert told is None or options == told
            return pd.DataFrame([(i, 1, 0.9, *box) for i in batch["image_id"] if i != 2], columns=["image_id", "category_id", "score", "x1", "y1", "x2", "y2"])

        return lambda: predict

    asked = {"conf": 0.1, "iou": 0.6, "max_det": 5}
    assert hooks.detect_checked(images, make((0.0, 0.0, 9.0, 9.0), asked), [1], **asked).count() == 1
    with pytest.raises(ValueError, match="outside_image in image 1"):
        hooks.detect_checked(images, make((0.0, 0.0, 90.0, 9.0)), [1])
    with pytest.raises(ValueError, match="class_range"):
        hooks.detect_checked(images, make((0.0, 0.0, 9.0, 9.0)), [2])


def test_orders_and_kinds(spark):
    order = lambda keys: spark.createDataFrame(list(enumerate(keys)), "position int, key string")
    row = lambda a, b: tuple(select.compare_orders(order(a), order(b), "key").first())
    assert row("abcd", "abdc") == (4, 2, 2, True, True) and row("aab", "aba") == (3, 1, 2, True, False)
    assert row("ab", "ac") == (2, 1, 1, False, True) and row("abc", "ab")[1:4] == (2, 1, False)
    kind = lambda rows: spark.createDataFrame(rows, "k string, kind string, v int")
    out = validate.compare_by_kind(kind([("x", "gt", 1), ("x", "gt", 2), ("y", "gt", 1), ("z", "ignore", 1)]), kind([("x", "gt", 2), ("x", "gt", 1), ("y", "gt", 2), ("w", "gt", 1)]), ["k"], "kind", ["v"])
    assert {x.kind: tuple(x)[1:] for x in out.collect()} == {"gt": (1, 1, 0, 1, 3, 4), "ignore": (0, 0, 1, 0, 1, 0)}
    check = validate.category_check(spark.createDataFrame([(3,), (1,), (1,)], "category_id int"), [1, 2]).first()
    assert (check.observed, check.missing, check.unexpected, check.complete) == ([1, 3], [2], [3], False)


def test_unmatched_boxes_at_three_scores(spark):
    from gridlark.operators import aggregates

    box = lambda rows: spark.createDataFrame(rows, "image_id long, det_id long, score double")
    base, scout = box([(1, 1, 0.6), (1, 2, 0.3), (1, 3, 0.26)]), box([(1, 7, 0.55), (1, 8, 0.4), (2, 9, 0.9)])
    pairs = spark.createDataFrame([(1, 1, 7, 0.9, 0.6, 0.55), (1, 2, 8, 0.7, 0.3, 0.4), (1, 3, 8, 0.4, 0.26, 0.4)], "image_id long, left_id long, right_id long, iou double, l_score double, r_score double")
    got = lambda level: {x.image_id: tuple(x)[1:] for x in aggregates.unmatched_at(base, scout, pairs, level).collect()}
    assert got(0.25) == {1: (1.0, 0.0), 2: (0.0, 1.0)} and got(0.35) == {1: (0.0, 1.0), 2: (0.0, 1.0)} and got(0.5) == {1: (0.0, 0.0), 2: (0.0, 1.0)}
