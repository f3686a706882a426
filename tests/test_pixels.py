"""Jobs over pixels: what reaches a worker, what a kernel holds, and the kernels against plain definitions."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.operators import images


def plan(df) -> str:
    return (df.queryExecution if hasattr(df, "queryExecution") else df._jdf.queryExecution()).toString()


@pytest.mark.parametrize("height, width", [(48, 64), (300, 20), (9, 270)])
def test_smoothing_by_definition(height, width):
    """One weighted sum a pixel, over mirrored borders, on both sides of the size that takes a matrix."""
    image = np.random.default_rng(height).integers(0, 256, (height, width, 3))
    k = np.exp(-(np.arange(-4, 5) ** 2) / (2 * 1.5 * 1.5))
    k /= k.sum()
    p = np.pad(image.astype(float), [(4, 4), (4, 4), (0, 0)], mode="reflect")
    want = sum(k[i] * k[j] * p[i : i + height, j : j + width] for i in range(9) for j in range(9))
    assert np.allclose(images.smooth(image, 1.5, 9), want, atol=1e-9) and np.allclose(images.smooth(image[..., 0], 1.5, 9), want[..., 0], atol=1e-9)


def test_fog_of_a_tall_image_stays_small():
    """The filter over the depth has a third of the height in taps; no copy of the image is made for each of them."""
    image = np.full((1500, 64, 3), 100, np.uint8)
    tracemalloc.start()
    images.fog(image, 1.0, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_pixels_reach_the_worker_once_an_image(spark):
    df = spark.range(6).select(F.col("id").alias("image_id"), F.lit(4).alias("height"), F.lit(5).alias("width"), F.encode(F.repeat(F.lit("abc"), 20), "utf-8").alias("data"))
    views = images.degraded_views(df, 1)
    assert "Generate" not in plan(views)
    got = views.collect()
    assert len(got) == 54 and all(len(x.data) == 60 for x in got) and len({x.seed for x in got}) == 54
    digests = images.degraded_views(df, 1, keep_pixels=False)
    assert set(views.columns) - set(digests.columns) == {"data"}
    assert {(x.image_id, x.seed, x.output_sha256) for x in digests.collect()} == {(x.image_id, x.seed, x.output_sha256) for x in got}


def test_border_stats_read_pixels_where_they_lie(spark):
    """No copy of a batch as Python objects; figures as by hand."""
    df = spark.range(40).select(F.col("id").alias("image_id"), F.lit(6).alias("height"), F.lit(5).alias("width"), F.encode(F.repeat(F.lit("abc"), 30), "utf-8").alias("data"))
    stats = images.border_stats(df, 1, white=98)
    assert "MapInArrow" in plan(stats) and "MapInPandas" not in plan(stats)
    assert {(x.border_mean, x.white_fraction) for x in stats.collect()} == {(98.0, 0.0)} and stats.count() == 40


def test_hashes_of_a_stack(spark):
    """Images are hashed together, each as it is alone."""
    from gridlark.operators import dedup

    r = np.random.default_rng(3)
    stack = r.integers(0, 256, (5, 64, 64)).astype(float)
    for f in (dedup.image_phash, dedup.image_dhash):
        assert f(stack).tolist() == [int(f(x)) for x in stack]
    shapes = [(48, 64), (70, 64), (20, 33)] * 25  # more than one stack
    rows = [(k, h, w, bytes(r.integers(0, 256, 3 * h * w).astype(np.uint8))) for k, (h, w) in enumerate(shapes)]
    df = spark.createDataFrame(rows, "image_id long, height int, width int, data binary").repartition(2)
    got = {x.image_id: (x.phashes, x.dhashes) for x in dedup.image_hashes(df).collect()}
    for k, h, w, data in rows[::10]:
        views = dedup.orientations(dedup.resized(images.gray8(np.frombuffer(data, np.uint8).reshape(h, w, 3)), 64, 64))
        assert got[k] == ([int(dedup.image_phash(x)) for x in views], [int(dedup.image_dhash(x)) for x in views])
    assert len(got) == len(rows) and dedup.image_hashes(df.limit(0)).count() == 0


def test_near_hashes_meet_by_one_number(spark):
    """Rows of near hashes are dealt and sorted by a single number, whatever the kinds; links are those of all pairs."""
    from gridlark.operators import dedup

    r = np.random.default_rng(8)
    base = r.integers(-(2**63), 2**63 - 1, 30)
    rows = [(k, [int(base[k % 30]) ^ (1 << int(r.integers(0, 63))), int(base[(k * 7) % 30])], [int(base[k % 30])]) for k in range(60)]
    edges = dedup.near_edges(spark.createDataFrame(rows, "id long, p array<long>, d array<long>"), 4, "id", ["p", "d"])
    joins = [x for x in plan(edges).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].splitlines() if "Join" in x]
    assert any("meet" in x for x in joins) and not any("bits" in x for x in joins)
    got = {(x.a, x.b, x.kind) for x in edges.collect()}
    assert {k for _, _, k in got} == {"p", "d"}
    near = lambda i, j, c: min(bin((x ^ y) & (2**64 - 1)).count("1") for x in rows[i][c] for y in rows[j][c]) <= 4
    assert all(near(a, b, 1 if k == "p" else 2) for a, b, k in got)
    joined = {k: k for k in range(60)}

    def root(x):
        while joined[x] != x:
            x = joined[x]
        return x

    for a, b, _ in got:
        joined[root(a)] = root(b)
    assert all(root(i) == root(j) for i in range(60) for j in range(i) if near(i, j, 1) or near(i, j, 2))


@pytest.mark.parametrize("name", ["u2_user_detector", "u2_checked_detector"])
def test_an_image_of_equal_pixels_has_a_box(spark, tmp_path, name):
    """Two bytes and the space make one pixel, over and over; the mean of equal numbers can round above them, which left no pixel."""
    import __spark_entry__

    texts = [chr(c) + "." for c in range(ord("A"), ord("Z") + 1)] + ["ad", "as", "bb", "x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {x.image_id: (x.x1, x.y1, x.x2, x.y2) for x in __spark_entry__.queries()[name](spark, f"file://{tmp_path}").collect()}
    assert len(got) == len(texts) and all(got[i] == (0.0, 0.0, 64.0, 48.0) for i, t in enumerate(texts) if len(t) == 2)
