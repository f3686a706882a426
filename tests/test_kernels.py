"""Order-dependent kernels against slow versions, and fixed examples."""

import hashlib
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridlark.functions import geometry as G
from gridlark.operators import aggregates, coco_eval, dedup, fusion, images, joins, matching, select, stats, validate, windows
from gridlark.plans import pipelines
from gridlark.sources import readers, writers


def boxes(n, seed, image=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = r.randint(0, 60), r.randint(0, 60)
        out.append((image, i, r.randint(1, 2), round(r.random(), 2), float(x), float(y), float(x + r.randint(5, 30)), float(y + r.randint(5, 30))))
    return pd.DataFrame(out, columns=["image_id", "det_id", "category_id", "score", "x1", "y1", "x2", "y2"])


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    i = max(0, w) * max(0, h)
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i
    return i / u if u > 0 else 0


@pytest.mark.parametrize("seed", range(3))
def test_hard_nms_is_slow_version_and_idempotent(spark, seed):
    df = boxes(40, seed)
    once = fusion.hard_nms(fusion.with_source(spark.createDataFrame(df), "base"), 0.5, 0.2, 300).toPandas()
    kept = []
    for b in df[df.score >= 0.2].sort_values(["score", "category_id", "x1", "y1", "x2", "y2"], ascending=[False] + [True] * 5).itertuples():
        if all(k.category_id != b.category_id or iou(k[5:9], b[5:9]) < 0.5 for k in kept):
            kept.append(b)
    assert sorted(once[["score", "x1", "y1"]].itertuples(index=False)) == sorted((k.score, k.x1, k.y1) for k in kept)
    again = fusion.hard_nms(fusion.with_source(spark.createDataFrame(once.assign(det_id=range(len(once)))), "base"), 0.5, 0.2, 300)
    assert again.count() == len(once)


def test_least_cost_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n, m = rng.integers(1, 5), rng.integers(5, 7)
        c = rng.random((n, m))
        best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(int(m)), int(n)))
        col = matching.least_cost(c)
        assert len(set(col)) == n and np.isclose(c[np.arange(n), col].sum(), best)


def test_average_precision_is_slow_version(spark):
    r = random.Random(5)
    rows = [(1, i, 1, r.randint(0, 20) / 20, int(r.random() < 0.5), 1) for i in range(60)]
    df = spark.createDataFrame(rows, "image_id long, det_id long, category_id int, score double, tp int, weight int")
    got = coco_eval.average_precision(df, spark.createDataFrame([(1, 40)], "category_id int, npos long"), ["category_id"]).first()
    rows.sort(key=lambda x: (-x[3], x[0], x[1]))
    tp = np.cumsum([x[4] for x in rows])
    prec = np.maximum.accumulate((tp / (np.arange(60) + 1 + 2.0**-52))[::-1])[::-1]
    at = [np.searchsorted(tp * 100, 40 * t) for t in range(101)]
    assert np.isclose(got.ap, sum(prec[i] if i < 60 else 0 for i in at) / 101) and np.isclose(got.recall, tp[-1] / 40)


def test_perfect_detections_have_ap_one(spark):
    b = boxes(20, 9)
    t = spark.createDataFrame(b.rename(columns={"det_id": "ann_id"}).drop(columns="score"))
    m = coco_eval.match_coco(t, spark.createDataFrame(b.assign(score=0.9)), areas=("all",))
    assert {round(x.ap, 9) for x in coco_eval.evaluated(t, m, [], ("all",)).collect()} == {1.0}


@pytest.mark.parametrize("seed", range(4))
def test_rotated_enclosure_bounds_the_turned_corners(spark, seed):
    """Against the corners, turned one by one about the middle of the box and cut at the image."""
    r = random.Random(seed)
    w, h, angle = r.randint(50, 300), r.randint(50, 300), r.uniform(-180, 180)
    x1, y1 = r.uniform(0, w - 20), r.uniform(0, h - 20)
    x2, y2 = x1 + r.uniform(1, 19), y1 + r.uniform(1, 19)
    df = spark.range(1).select(*[F.lit(v).alias(n) for v, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))])
    got = tuple(df.select(*G.rotated_enclosure(G.Box.of(), F.lit(angle), F.lit(w), F.lit(h)).named()).first())
    middle, turn = complex((x1 + x2) / 2, (y1 + y2) / 2), np.exp(1j * np.radians(angle))
    z = [(complex(x, y) - middle) * turn + middle for x in (x1, x2) for y in (y1, y2)]
    hull = [f(part(c) for c in z) for f in (min, max) for part in (lambda c: c.real, lambda c: c.imag)]
    assert np.allclose(got, np.clip(hull, 0, [w, h, w, h]))


def test_label_line(spark):
    images = spark.createDataFrame([(1, 1920, 1080), (2, 1920, 1080)], "image_id int, width int, height int")
    one = spark.createDataFrame([(1, 0, -192.0, 108.0, 384.0, 216.0)], "image_id int, category_id int, x1 double, y1 double, x2 double, y2 double")
    got = {r.image_id: r for r in writers.yolo_label_lines(images, one).collect()}
    assert got[1].text == "0 0.10000000 0.15000000 0.20000000 0.10000000\n" and (got[1].outside, got[1].clipped, got[1].degenerate) == (1, 1, 0) and got[2].text == ""


@pytest.mark.parametrize("first, last, n", [(0, 9, 10), (3, 500, 7), (10, 12, 2), (5, 1234, 321)])
def test_evenly_spaced(spark, first, last, n):
    f = spark.range(1300).select(F.lit(1).alias("sequence"), F.col("id").cast("int").alias("frame_index"))
    got = sorted(r.frame_index for r in select.evenly_spaced(f, first, last, n).collect())
    gaps = np.diff(got)
    assert len(set(got)) == n and (got[0], got[-1]) == (first, last) and gaps.max() - gaps.min() <= 1
    with pytest.raises(ValueError):
        select.evenly_spaced(f, first, last, last - first + 2)


@pytest.mark.parametrize("n, blocks", [(17, 5), (400, 9), (64, 64)])
def test_temporal_blocks(spark, n, blocks):
    f = spark.range(n).select(F.lit(1).alias("sequence"), F.col("id").cast("int").alias("frame_index"))
    rows = sorted((r.frame_index, r.block) for r in windows.temporal_blocks(f, blocks).collect())
    sizes = pd.Series([b for _, b in rows]).value_counts()
    assert [b for _, b in rows] == sorted(b for _, b in rows) and len(sizes) == blocks and sizes.max() - sizes.min() <= 1


def nothing_left(spark):
    """Image 2 has no box that any kernel publishes."""
    return spark.createDataFrame(pd.concat([boxes(15, 1), boxes(1, 2, image=2).assign(score=0.001)]))


SOFT = {"sigma": 0.5, "probe": 0.1, "publish": 0.1, "low": 0.5, "high": 1.5, "max_det": 300}
WBF = {"threshold": 0.5, "probe": 0.1, "publish": 0.1, "base_weight": 1.0, "low": 0.5, "high": 1.5, "max_det": 300}


@pytest.mark.parametrize("kernel", ["hard", "merge", "soft", "wbf", "anchored", "consensus", "reference"])
def test_images_without_output(spark, kernel):
    df = nothing_left(spark)
    base = fusion.with_source(df, "base")
    run = {
        "hard": lambda: fusion.hard_nms(base, 0.5, 0.1, 300),
        "merge": lambda: fusion.classwise_nms_merge([base, fusion.with_source(df, "flip")], 0.5, 300),
        "soft": lambda: fusion.soft_nms(base, **SOFT),
        "wbf": lambda: fusion.weighted_box_fusion(base, **WBF),
        "anchored": lambda: fusion.anchored_wbf(base, 0.5, 0.5, 0.0, 0.1, 0.1, 0.3, 1.0, 0.5, 1.5, 300),
        "consensus": lambda: fusion.consensus_anchor(base, 0.1, 0.2, 0.5, 300),
        "reference": lambda: fusion.fuse_reference(base, 0.5),
    }[kernel]()
    images = {r.image_id for r in run.collect()}
    assert 1 in images and (2 not in images or kernel in ("merge", "reference"))


def slow_match(truth, det, threshold, low, high):
    """det_id -> (tp, ignored): one detection after the other, best score first."""
    out, used = {}, set()
    size = lambda b: (b.x2 - b.x1) * (b.y2 - b.y1)
    for d in sorted(det, key=lambda d: (-d.score, d.det_id)):
        best = None
        for skipped in (False, True):
            for t in sorted(truth, key=lambda t: t.ann_id):
                o = (t.iscrowd == 1) or not low <= size(t) <= high
                if o != skipped or (t.ann_id in used and not t.iscrowd):
                    continue
                v = iou((t.x1, t.y1, t.x2, t.y2), (d.x1, d.y1, d.x2, d.y2))
                if t.iscrowd:
                    w, h = min(t.x2, d.x2) - max(t.x1, d.x1), min(t.y2, d.y2) - max(t.y1, d.y1)
                    v = max(0, w) * max(0, h) / size(d)
                if v >= threshold and (best is None or v >= best[0]):
                    best = (v, t, skipped)
            if best:
                break
        if best:
            used.add(best[1].ann_id)
            out[d.det_id] = (int(not best[2]), best[2])
        else:
            out[d.det_id] = (0, not low <= size(d) <= high)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_match_coco_is_slow_version(spark, seed):
    """With crowds, areas, ties, a class without detections and one without truth boxes."""
    t = boxes(25, seed).rename(columns={"det_id": "ann_id"}).drop(columns="score").assign(iscrowd=lambda x: (x.ann_id % 6 == 0).astype(int))
    d = boxes(30, seed).assign(x1=lambda x: x.x1 - 1, det_id=lambda x: 100 + x.det_id)
    t = pd.concat([t, t.head(2).assign(category_id=7, ann_id=[900, 901])])
    d = pd.concat([d, d.head(2).assign(category_id=8, det_id=[990, 991])])
    got = coco_eval.match_coco(spark.createDataFrame(t), spark.createDataFrame(d), thresholds=(0.5, 0.75)).toPandas()
    want = {}
    for c in set(d.category_id):
        for area, (low, high) in coco_eval.AREAS.items():
            for level in (0.5, 0.75):
                of = lambda x, c=c: list(x[x.category_id == c].itertuples())
                want |= {(k, area, level): v for k, v in slow_match(of(t), of(d), level, low, high).items()}
    assert {(r.det_id, r.area, r.threshold): (r.tp, r.ignored) for r in got.itertuples()} == want
    assert coco_eval.match_coco(spark.createDataFrame(t), spark.createDataFrame(d).limit(0)).count() == 0


def test_t_quantiles():
    """Tabulated to four digits everywhere."""
    from gridlark.operators.aggregates import t_quantile

    for dof, q in ((1, 12.7062), (2, 4.3027), (5, 2.5706), (10, 2.2281), (30, 2.0423), (120, 1.9799)):
        assert abs(t_quantile(dof) - q) < 6e-5


def test_row_hash_tells_rows_apart(spark):
    from gridlark.functions.hashing import row_hash

    rows = [("a|b", "c"), ("a", "b|c"), (None, "c"), ("null", "c"), ("", "c"), ("-", "c"), ("1:a", "c")]
    df = spark.createDataFrame(rows, "x string, y string").select(row_hash(["x", "y"]).alias("h"))
    assert df.distinct().count() == len(rows)


def first_choices(sizes, most):
    """For each total the places that reach it first, all totals kept as lists."""
    reached = {0: []}
    for place, size in enumerate(sizes):
        reached |= {t + size: [*places, place] for t, places in sorted(reached.items(), reverse=True) if t + size <= most and t + size not in reached}
    return reached


def test_nearest_total_of_components():
    assert dedup.nearest_total([4, 3, 3], 6) == (6, [1, 2]) and dedup.nearest_total([], 5) == (0, []) and dedup.nearest_total([9], 4) == (0, [])
    r = random.Random(8)
    for _ in range(200):
        sizes = [r.choice([1, 1, 2, 3, 7, 20, r.randrange(1, 40)]) for _ in range(r.randrange(12))]
        target = r.randrange(90)
        reached = first_choices(sizes, sum(sizes))
        best = min(reached, key=lambda t: (abs(t - target), t < target, t))
        assert dedup.nearest_total(iter(sizes), target) == (best, reached[best])
    assert dedup.nearest_total(itertools.chain([1] * 50_000, [7] * 100_000), 200_000)[0] == 200_000  # a choice among very many is quick


def test_partition_takes_whole_components_in_seeded_order(spark):
    rows = [(f"c{i}", s) for i, s in enumerate([4, 3, 3, 5, 1, 2, 2, 8])]
    sizes = spark.createDataFrame(rows, "component_sha string, size long")
    roles = []
    for seed in (1, 2, 20):
        ordered = sorted(rows, key=lambda x: hashlib.sha256(f"{seed}:{x[0]}".encode()).hexdigest())
        want = {ordered[k][0] for k in first_choices([s for _, s in ordered], 99)[9]}
        got = {x.component_sha: (x.size, x.role) for x in dedup.partition_components(sizes, 9, seed).collect()}
        assert {c: s for c, (s, _) in got.items()} == dict(rows) and {c for c, (_, role) in got.items() if role == "B"} == want
        roles.append(frozenset(want))
    assert len(set(roles)) > 1


def test_component_ids_of_any_size(spark):
    big = spark.range(60_000).select(F.lit(7).cast("long").alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    small = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (1, None), (None, "z"), (1, "a")], "g long, h string")
    got = {x.g: (x.component_sha, x["size"]) for x in dedup.component_id(big.unionByName(small).repartition(6), "g", "h").collect()}
    sha = lambda hs: hashlib.sha256("|".join(sorted(hs)).encode()).hexdigest()
    assert got == {7: (sha(x.h for x in big.collect()), 60_000), 1: (sha(["a", "a", "b"]), 4), 2: (sha([]), 1), None: (sha(["z"]), 1)}


def test_inventory_reads_files_in_blocks(spark, tmp_path):
    content = {"a.bin": b"", "deep/b c%20.txt": b"x" * 5000, "deep/g.gz": bytes(range(256)) * 40}
    for name, data in content.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = readers.file_inventory(spark, str(tmp_path), block=1000)
    assert sorted((x["size"], x.sha256) for x in rows.collect()) == sorted((len(d), hashlib.sha256(d).hexdigest()) for d in content.values())
    assert {x.path.rsplit("/", 1)[1] for x in rows.collect()} == {"a.bin", "b c%20.txt", "g.gz"}


def test_dhash_bits(spark):
    """Rising rows set all bits, falling ones none; one rise in the first pair is the highest bit."""
    up = [float(c) for _ in range(8) for c in range(9)]
    first = [0.0, 1.0] + [1.0] * 70
    df = spark.createDataFrame([(0, up), (1, up[::-1]), (2, first)], "k int, v array<double>")
    assert [x.h for x in df.select("k", dedup.dhash64(F.col("v")).alias("h")).orderBy("k").collect()] == [-1, 0, -(1 << 63)]


def picture(seed, height, width):
    r = np.random.default_rng(seed)
    return np.clip(images.smooth(r.integers(0, 256, (height, width, 3)), 3.0, 19) * 4 - 384, 0, 255).astype(np.uint8)


def test_image_hashes(spark):
    """Turned and mirrored images share their hashes; a flat image has no rising pair."""
    flat = np.full((48, 64, 3), 100, np.uint8)
    one = picture(1, 96, 96)
    rows = [(0, one), (1, np.ascontiguousarray(np.rot90(one))), (2, np.ascontiguousarray(one[:, ::-1])), (3, picture(2, 80, 120)), (4, flat)]
    df = spark.createDataFrame([(i, p.shape[0], p.shape[1], bytearray(p.tobytes())) for i, p in rows], "image_id long, height int, width int, data binary")
    got = {x.image_id: x for x in dedup.image_hashes(df).collect()}
    assert all(len(x.phashes) == len(x.dhashes) == 8 for x in got.values())
    assert set(got[0].dhashes) == set(got[1].dhashes) == set(got[2].dhashes) and got[0].dhashes[1] == got[1].dhashes[0]
    assert set(got[4].dhashes) == {0}
    assert np.array_equal(dedup.resized(np.full((7, 300), 9), 32, 32), np.full((32, 32), 9))
    edges = {(x.a, x.b) for x in dedup.near_edges(dedup.image_hashes(df), 4, "image_id", ["phashes", "dhashes"]).collect()}
    assert {(0, 1), (0, 2)} <= edges and not any(3 in e or 4 in e for e in edges)


def test_near_edges_connect_what_the_rule_connects(spark):
    """Against all pairs; each link is a near pair, and rows with the same hashes make a star."""
    r = random.Random(4)
    centers = [r.getrandbits(64) - (1 << 63) for _ in range(12)]

    def near(h):
        for _ in range(r.randrange(6)):
            h ^= 1 << r.randrange(63)
        return h

    rows = [(i, [near(r.choice(centers)) for _ in range(2)], [near(r.choice(centers))] if i % 3 else []) for i in range(60)]
    rows += [(i, [5, None], [7]) for i in range(60, 90)] + [(90, None, None)]
    df = spark.createDataFrame(rows, "k long, p array<long>, d array<long>")
    got = dedup.near_edges(df, 4, "k", ["p", "d"]).collect()
    each = {k: {"p": [x for x in p or [] if x is not None], "d": [x for x in d or [] if x is not None]} for k, p, d in rows}
    apart = lambda a, b, kind: min((bin((x ^ y) & (2**64 - 1)).count("1") for x in each[a][kind] for y in each[b][kind]), default=99)
    assert all(x.a < x.b and apart(x.a, x.b, x.kind) <= x.distance <= 4 for x in got)
    assert len([x for x in got if x.a >= 60]) == 2 * 29

    def groups(pairs):
        root = {k: k for k in each}

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for a, b in pairs:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        return {k: find(k) for k in each}

    want = [(a, b) for a, b in itertools.combinations(each, 2) if min(apart(a, b, "p"), apart(a, b, "d")) <= 4]
    assert groups((x.a, x.b) for x in got) == groups(want)
    assert dedup.near_edges(df.limit(0), 4, "k", ["p", "d"]).count() == 0


def test_image_kernels():
    """Hand-computed values and properties."""
    flat = np.full((40, 50, 3), 51, np.uint8)
    q = images.quality(flat)
    assert abs(q["luminance"] - 0.8) < 1e-12 and q["contrast"] == 1 and q["entropy"] == 1 and abs(q["haze"] - 0.2) < 1e-12 and abs(q["blur"] + np.log(1e-12)) < 1e-9
    red = np.zeros((20, 20, 3), np.uint8)
    red[..., 2] = 255
    assert abs(images.quality(red)["luminance"] - (1 - 0.2126)) < 1e-12
    some = picture(3, 70, 45)
    assert np.array_equal(images.fog(some, 0.0, 5), some) and np.array_equal(images.fog(some, 1.0, 5), images.fog(some, 1.0, 5))
    assert not np.array_equal(images.fog(some, 1.0, 5), images.fog(some, 1.0, 6))
    thick = images.fog(some, 50.0, 5)
    assert abs(thick.astype(int) - 235).max() <= 1
    assert images.low_light(flat, 2.0, 0)[0, 0, 0] == 10 and np.array_equal(images.low_light(some, 2.0, 1), images.low_light(some, 2.0, 2))
    assert np.array_equal(images.gaussian_blur(flat, 1.5, 0), flat) and np.array_equal(images.unsharp(flat, 1.0), flat)
    assert images._cubic(4, 4).tolist() == np.eye(4).tolist() and np.allclose(images._cubic(3, 50).sum(axis=1), 1)


def test_best_regions(spark):
    traits = spark.createDataFrame([(1, i, d, 0.0, 1.0 + i) for i, d in enumerate([0.1, 0.9, 0.5, 0.9, 0.2, 0.3])], "image_id long, region_id int, d double, u double, edge double")
    regions = spark.createDataFrame([(1, i, 10 * i, 0, 10 * i + 10, 10) for i in range(6)], "image_id long, region_id int, rx1 int, ry1 int, rx2 int, ry2 int")
    base = spark.createDataFrame([(1, 10.0, 0.0, 12.0, 4.0)], "image_id long, x1 double, y1 double, x2 double, y2 double")
    # region 1 is among the least textured quarter, but a box lies there; region 0 has none and is damped
    assert {(x.region_id, x.slot) for x in pipelines.best_regions(base, traits, regions, 4).collect()} == {(1, 0), (3, 1), (2, 2), (5, 3)}


def test_dense_ids(spark):
    r = random.Random(6)
    rows = [(r.randrange(700), i) for i in range(3000)] + [(5, i) for i in range(3000, 4000)]
    df = spark.createDataFrame(rows, "image_id long, ann_id long")
    got = {x.ann_id: x.coco_id for x in writers.assign_coco_ids(df, "image_id", ["ann_id"]).collect()}
    assert got == {a: n for n, (_, a) in enumerate(sorted(rows), 1)}
    assert writers.assign_coco_ids(df.limit(0), "image_id", ["ann_id"]).count() == 0


@pytest.mark.parametrize("whole", [1 << 26, 0])
def test_ap_bootstrap_is_slow_version(spark, monkeypatch, whole):
    """Both runs against AP of images taken as often as they are drawn; ties, images and a category without detections; the matrix held and joined."""
    monkeypatch.setattr(stats, "WHOLE_MATRIX", whole)
    r = random.Random(12)
    n_units, n = 7, 9
    make = lambda: [(i, c, 10 * i + k, r.choice([0.1, 0.3, 0.3, 0.8, 1.0, round(r.random(), 3)]), r.randrange(2)) for i in range(12) for c in (1, 2) for k in range(c, r.randrange(5), 2)]
    runs = {"a": make(), "b": make()}
    npos = [(i, c, r.randrange(1, 5)) for i in range(12) for c in (1, 2, 3) if r.random() < 0.8]
    frames = {k: spark.createDataFrame(x, "image_id long, category_id int, det_id long, score double, tp int") for k, x in runs.items()}
    units = spark.createDataFrame([(i, i % n_units) for i in range(12)], "image_id long, unit int")
    positives = spark.createDataFrame(npos, "image_id long, category_id int, npos long")
    got = {(x.run, x.resample): x.ap for x in stats.ap_cluster_bootstrap(frames, positives, units, n_units, n, 5).collect()}
    drawn = {(x.resample, x.unit): x.m for x in stats.draws(spark, n, n_units, 5).collect()}

    def slow(rows, weight):
        out = []
        for c in (1, 2, 3):
            need = sum(k * weight(i) for i, c2, k in npos if c2 == c)
            if not need:
                continue
            true = seen = 0
            curve = []
            for i, _, _, _, tp in sorted((x for x in rows if x[1] == c), key=lambda x: (-x[3], x[0], x[2])):
                for _ in range(weight(i)):
                    true, seen = true + tp, seen + 1
                    curve.append((100 * true / need, true / seen))
            out.append(sum(max([p for recall, p in curve if recall >= point], default=0) for point in range(101)) / 101)
        return sum(out) / len(out)

    want = {(k, b): slow(x, lambda i, b=b: drawn.get((b, i % n_units), 0)) for k, x in runs.items() for b in range(n)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    one, two = sorted(runs)[:2]
    left = {x.omitted: x for x in stats.leave_one_group_out({k: frames[k] for k in (one, two)}, positives, units, one, two).collect()}
    full = slow(runs[two], lambda i: 1) - slow(runs[one], lambda i: 1)
    for u in range(n_units):
        a, b = (slow(runs[k], lambda i, u=u: int(i % n_units != u)) for k in (one, two))
        assert abs(left[u].baseline_ap - a) < 1e-9 and abs(left[u].method_ap - b) < 1e-9 and abs(left[u].shift - (b - a - full)) < 1e-9
    assert len(left) == n_units


def test_checks_of_pairs_and_registries(spark):
    runs = spark.createDataFrame([("a", 1, 0.5, "w"), ("b", 1, 0.75, "w"), ("a", 2, 0.5, "w"), ("b", 2, 0.5, None)], "method string, seed int, ap double, weights string")
    assert [x.delta for x in joins.paired_runs(runs, ["seed"], "a", "b", "ap").orderBy("seed").collect()] == [0.25, 0.0]
    assert joins.paired_runs(runs.where("seed = 1"), ["seed"], "a", "b", "ap", ["weights"]).count() == 1
    with pytest.raises(Exception, match="paired runs differ"):
        joins.paired_runs(runs, ["seed"], "a", "b", "ap", ["weights"]).collect()
    one, two = (runs.where(F.col("method") == m) for m in "ab")
    assert writers.join_run_predictions(one, two, "method", ["seed"]).count() == 4
    with pytest.raises(ValueError, match="lacks"):
        writers.join_run_predictions(one, two.where("seed = 1"), "method", ["seed"])
    times = spark.createDataFrame([("a", 2.0, 1.0, 5), ("a", 4.0, 2.0, 9)], "model string, total_ms double, fuse double, mb int")
    row = aggregates.timing_summary(times, "model", stages=["fuse"], memory="mb").first()
    assert (row.mean_ms, row.fuse_mean, row.peak_memory) == (3.0, 1.5, 9)


def test_repeated_images_and_rows_are_reported(spark):
    images_ = spark.createDataFrame([(1, 100, 100), (1, 100, 100), (2, 100, 100)], "image_id long, width int, height int")
    found = spark.createDataFrame([(1, 7, 1, 0.5, 0.0, 0.0, 9.0, 9.0), (1, 7, 1, 0.5, 0.0, 0.0, 9.0, 9.0), (1, 8, 1, 1.5, 0.0, 0.0, 9.0, 9.0)], "image_id long, det_id long, category_id int, score double, x1 double, y1 double, x2 double, y2 double")
    got = sorted((x.image_id, x.det_id or -1, x.problem) for x in validate.validate_detections(found, images_, [1]).collect())
    assert got == [(1, -1, "duplicate_image"), (1, 7, "duplicate_row"), (1, 8, "score_range"), (2, -1, "missing_image")]


def test_routed_operations(spark):
    parts = {"luminance": "gamma", "contrast": "clahe", "haze": "clahe", "blur": "unsharp", "entropy": None}
    rows = [(0, 0.1, 0.9, 0.8, 0.7, 1.0), (1, 0.5, 0.5, 0.5, 0.5, 0.5), (2, 0.0, 0.1, 0.2, 0.3, 0.4)]
    df = spark.createDataFrame(rows, "k int, luminance double, contrast double, haze double, blur double, entropy double")
    got = {x.k: x.ops for x in df.select("k", select.route_operations(parts, ["gamma", "clahe", "unsharp"], 2).alias("ops")).collect()}
    assert got == {0: ["clahe", "unsharp"], 1: ["gamma", "clahe"], 2: ["unsharp", "clahe"]}
    assert df.select(select.route_operations(parts, ["gamma"], 2).alias("ops")).distinct().collect()[0].ops == ["gamma"]


def test_selective_regions(spark):
    images = spark.createDataFrame([(i, 400, 400) for i in range(4)], "image_id long, width int, height int")
    regions = spark.createDataFrame([(i, 0, 0, 0, 400, 400) for i in range(3)], "image_id long, region_id int, rx1 int, ry1 int, rx2 int, ry2 int")
    traits = spark.createDataFrame([(i, 0, 0.5, 0.5, 0.5) for i in range(3)], "image_id long, region_id int, d double, u double, edge double")
    parts = spark.createDataFrame([(i, 0, 0.9, 0.1, 0.1, 0.8, 0.0) for i in range(3)], "image_id long, region_id int, luminance double, contrast double, haze double, blur double, entropy double")
    box = (100.0, 100.0, 150.0, 150.0)
    base = spark.createDataFrame([(10 + i, i, 1, 0.3, *box) for i in range(4)], "det_id long, image_id long, category_id int, score double, x1 double, y1 double, x2 double, y2 double")
    local = base.where("image_id < 3").selectExpr("*", "0 as region_id", "0.7d as q")
    # image 0: the first operation is good enough; 1: the second one is the better; 2: one is unsupported and one finds nothing
    tried = [(0, "gamma", 0.9), (0, "unsharp", 0.95), (1, "gamma", 0.35), (1, "unsharp", 0.6), (2, "gamma", 0.9)]
    found = spark.createDataFrame([(10 + i, i, 1, s, *(box if i < 2 else (200.0, 200.0, 250.0, 250.0)), 0, 0.0, op) for i, op, s in tried], "det_id long, image_id long, category_id int, score double, x1 double, y1 double, x2 double, y2 double, region_id int, q double, operation string")
    got = pipelines.selective_regions(base, local, found, traits, parts, regions, images, stop=(0.4, 0.5, 0.1))
    trace = {(x.image_id, x.round): (x.operation, x.selected, x.early_stopped) for x in got.trace.collect()}
    assert trace == {
        (0, 0): ("identity", False, False), (0, 1): ("gamma", True, True),
        (1, 0): ("identity", False, False), (1, 1): ("gamma", False, False), (1, 2): ("unsharp", True, False),
        (2, 0): ("identity", True, False), (2, 1): ("gamma", False, False), (2, 2): ("unsharp", False, False),
    }
    q = {(x.image_id, x.round): x.q for x in got.trace.collect()}
    fixed = 0.05 / 9  # the cost of a crop of 640 in 1920
    assert q[0, 1] == pytest.approx(0.3 * 0.6 + 0.3 - fixed) and q[1, 2] == pytest.approx(0.3 * 0.3 + 0.3 - fixed)
    assert q[2, 1] == pytest.approx(-0.1 * 0.65 - fixed) and q[2, 2] == pytest.approx(-fixed)
    assert {x.image_id: (x.num_regions, x.num_candidates) for x in got.work.collect()} == {0: (1, 2), 1: (1, 3), 2: (1, 3), 3: (0, 0)}
    scores = {x.image_id: x.score for x in got.final.collect()}
    assert set(scores) == {0, 1, 2, 3} and scores[0] > scores[1] > scores[2] == pytest.approx(0.3) and scores[3] == 0.3
    strict = {x.image_id: x.source for x in pipelines.selective_regions(base, local, found, traits, parts, regions, images, stop=(0.4, 0.5, 0.1), conservative=True).final.collect()}
    assert strict[2] == "base" and strict[0] != "base"


def test_scout_escalation(spark):
    images = spark.createDataFrame([(i, 100, 100) for i in range(4)], "image_id long, width int, height int")
    kind = "det_id long, image_id long, category_id int, score double, x1 double, y1 double, x2 double, y2 double"
    base = spark.createDataFrame([(i, i, 1, 0.5, 10.0, 10.0, 30.0, 30.0) for i in range(3)], kind)
    scout = spark.createDataFrame([(10, 0, 1, 0.8, 10.0, 10.0, 30.0, 30.0), (11, 1, 1, 0.2, 60.0, 60.0, 80.0, 80.0)], kind)
    f = pipelines.escalation_features(base, scout, images, [1]).toPandas().set_index("image_id")
    assert len(f) == 4 and f.loc[0, "b0_count"] == 1 and f.loc[3, "b0_count"] == 0 and f.loc[2, "count_delta"] == -1 and f.loc[0, "image_aspect"] == 1
    full = base.selectExpr("image_id", "category_id", "0.99d as score", "x1", "y1", "x2", "y2", "'flip' as source")
    gates = spark.createDataFrame([(0, 0.1), (1, 0.2), (2, 0.9), (3, 0.0)], "image_id long, gate double")
    got = sorted((x.image_id, x.score, x.source) for x in pipelines.scout_escalation(base, scout, full, gates, 0.25).collect())
    assert got == [(0, 0.8, "scout"), (1, 0.5, "base"), (2, 0.99, "flip")]
