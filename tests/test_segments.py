"""Kernels over many images against plain loops over one image, written from the rules; steps of ``segments`` by themselves."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.operators import fusion, matching
from gridlark.operators import segments as S

SCHEMA = "image_id long, det_id long, category_id int, score double, x1 double, y1 double, x2 double, y2 double, region_id int, q double, source string"
DET = {"threshold": 0.5, "publish": 0.25, "max_det": 6}


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    common = max(w, 0.0) * max(h, 0.0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - common
    return common / union if union > 0 else 0.0


class Row:
    def __init__(self, image, det, cls, score, box, region, q, source):
        self.image, self.det, self.cls, self.score, self.box, self.region, self.q, self.source = image, det, cls, score, box, region, q, source

    def best_first(self):
        return (-self.score, self.cls, *self.box)


def some(seed, images=40, sources=("base", "local")):
    """Crowds with ties, equal boxes, empty boxes, and one image of a single box."""
    r = random.Random(seed)
    rows = []
    for image in range(images):
        for _ in range(r.randint(1, 14) if image else 1):
            x, y = r.randrange(12), r.randrange(6)
            box = (float(x), float(y), float(x + r.choice([0, 6, 8, 8, 10])), float(y + r.choice([6, 8])))
            source = r.choice(sources)
            rows.append(Row(image, len(rows), r.choice([1, 1, 2]), r.choice([0.04, 0.2, 0.3, 0.5, 0.5, 0.6, 0.9, r.random()]), box, r.randrange(3) if source == "local" else -1, r.choice([-0.5, 0.0, 0.2, 0.8]) if source == "local" else 0.0, source))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(x.image, x.det, x.cls, x.score, *x.box, x.region, x.q, x.source) for x in rows], SCHEMA).repartition(3)


def by_image(rows):
    for _, g in itertools.groupby(sorted(rows, key=lambda x: x.image), key=lambda x: x.image):
        yield list(g)


def got(df):
    return sorted((r.image_id, r.category_id, round(r.score, 9), *(round(v, 9) for v in (r.x1, r.y1, r.x2, r.y2)), r.source) for r in df.collect())


def said(rows):
    return sorted((i, c, round(s, 9), *(round(v, 9) for v in b), source) for i, c, s, b, source in rows)


def nms(rows, hits, most):
    kept = []
    for x in rows:
        if not any(k.cls == x.cls and hits(iou(k.box, x.box)) for k in kept):
            kept.append(x)
    return kept[:most]


def weight(x, low, high, base=1.0):
    return min(high, max(low, 1 + x.q)) if x.source == "local" else base


class Group:
    def __init__(self, cls):
        self.cls, self.members = cls, []

    @property
    def box(self):
        mass = sum(s * w for _, s, w in self.members)
        return tuple(sum(b[k] * s * w for b, s, w in self.members) / mass for k in range(4))

    @property
    def score(self):
        return min(1.0, max(0.0, sum(s * w for _, s, w in self.members) / sum(w for _, _, w in self.members)))


def clusters(rows, weights, least):
    groups = []
    for x, w in zip(rows, weights):
        mine = [(iou(g.box, x.box), k) for k, g in enumerate(groups) if g.cls == x.cls]
        top = max(mine, default=(0.0, -1))
        if not mine or top[0] < least:
            groups.append(Group(x.cls))
            top = (1.0, len(groups) - 1)
        groups[top[1]].members.append((x.box, x.score, w))
    return groups


@pytest.mark.parametrize("seed", range(2))
def test_hard_and_classwise_suppression(spark, seed):
    rows = some(seed, sources=("base", "flip", "local"))
    order = lambda x: (*x.best_first(), x.source, x.det)
    hard, merged = [], []
    for g in by_image(rows):
        hard += nms(sorted((x for x in g if x.score >= 0.25), key=order), lambda v: v >= 0.5, 3)
        merged += nms(sorted(g, key=order), lambda v: v > 0.5, 3)
    flat = lambda kept: said((x.image, x.cls, x.score, x.box, x.source) for x in kept)
    assert got(fusion.hard_nms(table(spark, rows), 0.5, 0.25, 3)) == flat(hard)
    views = [table(spark, [x for x in rows if x.source == s]) for s in ("base", "flip", "local")]
    assert got(fusion.classwise_nms_merge(views, 0.5, 3)) == flat(merged)


@pytest.mark.parametrize("seed", range(2))
def test_soft_suppression(spark, seed):
    rows, want = some(seed), []
    for g in by_image(rows):
        left = sorted((x for x in g if x.score >= 0.05), key=lambda x: (x.cls, *x.box, -x.score, x.det))
        now = {x.det: min(1.0, x.score * weight(x, 0.5, 1.5)) if x.source == "local" else x.score for x in left}
        taken = 0
        while left and taken < 5:
            best = max(left, key=lambda x: now[x.det])  # the first of equals
            if now[best.det] < 0.25:
                break
            want.append((best.image, best.cls, now[best.det], best.box, "soft_nms"))
            taken += 1
            left.remove(best)
            for x in left:
                if x.cls == best.cls:
                    now[x.det] *= math.exp(-(iou(best.box, x.box) ** 2) / 0.5)
            left = [x for x in left if now[x.det] >= 0.05]
    assert got(fusion.soft_nms(table(spark, rows), 0.5, 0.05, 0.25, 0.5, 1.5, 5)) == said(want)


@pytest.mark.parametrize("seed", range(3))
def test_weighted_fusion(spark, seed):
    rows, want = [x for x in some(seed) if x.box[2] > x.box[0]], []
    for g in by_image(rows):
        ordered = sorted((x for x in g if x.score >= 0.05), key=lambda x: (x.cls, -x.score * weight(x, 0.5, 1.5, 0.7), *x.box, x.source, x.det))
        groups = clusters(ordered, [weight(x, 0.5, 1.5, 0.7) for x in ordered], 0.3)
        while True:
            pair = next(((a, b) for a, b in itertools.combinations(range(len(groups)), 2) if groups[a].cls == groups[b].cls and iou(groups[a].box, groups[b].box) >= 0.3), None)
            if pair is None:
                break
            groups[pair[0]].members += groups.pop(pair[1]).members
        best = sorted((x for x in groups if x.score >= 0.25), key=lambda x: (-x.score, x.cls, *x.box))[:4]
        want += [(g[0].image, x.cls, x.score, x.box, "wbf") for x in best]
    assert got(fusion.weighted_box_fusion(table(spark, rows), 0.3, 0.05, 0.25, 0.7, 0.5, 1.5, 4)) == said(want)


def test_reference_fusion(spark):
    rows, want = [x for x in some(5) if x.box[2] > x.box[0]], []
    for g in by_image(rows):
        ordered = sorted(g, key=lambda x: (x.cls, -x.score, *x.box, x.det))
        want += [(g[0].image, x.cls, x.score, x.box, "utility_reference") for x in clusters(ordered, [1.0] * len(ordered), 0.4)]
    assert got(fusion.fuse_reference(table(spark, rows), 0.4)) == said(want)


@pytest.mark.parametrize("seed", range(3))
def test_anchored_fusion(spark, seed):
    rows, want = some(seed), []
    for g in by_image(rows):
        anchors = sorted((x for x in g if x.source == "base" and x.score >= 0.25), key=lambda x: (*x.best_first(), x.det))[:4]
        local = sorted((x for x in g if x.source == "local" and x.score >= 0.05 and x.q >= 0.1), key=lambda x: x.det)
        used, out = set(), []
        for a in anchors:
            mine = [x for x in local if x.det not in used and x.cls == a.cls and x.score >= 0.25 and iou(a.box, x.box) >= 0.4]
            used |= {x.det for x in mine}
            group = Group(a.cls)
            group.members = [(a.box, a.score, 0.7)] + [(x.box, x.score, weight(x, 0.5, 1.5)) for x in mine]
            out.append((a.cls, max([a.score] + [x.score for x in mine]), group.box if mine else a.box, "anchored_wbf_match" if mine else "anchored_wbf_base"))
        room = 4 - len(out)
        for x in sorted((x for x in local if x.det not in used and x.score >= 0.5), key=Row.best_first):
            if room and not any(c == x.cls and iou(b, x.box) >= 0.3 for c, _, b, _ in out):
                out.append((x.cls, x.score, x.box, "anchored_wbf_rescue"))
                room -= 1
        want += [(g[0].image, *x) for x in out]
    made = fusion.anchored_wbf(table(spark, rows), threshold=0.3, anchor_iou=0.4, q_min=0.1, probe=0.05, publish=0.25, rescue=0.5, base_weight=0.7, low=0.5, high=1.5, max_det=4)
    assert got(made) == said(want)


@pytest.mark.parametrize("seed", range(3))
def test_consensus(spark, seed):
    rows, want = some(seed, sources=("base", "flip", "local", "local")), []
    for g in by_image(rows):
        anchors = [x for x in g if x.source == "base" and x.score >= 0.75]
        flips = [x for x in g if x.source == "flip" and x.score >= 0.3]
        found = []
        for x in sorted((x for x in g if x.source == "local" and x.q > 0 and x.score >= 0.3), key=lambda x: (*x.best_first(), x.det)):
            same = [(iou(f.box, x.box), f.score) for f in flips if f.cls == x.cls and iou(f.box, x.box) >= 0.5]
            if any(a.cls == x.cls and iou(a.box, x.box) >= 0.5 for a in anchors) or not same or any(c == x.cls and iou(b, x.box) > fusion.RESCUE_IOU for c, _, b in found):
                continue
            found.append((x.cls, min(x.score, max(same)[1]), x.box))
        found = sorted(found, key=lambda x: (-x[1], x[0], *x[2]))[: max(0, 3 - len(anchors))]
        want += [(a.image, a.cls, a.score, a.box, "base") for a in anchors] + [(g[0].image, *x, "guard_consensus_rescue") for x in found]
    assert got(fusion.consensus_anchor(table(spark, rows), 0.75, 0.3, 0.5, 3)) == said(want)


def pairs_of(seed):
    r = random.Random(seed)
    return [(i, a, b, r.choice([0.5, 0.6, r.random()]), r.choice([0.3, 0.9, r.random()])) for i in range(30) for a in range(r.randint(1, 7)) for b in range(r.randint(1, 7)) if r.random() < 0.6]


@pytest.mark.parametrize("seed", range(2))
def test_matching_and_f1(spark, seed):
    rows = pairs_of(seed)
    score = {(i, b): s for i, _, b, _, s in rows}
    rows = [(i, a, b, v, score[i, b]) for i, a, b, v, _ in rows]
    pairs = spark.createDataFrame(rows, "image_id long, left_id long, right_id long, iou double, r_score double").repartition(3)

    def greedy(g, key):
        left, right, out = set(), set(), []
        for x in sorted(g, key=key):
            if x[1] not in left and x[2] not in right:
                left.add(x[1])
                right.add(x[2])
                out.append(x[:3])
        return out

    images = [list(g) for _, g in itertools.groupby(rows, key=lambda x: x[0])]
    want = [x for g in images for x in greedy(g, lambda x: (-x[3], x[1], x[2]))]
    assert sorted((r.image_id, r.left_id, r.right_id) for r in matching.greedy_match(pairs).collect()) == sorted(want)
    best = {g[0][0]: max(((len(m), sum(x[3] for x in m)) for m in matchings(g)), default=(0, 0.0)) for g in images if len(g) <= 10}
    found = [x for x in matching.assignment_match(pairs).collect()]
    for i, (n, total) in best.items():
        mine = [x for x in found if x.image_id == i]
        assert len(mine) == n and math.isclose(sum(x.iou for x in mine), total) and len({x.left_id for x in mine}) == len({x.right_id for x in mine}) == n
    truth = spark.createDataFrame([(i, a) for i in range(31) for a in range(3)], "image_id long, ann_id long").where("image_id <> 29")
    dets = spark.createDataFrame([(i, a) for i in range(31) for a in range(2)], "image_id long, det_id long").where("image_id <> 29")
    tp = {g[0][0]: len(greedy(g, lambda x: (-x[4], x[2], -x[3], -x[1]))) for g in images}
    f1 = {r.image_id: r.f1 for r in matching.detection_f1(spark.range(31).withColumnRenamed("id", "image_id"), truth, dets, pairs).collect()}
    assert f1 == {i: 2 * tp.get(i, 0) / 5 if i != 29 else 1.0 for i in range(31)}


def matchings(edges):
    yield []
    for k, e in enumerate(edges):
        for rest in matchings([x for x in edges[k + 1 :] if x[1] != e[1] and x[2] != e[2]]):
            yield [e, *rest]


@pytest.mark.parametrize("seed", range(20))
def test_pairs_of_boxes(seed, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_PAIRS", [1, 50, 10**6][seed % 3])
    r = np.random.default_rng(seed)

    def side():
        n = int(r.integers(0, 40))
        at = r.integers(0, 15, (n, 2)).astype(float)
        return r.integers(0, 4, n), np.concatenate([at, at + r.integers(0, 9, (n, 2))], axis=1)

    (g, a), (h, b) = side(), side()
    for least, inclusive in ((0.3, True), (0.0, False), (1.0, True)):
        i, j, v = S.near_pairs(g, a, h, b, least, inclusive)
        want = [(x, y, iou(a[x], b[y])) for x in range(len(a)) for y in range(len(b)) if g[x] == h[y] and (iou(a[x], b[y]) >= least if inclusive else iou(a[x], b[y]) > least)]
        assert list(zip(i.tolist(), j.tolist(), v.tolist())) == want
    with pytest.raises(ValueError):
        S.near_pairs(g, a, h, b, 0.0)


def test_groups_stay_whole_over_batches(spark):
    rows = [(i // 37, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "image_id long, v long").repartition(4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        out = S.segmented(df, ["image_id"], ["v"], lambda c, s: {"image_id": c["image_id"][s], "n": np.diff(np.append(s, len(c["v"]))), "first": c["v"][s]}, "image_id long, n long, first long", rows=25).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, out)) == [(k, min(37, 3000 - 37 * k), 37 * k) for k in range(82)]
    assert S.segmented(df.limit(0), ["image_id"], ["v"], lambda c, s: c, "image_id long, v long").count() == 0


def test_one_image_of_many_boxes(spark):
    n = 3000
    df = spark.range(n).select(F.lit(1).cast("long").alias("image_id"), F.col("id").alias("det_id"), F.lit(1).alias("category_id"), (1 - F.col("id") / n).alias("score"), (F.col("id") % 50 * 10.0).alias("x1"), F.lit(0.0).alias("y1"), (F.col("id") % 50 * 10.0 + 9).alias("x2"), F.lit(9.0).alias("y2"))
    assert fusion.hard_nms(fusion.with_source(df, "base"), 0.5, 0.0, 300).count() == 50


def test_ranges_of_equal_scores_are_even(spark):
    from gridlark.operators import coco_eval

    n = 16_000
    rows = spark.range(n).select((F.col("id") % 2).cast("int").alias("category_id"), F.lit(0.5).alias("score"), (F.col("id") % 97).alias("image_id"), F.col("id").alias("det_id"), (F.col("id") % 3 == 0).cast("int").alias("tp"), F.lit(1).alias("weight"))
    ranged = coco_eval.score_ranges(rows, ["category_id"], 8)
    sizes = [r["count"] for r in ranged.groupBy("_b").count().collect()]
    assert sum(sizes) == n and len(sizes) >= 7 and max(sizes) <= 2 * n / 8
    # the order of ranges is the order of rows
    best = {(r._b, r.category_id): (r.low, r.high) for r in ranged.groupBy("_b", "category_id").agg(F.min(F.struct("image_id", "det_id")).alias("low"), F.max(F.struct("image_id", "det_id")).alias("high")).collect()}
    for (b, c), (low, _) in best.items():
        for (b2, c2), (_, high) in best.items():
            assert c != c2 or b2 <= b or high < low
    # the envelope by a plain walk
    got = {(r.category_id, r.det_id): (r.ctp, r.envelope) for r in coco_eval.envelope(rows, ["category_id"]).collect()}
    for c in (0, 1):
        walk = sorted((r.image_id, r.det_id, r.tp) for r in rows.where(F.col("category_id") == c).collect())
        true = np.cumsum([t for *_, t in walk])
        precision = np.maximum.accumulate((true / (np.arange(1, len(walk) + 1) + coco_eval.EPS))[::-1])[::-1]
        assert all(got[c, d][0] == t and math.isclose(got[c, d][1], p, rel_tol=1e-12) for (_, d, _), t, p in zip(walk, true, precision))


def test_floors_are_swept_without_repeated_rows(spark, monkeypatch):
    """AP at every floor is that of the rows at or above it alone, and a row is dealt once whatever the number of floors."""
    from gridlark.operators import coco_eval

    dealt = []
    ranges = coco_eval.score_ranges
    monkeypatch.setattr(coco_eval, "score_ranges", lambda df, keys, n=None: dealt.append(ranges(df, keys, n)) or dealt[-1])
    rows = spark.range(4000).select((F.col("id") % 3).cast("int").alias("category_id"), ((F.col("id") * 7919) % 101 / 100).alias("score"), (F.col("id") % 97).alias("image_id"), F.col("id").alias("det_id"), ((F.col("id") * 31) % 7 < 3).cast("int").alias("tp"), (1 + F.col("id") % 2).cast("int").alias("weight"))
    rows = rows.where("category_id < 2 or score < 0.5")
    npos = spark.createDataFrame([(0, 900), (1, 1100), (2, 1000), (3, 5), (4, 0)], "category_id int, npos long")
    floors = [0.25, 0.05, 0.5, 2.0]
    got = {(x.category_id, x.floor): (x.ap, x.change) for x in coco_eval.score_floor_sweep(rows, npos, ["category_id"], floors).collect()}
    assert len(dealt) == 1 and dealt[0].count() == rows.where("score >= 0.05").count()
    plain = {(x.category_id, f): x.ap for f in floors for x in coco_eval.average_precision(rows.where(F.col("score") >= f), npos, ["category_id"]).collect()}
    assert got.keys() == plain.keys() and got[3, 0.05] == (0.0, 0.0)
    assert all(math.isclose(got[k][0], plain[k], abs_tol=1e-12) and math.isclose(got[k][1], plain[k] - plain[k[0], 0.05], abs_tol=1e-12) for k in plain)


def test_unions_are_dealt_before_a_kernel(spark):
    """Spark may drop a repartition by the key itself over a union whose sides seem dealt by it; images then fall apart."""
    sides = [spark.range(100).selectExpr("id % 10 AS image_id", "id AS v").repartition(4, "image_id") for _ in range(2)]
    out = S.segmented(sides[0].unionByName(sides[1]), ["image_id"], ["v"], lambda c, starts: {"image_id": c["image_id"][starts], "n": np.diff(np.append(starts, len(c["v"])))}, "image_id long, n long")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(hash(image_id" in plan[: plan.index("Union")]
    assert sorted(map(tuple, out.collect())) == [(i, 20) for i in range(10)]
