"""Suppression and fusion of boxes inside an image: order-dependent rules as numpy kernels over many images at once.

Inputs are flat box tables (image_id, det_id, category_id, score, x1..y2, and for crops region_id and q).  Images are
shuffled once by id and sorted inside partitions; a kernel gets some ten thousand rows of whole images (``segments``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import segments as S

SIDES = ["x1", "y1", "x2", "y2"]
FUSED = "image_id long, category_id int, score double, x1 double, y1 double, x2 double, y2 double, source string"
RESCUE_IOU = 0.70


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    side = np.minimum(a[:, None, 2:], b[None, :, 2:]) - np.maximum(a[:, None, :2], b[None, :, :2])
    common = np.clip(side, 0, None).prod(axis=2)
    area = [np.clip(m[:, 2:] - m[:, :2], 0, None).prod(axis=1) for m in (a, b)]
    union = area[0][:, None] + area[1][None, :] - common
    return np.divide(common, union, out=np.zeros_like(common), where=union > 0)


def _best_first(*more: str) -> list[str | Column]:
    """Highest score first, then class and corners, then whatever makes the order total."""
    return [F.desc("score"), "category_id", *SIDES, *more]


class _Boxes:
    """Rows of whole images."""

    def __init__(self, c: S.Columns, starts: np.ndarray):
        self.columns, self.n = c, len(c["score"])
        self.image = S.numbered(starts, self.n)  # number of the image in the chunk
        self.id, self.cls, self.score = c["image_id"], c["category_id"].astype(np.int64), c["score"]
        self.box = np.stack([c[s] for s in SIDES], axis=1)
        kinds, kind = np.unique(self.cls, return_inverse=True)
        self.group = self.image * max(1, len(kinds)) + kind  # an image's boxes of one class
        self.n_images = len(starts)

    def order(self, rows: np.ndarray, score: np.ndarray | None = None, box: np.ndarray | None = None, tie: np.ndarray | None = None) -> np.ndarray:
        """Places of ``rows`` by image, then best first."""
        score, box = self.score[rows] if score is None else score, self.box[rows] if box is None else box
        last = () if tie is None else (tie,)
        return np.lexsort((*last, *box.T[::-1], self.cls[rows], -score, self.image[rows]))

    def first(self, rows: np.ndarray, most: int | np.ndarray) -> np.ndarray:
        """Which of ``rows``, sorted by image, are among the first ``most`` of their image (a number or one for each image)."""
        image = self.image[rows]
        return S.place_in(image) < (most if isinstance(most, int) else most[image])

    def out(self, rows: np.ndarray, source: str | np.ndarray, score: np.ndarray | None = None, box: np.ndarray | None = None) -> dict:
        box = self.box[rows] if box is None else box
        named = np.full(len(rows), source, object) if isinstance(source, str) else source
        return {"image_id": self.id[rows], "category_id": self.cls[rows], "score": self.score[rows] if score is None else score, **dict(zip(SIDES, box.T)), "source": named}


def with_source(df: DataFrame, source: str) -> DataFrame:
    """A view's boxes with all columns that the kernels read."""
    extra = {"region_id": F.lit(-1), "q": F.lit(0.0)}
    df = df.withColumns({k: c for k, c in extra.items() if k not in df.columns})
    return df.select("image_id", "det_id", "category_id", "score", *SIDES, F.col("region_id").cast("int").alias("region_id"), F.col("q").cast("double").alias("q"), F.lit(source).alias("source"))


def _suppress(boxes: DataFrame, threshold: float, inclusive: bool, max_det: int) -> DataFrame:
    def kernel(c: S.Columns, starts: np.ndarray) -> dict:
        b = _Boxes(c, starts)
        rows = np.flatnonzero(S.suppressed(b.group, b.box, threshold, inclusive))
        rows = rows[b.first(rows, max_det)]
        return b.out(rows, c["source"][rows])

    return S.segmented(boxes, ["image_id"], _best_first("source", "det_id"), kernel, FUSED)


def hard_nms(boxes: DataFrame, threshold: float, publish: float, max_det: int) -> DataFrame:
    return _suppress(boxes.where(F.col("score") >= publish), threshold, True, max_det)


def classwise_nms_merge(views: list[DataFrame], threshold: float, max_det: int) -> DataFrame:
    """Boxes of two or three views; a box goes only if a better one overlaps it by more than the threshold."""
    union = views[0]
    for x in views[1:]:
        union = union.unionByName(x)
    return _suppress(union, threshold, False, max_det)


def local_weight(q: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.clip(1.0 + q, low, high)


def soft_nms(boxes: DataFrame, sigma: float, probe: float, publish: float, low: float, high: float, max_det: int) -> DataFrame:
    """Step k takes the best box that is left of every image and weakens what it overlaps."""

    def kernel(c: S.Columns, starts: np.ndarray) -> dict:
        b = _Boxes(c, starts)
        score = np.where(c["source"] == "local", np.minimum(1.0, b.score * local_weight(c["q"], low, high)), b.score)
        i, j, iou = S.near_pairs(b.group, b.box, b.group, b.box, 0.0, inclusive=False)
        decay, first = np.exp(-(iou**2) / sigma), np.searchsorted(i, np.arange(b.n + 1))
        live, rows, kept, final = np.ones(b.n, bool), np.arange(b.n), [], []
        while len(rows) and len(kept) < max_det:
            opens = S.changes(b.image[rows])
            top = np.maximum.reduceat(score[rows], opens)
            equal = score[rows] == np.repeat(top, np.diff(np.append(opens, len(rows))))
            best = rows[np.minimum.reduceat(np.where(equal, np.arange(len(rows)), len(rows)), opens)]  # rows are in order of ties
            over = score[best] < publish
            live[rows[np.isin(b.image[rows], b.image[best[over]])]] = False
            best = best[~over]
            kept.append(best)
            final.append(score[best])
            live[best] = False
            pairs = S.ranges(first[best], first[best + 1] - first[best])
            pairs = pairs[live[j[pairs]]]
            score[j[pairs]] *= decay[pairs]
            rows = rows[live[rows] & (score[rows] >= probe)]
            live[:] = False
            live[rows] = True
        rows, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (kept, final))
        order = np.argsort(b.image[rows], kind="stable")
        return b.out(rows[order], "soft_nms", score[order])

    order = ["category_id", *SIDES, F.desc("score"), "det_id"]
    return S.segmented(boxes.where(F.col("score") >= probe), ["image_id"], order, kernel, FUSED)


def _means(b: _Boxes, clusters: S.Clusters, slots: np.ndarray, source: str, publish: float | None, max_det: int | None) -> dict:
    """Clusters as rows, best first."""
    score, box = clusters.mean_score(slots), clusters.box[slots]
    if publish is not None:
        ok = score >= publish
        slots, score, box = slots[ok], score[ok], box[ok]
        order = b.order(slots, score, box)  # a slot is a row of the same image and class
        order = order[b.first(slots[order], max_det)]
        slots, score, box = slots[order], score[order], box[order]
    return b.out(slots, source, score, box)


def weighted_box_fusion(boxes: DataFrame, threshold: float, probe: float, publish: float, base_weight: float, low: float, high: float, max_det: int) -> DataFrame:
    def kernel(c: S.Columns, starts: np.ndarray) -> dict:
        b = _Boxes(c, starts)
        clusters, group, slots = S.gathered(b.group, b.box, b.score, c["w"], threshold)
        return _means(b, clusters, slots[S.settled(clusters, group, slots, threshold)], "wbf", publish, max_det)

    weight = F.when(F.col("source") == "local", F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), F.col("q") + 1.0))).otherwise(F.lit(float(base_weight)))
    rows = boxes.where(F.col("score") >= probe).withColumn("w", weight)
    return S.segmented(rows, ["image_id"], ["category_id", F.desc(F.col("score") * F.col("w")), *SIDES, "source", "det_id"], kernel, FUSED)


def _members(c: S.Clusters, at: np.ndarray, box: np.ndarray, score: np.ndarray, weight: np.ndarray) -> None:
    """Members to clusters, several to one in their order."""
    order = np.argsort(at, kind="stable")
    turn = S.place_in(at[order])
    for k in range(int(turn.max(initial=-1)) + 1):
        rows = order[turn == k]
        c.add(at[rows], box[rows], score[rows], weight[rows])


def anchored_wbf(boxes: DataFrame, threshold: float, anchor_iou: float, q_min: float, probe: float, publish: float, rescue: float, base_weight: float, low: float, high: float, max_det: int) -> DataFrame:
    """Published base boxes stay; reliable crop boxes refine them, and strong ones apart from all become rescues."""

    def kernel(c: S.Columns, starts: np.ndarray) -> dict:
        b = _Boxes(c, starts)
        base = np.flatnonzero((c["source"] == "base") & (b.score >= publish))
        base = base[b.order(base, tie=c["det_id"][base])]
        base = base[b.first(base, max_det)]
        local = np.flatnonzero((c["source"] == "local") & (b.score >= probe) & (c["region_id"] >= 0) & (c["q"] >= q_min))
        i, j, _ = S.near_pairs(b.group[base], b.box[base], b.group[local], b.box[local], anchor_iou)
        strong = b.score[local[j]] >= publish
        owner = np.full(len(local), len(base))  # a crop box goes to the first anchor that it meets
        np.minimum.at(owner, j[strong], i[strong])
        mine = np.flatnonzero(owner < len(base))
        met = np.zeros(len(base), bool)
        met[owner[mine]] = True
        clusters = S.Clusters(len(base))
        clusters.add(np.flatnonzero(met), b.box[base[met]], b.score[base[met]], np.full(int(met.sum()), float(base_weight)))
        _members(clusters, owner[mine], b.box[local[mine]], b.score[local[mine]], local_weight(c["q"][local[mine]], low, high))
        score, box = b.score[base].copy(), np.where(met[:, None], clusters.box, b.box[base])
        np.maximum.at(score, owner[mine], b.score[local[mine]])
        # rescues: free, strong, apart from everything above and from each other
        free = local[(owner == len(base)) & (b.score[local] >= rescue)]
        _, near, _ = S.near_pairs(b.group[base], box, b.group[free], b.box[free], threshold)
        apart = np.ones(len(free), bool)
        apart[near] = False
        free = free[apart]
        free = free[b.order(free)]
        free = free[S.suppressed(b.group[free], b.box[free], threshold, inclusive=True)]
        free = free[b.first(free, max_det - np.bincount(b.image[base], minlength=b.n_images))]
        rows = np.concatenate([base, free])
        score, box = np.concatenate([score, b.score[free]]), np.concatenate([box, b.box[free]])
        named = np.concatenate([np.where(met, "anchored_wbf_match", "anchored_wbf_base").astype(object), np.full(len(free), "anchored_wbf_rescue", object)])
        order = b.order(rows, score, box)
        return b.out(rows[order], named[order], score[order], box[order])

    return S.segmented(boxes, ["image_id"], ["det_id", "source", *SIDES], kernel, FUSED)


def consensus_anchor(boxes: DataFrame, publish: float, rescue: float, consensus_iou: float, max_det: int) -> DataFrame:
    """Published base boxes and, of the crop boxes, those that the flipped view confirms and no anchor covers."""

    def kernel(c: S.Columns, starts: np.ndarray) -> dict:
        b = _Boxes(c, starts)
        base = np.flatnonzero((c["source"] == "base") & (b.score >= publish))
        flips = np.flatnonzero((c["source"] == "flip") & (b.score >= rescue))
        local = np.flatnonzero((c["source"] == "local") & (c["q"] > 0) & (c["region_id"] >= 0) & (b.score >= rescue))
        local = local[b.order(local, tie=c["det_id"][local])]
        _, covered, _ = S.near_pairs(b.group[base], b.box[base], b.group[local], b.box[local], consensus_iou)
        i, j, iou = S.near_pairs(b.group[local], b.box[local], b.group[flips], b.box[flips], consensus_iou)
        order = np.lexsort((b.score[flips[j]], iou, i))
        confirmed = np.full(len(local), -1)
        confirmed[i[order]] = flips[j[order]]  # the last one written overlaps most, of equals has the best score
        ok = confirmed >= 0
        ok[covered] = False
        local, confirmed = local[ok], confirmed[ok]
        apart = S.suppressed(b.group[local], b.box[local], RESCUE_IOU, inclusive=False)
        local, confirmed = local[apart], confirmed[apart]
        score = np.minimum(b.score[local], b.score[confirmed])
        order = b.order(local, score)
        order = order[b.first(local[order], np.maximum(0, max_det - np.bincount(b.image[base], minlength=b.n_images)))]
        rows = np.concatenate([base, local[order]])
        named = np.concatenate([c["source"][base], np.full(len(order), "guard_consensus_rescue", object)])
        return b.out(rows, named, np.concatenate([b.score[base], score[order]]))

    return S.segmented(boxes, ["image_id"], ["det_id", "source", *SIDES], kernel, FUSED)


def fuse_reference(boxes: DataFrame, threshold: float) -> DataFrame:
    """Clusters of a class around their score-weighted box; the score is the plain mean."""

    def kernel(c: S.Columns, starts: np.ndarray) -> dict:
        b = _Boxes(c, starts)
        clusters, _, slots = S.gathered(b.group, b.box, b.score, np.ones(b.n), threshold)
        return _means(b, clusters, slots, "utility_reference", None, None)

    return S.segmented(boxes, ["image_id"], ["category_id", F.desc("score"), *SIDES, "det_id"], kernel, FUSED)


def published(fused: DataFrame, images: DataFrame) -> DataFrame:
    """Fused boxes clipped to their images (``clip_fused``): a box that would move by more than a pixel, a number that is none, a
    score outside 0 to 1 and an unknown image are errors; boxes left with less than a pixel of width or height go."""
    df = fused.join(images.select(F.col("image_id").alias("_image"), "width", "height"), F.col("image_id") == F.col("_image"), "left")
    numbers = F.array(*SIDES, "score")
    finite = ~F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    box = G.Box.of()
    inside = G.clip(box, F.col("width"), F.col("height"))
    wrong = (
        F.when(F.col("_image").isNull(), "unknown image").when(~finite, "not a number").when(G.largest_shift(box, inside) > 1.0 + 1e-9, "far outside").when((F.col("score") < 0) | (F.col("score") > 1), "score")
    )
    told = F.concat(F.lit("fused box of image "), F.col("image_id").cast("string"), F.lit(": "), wrong)
    clipped = df.withColumns(dict(zip(["_x1", "_y1", "_x2", "_y2"], inside, strict=True)))
    clipped = clipped.where(F.when(wrong.isNotNull(), F.raise_error(told).cast("boolean")).otherwise(F.expr("_x2 - _x1 >= 1 AND _y2 - _y1 >= 1")))
    return clipped.select("image_id", "category_id", "score", *[F.col(f"_{c}").alias(c) for c in SIDES], "source")


def fuse(boxes: DataFrame, method: str, publish: float, images: DataFrame | None = None, **options: float) -> DataFrame:
    """Choose the plan by name; images without crop boxes only pass the publishing threshold.  With ``images`` what comes out is clipped and checked (``published``)."""
    kernels = {"hard_nms": hard_nms, "soft_nms": soft_nms, "wbf": weighted_box_fusion, "anchored_wbf": anchored_wbf}
    if method not in kernels:
        raise ValueError(f"unknown fusion method {method}")
    crops = boxes.where("source = 'local'").select("image_id").distinct()
    fused = kernels[method](boxes.join(crops, "image_id", "left_semi"), publish=publish, **options)
    plain = boxes.join(crops, "image_id", "left_anti").where(F.col("score") >= publish)
    out = fused.unionByName(plain.select(F.col("image_id").cast("long"), "category_id", "score", *SIDES, "source"))
    return out if images is None else published(out, images)
