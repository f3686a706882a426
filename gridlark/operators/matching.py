"""One-to-one matching of boxes: IoU candidates come from a Spark join, the pairs of many images are resolved together (``segments``)."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import segments as S

EPSILON = 1e-12


def _taken(pairs: DataFrame, order: list[str | Column], choose) -> DataFrame:
    """The pairs that ``choose(columns, starts)`` takes, of rows sorted by image and ``order``."""

    def kernel(c: S.Columns, starts: np.ndarray) -> dict:
        keep = choose(c, starts)
        return {n: x[keep] for n, x in c.items()}

    return S.segmented(pairs, ["image_id"], order, kernel, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema))


def _in_order(c: S.Columns, starts: np.ndarray) -> np.ndarray:
    return S.greedy_edges(S.numbered(starts, len(c["left_id"])), c["left_id"], c["right_id"])


def greedy_match(pairs: DataFrame) -> DataFrame:
    """Best IoU first (ties by left, then right id); each side is used once."""
    return _taken(pairs, [F.desc("iou"), "left_id", "right_id"], _in_order)


def greedy_matches(pairs: DataFrame, among: list[Column]) -> DataFrame:
    """``greedy_match`` of several choices of pairs, dealt once: bit k of ``taken`` tells that a pair is matched among those that
    ``among[k]`` lets in; pairs that are matched nowhere go."""
    bits = reduce(Column.bitwiseOR, [F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(among)])
    marked, n = pairs.withColumn("taken", bits), len(among)  # the kernel must not hold columns

    def kernel(c: S.Columns, starts: np.ndarray) -> dict:
        group, taken = S.numbered(starts, len(c["left_id"])), np.zeros(len(c["left_id"]), np.int32)
        for k in range(n):
            rows = np.flatnonzero((c["taken"] >> k) & 1)
            taken[rows[S.greedy_edges(group[rows], c["left_id"][rows], c["right_id"][rows])]] |= 1 << k
        return {n: x[taken > 0] for n, x in (c | {"taken": taken}).items()}

    return S.segmented(marked, ["image_id"], [F.desc("iou"), "left_id", "right_id"], kernel, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in marked.schema))


def least_cost(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a cheapest complete assignment of rows (rows <= columns): shortest augmenting paths with potentials."""
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m + 1), np.full(m + 1, -1)
    for row in range(n):
        owner[m] = row
        at, low, came, used = m, np.full(m + 1, np.inf), np.full(m + 1, m), np.zeros(m + 1, bool)
        while owner[at] >= 0:
            used[at] = True
            reduced = cost[owner[at]] - u[owner[at]] - v[:m]
            better = ~used[:m] & (reduced < low[:m])
            low[:m][better] = reduced[better]
            came[:m][better] = at
            free = np.where(used[:m], np.inf, low[:m])
            to = int(free.argmin())
            step = free[to]
            busy = np.flatnonzero(used)
            u[owner[busy]] += step
            v[busy] -= step
            low[:m][~used[:m]] -= step
            at = to
        while at != m:
            owner[at], at = owner[came[at]], came[at]
    out = np.full(n, -1)
    cols = np.flatnonzero(owner[:m] >= 0)
    out[owner[cols]] = cols
    return out


def assignment_match(pairs: DataFrame) -> DataFrame:
    """As many matches as possible, and of those the largest total IoU."""

    def choose(c: S.Columns, starts: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(c["iou"]), bool)
        for at, to in zip(starts, np.append(starts[1:], len(keep))):
            left, a = np.unique(c["left_id"][at:to], return_inverse=True)
            right, b = np.unique(c["right_id"][at:to], return_inverse=True)
            cost, row = np.full((len(left), len(right)), 1e6), np.full((len(left), len(right)), -1)
            cost[a, b], row[a, b] = 1 - c["iou"][at:to], np.arange(at, to)
            turn = len(left) > len(right)
            col = least_cost(cost.T if turn else cost)
            found = row[(col, np.arange(len(col))) if turn else (np.arange(len(col)), col)]
            keep[found[found >= 0]] = True
        return keep

    return _taken(pairs, ["left_id", "right_id"], choose)


def _clip01(c):
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def candidate_utility(reference: DataFrame, predictions: DataFrame, matches: DataFrame, weights: dict[str, float], publish: float, max_ratio: float, crop: int, full: int) -> DataFrame:
    """q and its parts for each image of ``reference``; ``matches`` is one-to-one (left: reference, right: predictions)."""
    n_ref = reference.groupBy("image_id").agg(F.count("*").alias("n_ref"))
    n_pred = predictions.groupBy("image_id").agg(F.count("*").alias("n_pred"))
    m = matches.groupBy("image_id").agg(
        F.count("*").alias("n"), F.avg(F.col("r_score") - F.col("l_score")).alias("gain"), F.avg("iou").alias("mean_iou"),
        F.sum(F.when((F.col("l_score") < publish) & (F.col("r_score") >= publish), F.col("r_score")).otherwise(0.0)).alias("rescued"),
    )
    lone = predictions.join(matches.select("image_id", F.col("right_id").alias("det_id")), ["image_id", "det_id"], "left_anti").groupBy("image_id").agg(F.sum(F.greatest(F.lit(0.0), F.col("score") - publish)).alias("loose"))
    df = n_ref.join(n_pred, "image_id", "full_outer").join(m, "image_id", "left").join(lone, "image_id", "left").fillna(0)
    parts = {
        "confidence_gain": _clip01(F.col("gain")),
        "stability": _clip01(F.col("n") / (F.col("n_ref") + EPSILON) * F.col("mean_iou")),
        "rescue": _clip01(F.col("rescued") / (F.col("n_ref") + EPSILON)),
        "unsupported_fp": _clip01(F.col("loose") / (F.col("n_pred") + EPSILON)),
        "count_explosion": _clip01(F.col("n_pred") / (F.col("n_ref") + 1.0) - max_ratio),
        "compute": F.lit(min(1.0, (crop / full) ** 2)),
    }
    q = F.lit(0.0)
    for name, w in weights.items():
        q = q + F.col(name) * (w if name in ("confidence_gain", "stability", "rescue") else -w)
    return df.select("image_id", *[c.alias(n) for n, c in parts.items()]).withColumn("q", q)


def flip_inconsistency(a: DataFrame, b: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """1 - 2 * matches / (boxes of both views), by group."""
    counts = a.select(*keys).unionByName(b.select(*keys)).groupBy(*keys).agg(F.count("*").alias("n_boxes"))
    m = matches.groupBy(*keys).agg(F.count("*").alias("n_matches"))
    return counts.join(m, keys, "left").select(*keys, _clip01(1 - 2 * F.coalesce("n_matches", F.lit(0)) / (F.col("n_boxes") + EPSILON)).alias("inconsistency"))


def detection_f1(images: DataFrame, truth: DataFrame, detections: DataFrame, pairs: DataFrame) -> DataFrame:
    """F1 of each image: detections by score, each takes the best free truth box of its pairs (the later of equals); two empty sides give 1."""

    best = [F.desc("r_score"), "right_id", F.desc("iou"), F.desc("left_id")]
    tp = _taken(pairs, best, _in_order).groupBy("image_id").agg(F.count("*").alias("tp"))
    a, b = (x.groupBy("image_id").agg(F.count("*").alias(n)) for x, n in ((truth, "n_gt"), (detections, "n_dt")))
    df = images.select("image_id").join(a, "image_id", "left").join(b, "image_id", "left").join(tp, "image_id", "left").fillna(0)
    both = F.col("n_gt") + F.col("n_dt")
    return df.select("image_id", F.when(both == 0, 1.0).otherwise(2 * F.col("tp") / F.greatest(both, F.lit(1))).alias("f1"))
