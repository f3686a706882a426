"""Average precision.  Matching is a kernel over many (image, class) groups at once; everything after it is grouped and windowed columns.

Cumulative counts and the precision envelope are taken in ranges of scores: windows run inside a range and totals of
ranges are carried over, so no task ever sorts all detections of a class.  Ranges hold like numbers of rows: Spark samples
the rows by class, score and place, so equal or crowded scores are split too.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from . import segments as S
from .fusion import SIDES

THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
EPS = 2.0**-52
#: Rows of a range of scores: more rows make more ranges, not larger tasks.
RANGE_ROWS = 1_000_000


def cap_detections(df: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("image_id", "category_id").orderBy(F.desc("score"), "det_id"))
    return df.withColumn("place", place).where(F.col("place") <= k)


def _covered(group_d: np.ndarray, d: np.ndarray, group_t: np.ndarray, t: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(detection, crowd box, share of the detection inside it) of at least ``least``."""
    found = []
    for i, j in S.touching(group_d, d, group_t, t):
        common = np.clip(np.minimum(d[i, 2:], t[j, 2:]) - np.maximum(d[i, :2], t[j, :2]), 0, None).prod(axis=1)
        share = common / np.maximum((d[i, 2] - d[i, 0]) * (d[i, 3] - d[i, 1]), 1e-300)
        found.append((i[share >= least], j[share >= least], share[share >= least]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _assigned(group: np.ndarray, i: np.ndarray, j: np.ndarray, near: np.ndarray, crowd: np.ndarray, skip: np.ndarray, far: np.ndarray, thresholds: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """[detection, area, threshold]: true positive, ignored.  ``group``: of each detection, in order of places; (i, j): detections
    and truth boxes that may match; ``skip`` [area, truth], ``far`` [area, detection]: outside the range.

    Step k decides the k-th contested detection of every group, all areas and thresholds at once: the box of largest overlap,
    later of equals, among countable ones, or else among those that are skipped."""
    shape = (len(group), len(skip), len(thresholds))
    tp, ignored = np.zeros(shape, bool), np.broadcast_to(far.T[:, :, None], shape).copy()
    order = np.lexsort((j, near, i))
    i, j, near = i[order], j[order], near[order]
    least = np.minimum(np.array(thresholds), 1 - 1e-10)
    free = np.ones((len(crowd), len(skip), len(thresholds)), bool)
    first = S.changes(i)
    size, det = np.diff(np.append(first, len(i))), i[first]
    turn = S.place_in(group[det])
    by_turn = np.argsort(turn, kind="stable")
    steps = np.searchsorted(turn[by_turn], np.arange(int(turn.max(initial=-1)) + 2))
    for k in range(len(steps) - 1):
        now = by_turn[steps[k] : steps[k + 1]]
        pair = S.ranges(first[now], size[now])
        opens = np.cumsum(size[now]) - size[now]
        truth = j[pair]
        ok = (near[pair][:, None] >= least)[:, None, :] & (free[truth] | crowd[truth][:, None, None])
        place = np.arange(len(pair))[:, None, None]
        real = np.maximum.reduceat(np.where(ok & ~skip.T[truth][:, :, None], place, -1), opens, axis=0)
        last = np.where(real >= 0, real, np.maximum.reduceat(np.where(ok, place, -1), opens, axis=0))
        d, area, level = np.nonzero(last >= 0)
        won = truth[last[d, area, level]]
        free[won, area, level] = False
        out = skip[area, won]
        tp[det[now[d]], area, level], ignored[det[now[d]], area, level] = ~out, out
    return tp, ignored


def match_packed(truth: DataFrame, detections: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, areas: tuple[str, ...] = tuple(AREAS), max_det: int = 100) -> DataFrame:
    """One row a detection; bits of ``tps`` and ``ignoreds`` tell areas and, inside them, thresholds.  ``truth`` may have ``iscrowd``."""
    crowd = F.col("iscrowd") if "iscrowd" in truth.columns else F.lit(0)
    capped = cap_detections(detections, max_det)
    gt = truth.select("image_id", "category_id", F.col("ann_id").alias("id"), F.lit(-1.0).alias("score"), *SIDES, crowd.cast("int").alias("crowd"), F.lit(0).alias("place"))
    dt = capped.select("image_id", "category_id", F.col("det_id").alias("id"), "score", *SIDES, F.lit(-1).alias("crowd"), "place")
    low, high = (np.array([AREAS[a][i] for a in areas])[:, None] for i in (0, 1))
    ways = [(a, t) for a in areas for t in thresholds]
    if len(ways) > 63:
        raise ValueError("at most 63 areas and thresholds together: a detection's outcomes are the bits of two numbers")
    bits = np.int64(1) << np.arange(len(ways), dtype=np.int64)

    def kernel(c: S.Columns, starts: np.ndarray) -> dict:
        group, box = S.numbered(starts, len(c["id"])), np.stack([c[s] for s in SIDES], axis=1)
        t, d = np.flatnonzero(c["crowd"] >= 0), np.flatnonzero(c["crowd"] < 0)
        size = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
        many = c["crowd"][t] == 1
        least = min(min(thresholds), 1 - 1e-10)
        one, all_ = np.flatnonzero(~many), np.flatnonzero(many)
        i, j, near = S.near_pairs(group[d], box[d], group[t[one]], box[t[one]], least)
        i2, j2, part = _covered(group[d], box[d], group[t[all_]], box[t[all_]], least)  # a crowd covers a detection by its share of the detection alone
        i, j, near = np.concatenate([i, i2]), np.concatenate([one[j], all_[j2]]), np.concatenate([near, part])
        tp, ignored = _assigned(group[d], i, j, near, many, many | (size[t] < low) | (size[t] > high), (size[d] < low) | (size[d] > high), thresholds)
        out = {"image_id": c["image_id"][d], "category_id": c["category_id"][d], "det_id": c["id"][d], "score": c["score"][d], "place": c["place"][d]}
        return out | {"tps": tp.reshape(len(d), -1) @ bits, "ignoreds": ignored.reshape(len(d), -1) @ bits}

    # truth boxes of groups without detections match nothing
    keys = ["image_id", "category_id"]
    met = gt.join(capped.select(*keys).distinct(), keys, "left_semi")
    return S.segmented(met.unionByName(dt), keys, [F.desc("crowd"), "place", "id"], kernel, "image_id long, category_id int, det_id long, score double, place int, tps long, ignoreds long")


def match_coco(truth: DataFrame, detections: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, areas: tuple[str, ...] = tuple(AREAS), max_det: int = 100) -> DataFrame:
    """One row a detection, threshold and area range.  ``truth`` may have ``iscrowd``."""
    packed = match_packed(truth, detections, thresholds, areas, max_det)
    ways = [(a, t) for a in areas for t in thresholds]
    way = F.explode(F.array(*[F.struct(F.lit(a).alias("area"), F.lit(t).alias("threshold"), F.lit(k).alias("bit")) for k, (a, t) in enumerate(ways)]))
    each = packed.withColumn("way", way)
    return each.select(
        "image_id", "category_id", "det_id", "score", "place", "way.area", "way.threshold", F.expr("cast(shiftright(tps, way.bit) & 1 AS int)").alias("tp"), F.expr("shiftright(ignoreds, way.bit) & 1 = 1").alias("ignored")
    )


def positives(truth: DataFrame, keys: list[str], areas: tuple[str, ...] = ("all",)) -> DataFrame:
    """Countable truth boxes by keys, class and area range."""
    size = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    named = F.array(*[F.when((size >= AREAS[a][0]) & (size <= AREAS[a][1]), F.lit(a)) for a in areas])
    real = truth.where("iscrowd = 0") if "iscrowd" in truth.columns else truth
    return real.withColumn("area", F.explode(named)).where("area is not null").groupBy(*keys, "area").agg(F.count("*").alias("npos"))


def dealt_by_score(df: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """``df`` in partitions that are about equal ranges of its order by keys, score (best first), image_id and det_id, with ``_b``: the
    number of the range, the greatest number first.  Equal scores go to several ranges.  ``df`` is read three times, so it should be cheap to read."""
    n = n or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    return df.repartitionByRange(n, *keys, F.desc("score"), "image_id", "det_id").withColumn("_b", F.lit(n - 1) - F.spark_partition_id())


def score_ranges(df: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """``dealt_by_score`` written once."""
    return written(dealt_by_score(df, keys, n), "score-ranges")


def envelope(df: DataFrame, keys: list[str], floors: list[float] | None = None) -> DataFrame:
    """``ctp`` (weighted true positives up to the row, best first) and the precision ``envelope``; rows with (weight, tp, score, image_id, det_id).

    With score ``floors`` the envelope is an array, one of the rows at or above each floor: the counts up to a row are the same for all."""
    rows = score_ranges(df, keys)
    hit = F.col("weight") * F.col("tp")
    totals = rows.groupBy(*keys, "_b").agg(F.sum(hit).alias("_t"), F.sum("weight").alias("_n"))
    above = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    start = totals.select(*keys, "_b", F.coalesce(F.sum("_t").over(above), F.lit(0)).alias("_t0"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n0"))
    inside = Window.partitionBy(*keys, "_b").orderBy(F.desc("score"), "image_id", "det_id")
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.join(start, [*keys, "_b"]).withColumn("ctp", F.col("_t0") + F.sum(hit).over(run)).withColumn("_prec", F.col("ctp") / (F.col("_n0") + F.sum("weight").over(run) + EPS))
    seen = [F.col("_prec")] if floors is None else [F.when(F.col("score") >= f, F.col("_prec")) for f in floors]
    tops = counted.groupBy(*keys, "_b").agg(*[F.max(c).alias(f"_m{i}") for i, c in enumerate(seen)])
    below = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    rest = tops.select(*keys, "_b", *[F.coalesce(F.max(f"_m{i}").over(below), F.lit(0.0)).alias(f"_rest{i}") for i in range(len(seen))])
    # the best precision from here on, as a running maximum of the reverse order: frames that end at the last row are quadratic
    reverse = Window.partitionBy(*keys, "_b").orderBy("score", F.desc("image_id"), F.desc("det_id")).rowsBetween(Window.unboundedPreceding, 0)
    best = [F.greatest(F.max(c).over(reverse), F.col(f"_rest{i}")) for i, c in enumerate(seen)]
    return counted.join(rest, [*keys, "_b"]).withColumn("envelope", best[0] if floors is None else F.array(*best)).drop("_b", "_t0", "_n0", "_prec", *[f"_rest{i}" for i in range(len(seen))])


def _recall_points() -> Column:
    """How many of the 101 recall points a row answers for: a true positive those between its recall and the one before."""
    gain = F.col("weight") * F.col("tp")
    return F.floor(100 * F.col("ctp") / F.col("npos")) - F.floor(100 * (F.col("ctp") - gain) / F.col("npos")) + F.when((F.col("ctp") == gain) & (gain > 0), 1).otherwise(0)


def average_precision(matches: DataFrame, npos: DataFrame, keys: list[str]) -> DataFrame:
    """AP by ``keys``: the mean of the envelope at 101 recall points.  A true positive answers for the recall points between its
    recall and the one before, so no join with the points is needed.  ``npos`` has a row a key; keys without matches get 0."""
    e = envelope(matches, keys).join(npos, keys)
    ap = e.groupBy(*keys).agg((F.sum(F.col("envelope") * _recall_points()) / 101).alias("ap"), (F.max("ctp") / F.first("npos")).alias("recall"))
    return npos.where("npos > 0").join(ap, keys, "left").select(*keys, F.coalesce("ap", F.lit(0.0)).alias("ap"), F.coalesce("recall", F.lit(0.0)).alias("recall"))


def evaluated(truth: DataFrame, matches: DataFrame, keys: list[str], areas: tuple[str, ...], thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """AP and recall by keys, class, area and threshold, from ``match_coco`` rows of these thresholds; they are read twice, so hand in a written table."""
    rows = matches.where("not ignored").select(*keys, "category_id", "area", "threshold", "image_id", "det_id", "score", "tp", F.lit(1).alias("weight"))
    npos = positives(truth, [*keys, "category_id"], areas)
    npos = npos.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    return average_precision(rows, npos, [*keys, "category_id", "area", "threshold"])


def evaluated_packed(truth: DataFrame, packed: DataFrame, ways: list[tuple[str, int, int | None]]) -> DataFrame:
    """category_id, way, ap, recall from a written table of ``match_packed``, in one walk for all ``ways``: (area, bit of the outcome,
    greatest place or none).  A detection stays one row, whatever the number of ways."""
    from .stats import ap_under_weights

    def taken(bits: str, value: str) -> Column:
        found = F.lit(0).cast("long")
        for k, (_, bit, most) in enumerate(ways):
            one = F.shiftleft(F.shiftright(F.col(bits), bit).bitwiseAND(F.lit(1).cast("long")).bitwiseXOR(F.lit(int(value == "not")).cast("long")), k)
            found = found.bitwiseOR(one if most is None else F.when(F.col("place") <= most, one).otherwise(F.lit(0).cast("long")))
        return found

    rows = packed.select(F.lit("").alias("run"), "category_id", "image_id", "det_id", "score", taken("tps", "is").alias("tp"), taken("ignoreds", "not").alias("counts"))
    areas = tuple({a: None for a, _, _ in ways})
    numbers = F.explode(F.array(*[F.struct(F.lit(a).alias("_area"), F.lit(k).alias("resample")) for k, (a, _, _) in enumerate(ways)]))
    need = positives(truth, ["category_id"], areas).withColumn("_way", numbers).where("area = _way._area").select("_way.resample", "category_id", "npos")
    return ap_under_weights(rows, need, len(ways), None).select("category_id", F.col("resample").alias("way"), "ap", "recall")


def ap_metrics(truth: DataFrame, detections: DataFrame, max_det: int = 300) -> DataFrame:
    """One row of COCO metrics.  AP uses the cap of 100 detections; AP50, AP75 and the sizes use ``max_det``."""
    packed = written(match_packed(truth, detections, max_det=max_det), "matches")
    n = len(THRESHOLDS)
    all_ = [(a, i * n + k, None) for i, a in enumerate(AREAS) for k in range(n)]
    ways = all_ + [("all", k, most) for most in (100, 1) for k in range(n)]
    e = written(evaluated_packed(truth, packed, ways), "ways")

    def mean(name: str, which: list[int], value: str = "ap") -> Column:
        return F.coalesce(F.avg(F.when(F.col("way").isin(which), F.col(value))), F.lit(-1.0)).alias(name)

    sizes = {a: [k for k, w in enumerate(all_) if w[0] == a] for a in AREAS}
    hundred, one = (list(range(len(all_) + i * n, len(all_) + (i + 1) * n)) for i in (0, 1))
    return e.agg(
        mean("AP", hundred), mean("AP50", [THRESHOLDS.index(0.5)]), mean("AP75", [THRESHOLDS.index(0.75)]), *[mean(f"AP_{a}", sizes[a]) for a in ("small", "medium", "large")],
        mean("AR_1", one, "recall"), mean("AR_100", hundred, "recall"), mean("AR_max", sizes["all"], "recall"),
    )


def score_floor_sweep(matches: DataFrame, npos: DataFrame, keys: list[str], floors: list[float]) -> DataFrame:
    """AP at every score floor in one job, with the change from the lowest floor.  Rows are not repeated: a floor cuts the order off."""
    counted = envelope(matches.where(F.col("score") >= min(floors)), keys, floors).where("tp > 0").join(npos, keys)
    sums = [F.sum(F.when(F.col("score") >= f, F.col("envelope")[i] * _recall_points())) for i, f in enumerate(floors)]
    areas = counted.groupBy(*keys).agg(F.array(*[F.coalesce(x / 101, F.lit(0.0)) for x in sums]).alias("_ap"))
    levels = npos.where("npos > 0").join(areas, keys, "left")
    each = F.array(*[F.struct(F.lit(f).alias("floor"), F.coalesce(F.col("_ap")[i], F.lit(0.0)).alias("ap"), F.coalesce(F.col("_ap")[floors.index(min(floors))], F.lit(0.0)).alias("low")) for i, f in enumerate(floors)])
    return levels.select(*keys, F.inline(each)).select(*keys, "floor", "ap", (F.col("ap") - F.col("low")).alias("change"))


def floor_deltas(swept: DataFrame, keys: list[str], run: str, baseline: str, method: str) -> DataFrame:
    """keys, floor, delta of AP between two runs at every floor, and whether it is positive at all of them; ``swept`` has (run, keys, floor, ap)."""
    swept = written(swept, "swept")  # a row a floor, read three times
    a, b = (swept.where(F.col(run) == name).select(*keys, "floor", F.col("ap").alias(c)) for name, c in ((baseline, "_a"), (method, "_b")))
    d = a.join(b, [*keys, "floor"]).select(*keys, "floor", (F.col("_b") - F.col("_a")).alias("delta"))
    every = d.groupBy(*keys).agg((F.min("delta") > 0).alias("positive_at_all"), F.min("delta").alias("least_delta")) if keys else d.agg((F.min("delta") > 0).alias("positive_at_all"), F.min("delta").alias("least_delta"))
    return d.join(every, keys) if keys else d.crossJoin(F.broadcast(every))  # one row
