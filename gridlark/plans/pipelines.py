"""Composed operators over prediction tables (image_id, det_id, category_id, score, x1..y2; crops also region_id, q)."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import aggregates as A
from ..operators import coco_eval, fusion, joins, matching, select, windows
from ..operators.validate import publish_filter
from ..sources.shared import written

SIDES = ["x1", "y1", "x2", "y2"]


def unflipped(flip: DataFrame, images: DataFrame) -> DataFrame:
    df = flip.join(images.select("image_id", "width"), "image_id")
    return df.select(*[c for c in flip.columns if c not in SIDES], *G.restore_flip(G.Box.of(), F.col("width")).named())


def flip_merge(base: DataFrame, flip: DataFrame, images: DataFrame, threshold: float = 0.7, publish: float = 0.25, max_det: int = 300) -> DataFrame:
    views = [fusion.with_source(base, "base"), fusion.with_source(unflipped(flip, images), "flip")]
    return publish_filter(fusion.classwise_nms_merge(views, threshold, max_det), publish)


def candidate_bank_fuse(base: DataFrame, banks: list[DataFrame], method: str, publish: float, **options: float) -> DataFrame:
    union = fusion.with_source(base, "base")
    for b in banks:
        union = union.unionByName(fusion.with_source(b, "local"))
    return fusion.fuse(union, method, publish, **options)


def mapped_local(local: DataFrame, regions: DataFrame, images: DataFrame, pad: float = 0.1) -> DataFrame:
    """Crop boxes, already in image coordinates, that belong to their region."""
    known = regions.select("image_id", "region_id", "rx1", "ry1", "rx2", "ry2").join(images.select("image_id", "width", "height"), "image_id")  # regions meet images, not every box
    d = local.join(known, ["image_id", "region_id"])
    d = d.withColumns(dict(zip(SIDES, G.clip(G.Box.of(), F.col("width"), F.col("height")), strict=True)))
    core = G.Box.of("r")
    px, py = core.width * pad, core.height * pad
    ok = G.center_in(G.Box.of(), core) & (G.inside_share(G.Box.of(), G.Box(core.x1 - px, core.y1 - py, core.x2 + px, core.y2 + py)) >= G.CORE_SHARE)
    return d.where(ok & (G.Box.of().width >= G.LEAST_SIDE) & (G.Box.of().height >= G.LEAST_SIDE)).select(*local.columns)


def selected_regions(traits: DataFrame, candidates: DataFrame, budget: float = 0.25, most: int = 3) -> DataFrame:
    n = candidates.groupBy("image_id", "region_id").agg(F.count("*").alias("candidates"))
    scored = windows.combine_scores(traits.join(n, ["image_id", "region_id"], "left").fillna(0, ["candidates"]), 0.5, 0.25, 0.3)
    chosen = select.select_regions(scored.withColumn("area_ratio", F.lit(1 / 16)), "difficulty", budget, most)
    return chosen.select("image_id", F.explode("selected").alias("region_id"))


class Selective(NamedTuple):
    final: DataFrame  # fused boxes
    trace: DataFrame  # every attempt in every chosen region, identity as round 0
    work: DataFrame  # regions and candidates of every image


#: Numbers of images up to which all tasks hold them, so that boxes are cut to the images where they lie.
WHOLE_IDS = 2_000_000
#: What mends each component of degradation; ties between components go in this order.  Fixed values.
OPERATIONS = {"luminance": "gamma", "contrast": "clahe", "haze": "clahe", "blur": "unsharp", "entropy": None}
#: A crop and an attempt are single numbers in the kernels' image column: 4,096 regions an image, 8 rounds a region.
REGION_BITS, ROUND_BITS = 12, 3
CROP = ["image_id", "region_id"]


def _crop_id() -> Column:
    return F.shiftleft(F.col("image_id").cast("long"), REGION_BITS) + F.col("region_id")


def crop_references(base: DataFrame, identity: DataFrame, cores: DataFrame, threshold: float) -> DataFrame:
    """Boxes of each crop (``image_id`` is the crop's number) that base and identity agree on, numbered within the crop."""
    core = cores.select(F.col("image_id").alias("c_image"), "region_id", *G.Box.of("r").named("c_"))
    inside = base.join(core, (F.col("image_id") == F.col("c_image")) & G.center_in(G.Box.of(), G.Box.of("c_"))).select(*base.columns, "region_id")
    views = [fusion.with_source(df.withColumn("image_id", _crop_id()), name) for df, name in ((inside, "base"), (identity, "local"))]
    nth = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "category_id", *SIDES))
    return fusion.fuse_reference(views[0].unionByName(views[1]), threshold).withColumn("det_id", nth.cast("long"))


def evaluated_attempts(references: DataFrame, candidates: DataFrame, attempts: DataFrame, publish: float, match_iou: float, crop: int, full: int) -> DataFrame:
    """``attempts`` (image_id, region_id, round, operation) with the parts of their utility and q; nothing found where nothing is has the cost alone."""
    numbered = attempts.withColumn("attempt", F.shiftleft(_crop_id(), ROUND_BITS) + F.col("round"))
    ask = numbered.select(_crop_id().alias("image_id"), "attempt")
    wanted = references.join(ask, "image_id").drop("image_id").withColumnRenamed("attempt", "image_id")
    got = candidates.join(numbered, [*CROP, "operation"]).drop(*CROP).withColumnRenamed("attempt", "image_id")
    pairs = written(matching.assignment_match(joins.iou_join(wanted, got, match_iou, "det_id", "det_id")), "attempt-pairs")  # a kernel, read more than once
    utility = matching.candidate_utility(wanted, got, pairs, UTILITY, publish, 2.0, crop, full).withColumnRenamed("image_id", "attempt")
    cost = min(1.0, (crop / full) ** 2)
    parts = [c for c in utility.columns if c not in ("attempt", "compute", "q")]
    return numbered.join(utility, "attempt", "left").fillna(0.0, parts).fillna({"compute": cost, "q": -UTILITY["compute"] * cost}).drop("attempt")


def selective_regions(
    base: DataFrame, local: DataFrame, candidates: DataFrame, traits: DataFrame, components: DataFrame, regions: DataFrame, images: DataFrame, publish: float = 0.25,
    available: tuple[str, ...] = ("gamma", "clahe", "unsharp"), most_operations: int = 2, stop: tuple[float, float, float] = (0.2, 0.5, 0.1), conservative: bool = False, match_iou: float = 0.5, crop: int = 640, full: int = 1920,
) -> Selective:
    """Take the best regions within the area budget, try operations on their crops and fuse what helps.

    ``local`` holds what the untouched crops gave and ``candidates`` what each operation gave, in image coordinates;
    ``components`` the parts of a region's degradation.  Operations are routed by the largest components; each is judged by
    its utility against the boxes that base and the untouched crop agree on, and a first one that is good enough (``stop``:
    least q, least stability, most unsupported) ends the region's rounds.  The best with q above 0 replaces the untouched
    crop; without one the untouched boxes stay with q 0, or go if ``conservative``."""
    chosen = written(selected_regions(traits, base.join(local.select("det_id", "region_id"), "det_id")), "chosen-regions")
    # what follows reads each of these several times
    cores = written(regions.join(chosen, CROP), "cores")
    identity = written(mapped_local(local, cores, images), "untouched-crops")
    found = written(mapped_local(candidates, cores, images), "mended-crops")
    routed = select.route_operations(OPERATIONS, list(available), most_operations)
    attempts = components.join(chosen, CROP).select(*CROP, F.posexplode(routed).alias("round", "operation")).withColumn("round", F.col("round") + 1)
    attempts = written(attempts, "routed")
    references = written(crop_references(base, identity, cores, 0.55), "crop-references")
    scored = written(evaluated_attempts(references, found, attempts, publish, match_iou, crop, full), "attempts")
    run = written(select.early_stop(scored.withColumn("unsupported", F.col("unsupported_fp")), CROP, *stop, first=1).drop("unsupported"), "rounds")
    best = select.choose_best(run, CROP).select(*CROP, "operation", F.col("q").alias("best_q"))
    plain = identity.join(best, CROP, "left_anti").withColumn("q", F.lit(0.0))
    mended = found.join(best, [*CROP, "operation"]).withColumn("q", F.col("best_q")).select(*identity.columns)
    crops = mended if conservative else mended.unionByName(plain)
    union = fusion.with_source(base, "base").unionByName(fusion.with_source(crops, "local"))
    final = fusion.fuse(union, "wbf", publish, threshold=0.55, probe=0.05, base_weight=1.0, low=0.5, high=1.5, max_det=300)
    untouched = chosen.join(best, CROP, "left").select(*CROP, F.lit(0).alias("round"), F.lit("identity").alias("operation"), F.lit(0.0).alias("q"), F.col("best_q").isNull().alias("selected"), F.lit(False).alias("early_stopped"))
    tried = run.join(best.withColumnRenamed("operation", "chosen"), CROP, "left").withColumn("selected", F.coalesce(F.col("operation") == F.col("chosen"), F.lit(False))).drop("chosen", "best_q")
    trace = tried.unionByName(untouched, allowMissingColumns=True)
    n = trace.groupBy("image_id").agg(F.count_if(F.col("round") == 0).alias("num_regions"), F.count("*").alias("num_candidates"))
    return Selective(final, trace, images.select("image_id").join(n, "image_id", "left").fillna(0))


def image_gate(local: DataFrame, regions: DataFrame, weights: dict[str, float]) -> DataFrame:
    return windows.score_uncertainty(local, regions, weights).groupBy("image_id").agg(F.max("uncertainty").alias("gate"))


def uncertainty_gate(
    base: DataFrame, local: DataFrame, candidates: DataFrame, traits: DataFrame, components: DataFrame, regions: DataFrame, images: DataFrame, weights: dict[str, float], gate: float, publish: float = 0.25
) -> DataFrame:
    """Region work only for images above the gate; the others publish their base boxes."""
    active = written(select.activate_threshold(image_gate(local, regions, weights), gate), "gates")  # five tables are cut to it, some of them read many times
    on = active.where("active").select("image_id")
    picked = selective_regions(*[df.join(on, "image_id", "left_semi") for df in (base, local, candidates, traits, components)], regions, images, publish).final
    plain = publish_filter(base.join(active.where("not active").select("image_id"), "image_id", "left_semi"), publish)
    return picked.unionByName(plain.select(F.col("image_id").cast("long"), "category_id", "score", *SIDES, F.lit("base").alias("source")))


def guarded_fusion(base: DataFrame, flip: DataFrame, local: DataFrame, regions: DataFrame, images: DataFrame, weights: dict[str, float], rate: float, consensus: bool, publish: float = 0.25) -> DataFrame:
    """The most uncertain share of images gets the merged or the consensus output."""
    gates = written(image_gate(local, regions, weights), "gates")  # counted, then ranked
    on = written(select.activate_fraction(gates, rate).select("image_id"), "gated-images")
    on = F.broadcast(on) if on.count() <= WHOLE_IDS else on  # four tables are cut to it
    base_on, flip_on, local_on = (df.join(on, "image_id", "left_semi") for df in (base, flip, local))
    views = [fusion.with_source(df, n) for df, n in ((base_on, "base"), (unflipped(flip_on, images), "flip"), (local_on, "local"))]
    if consensus:
        union = views[0].unionByName(views[1]).unionByName(views[2])
        active = fusion.consensus_anchor(union, publish, 0.5, 0.5, 300)
    else:
        active = publish_filter(fusion.classwise_nms_merge(views, 0.7, 300), publish)
    plain = publish_filter(base.join(on, "image_id", "left_anti"), publish)
    return active.unionByName(plain.select(F.col("image_id").cast("long"), "category_id", "score", *SIDES, F.lit("base").alias("source")))


def best_regions(base: DataFrame, traits: DataFrame, regions: DataFrame, most: int) -> DataFrame:
    """The ``most`` regions of each image with the largest difficulty (ties by id) and their ``slot`` from 0."""
    centers = base.select(F.col("image_id").alias("_i"), ((F.col("x1") + F.col("x2")) / 2).alias("_x"), ((F.col("y1") + F.col("y2")) / 2).alias("_y"))
    inside = (F.col("image_id") == F.col("_i")) & (F.col("_x") >= F.col("rx1")) & (F.col("_x") < F.col("rx2")) & (F.col("_y") >= F.col("ry1")) & (F.col("_y") < F.col("ry2"))
    n = regions.join(centers, inside).groupBy("image_id", "region_id").agg(F.count("*").alias("candidates"))
    scored = windows.combine_scores(traits.join(n, ["image_id", "region_id"], "left").fillna(0, ["candidates"]), 0.5, 0.25, 0.3)
    nth = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("difficulty"), "region_id"))
    chosen = scored.withColumn("slot", nth - 1).where(F.col("slot") < most).select("image_id", "region_id", "slot")
    return regions.join(chosen, ["image_id", "region_id"])


def packed_view_fusion(base: DataFrame, packed: DataFrame, regions: DataFrame, images: DataFrame, traits: DataFrame, gate: DataFrame, rate: float, cell: int = 320, publish: float = 0.25) -> DataFrame:
    """Boxes found on a 2 x 2 canvas of the four most difficult regions, best first, mapped back, kept where they help, and fused; in the
    share ``rate`` of images of largest ``gate`` (image_id, gate; see ``image_gate``)."""
    on = written(select.activate_fraction(gate, rate).select("image_id"), "gated-images")
    slots = best_regions(base, traits, regions, 4).join(on, "image_id", "left_semi")
    slot = G.packed_slot(F.col("slot"), G.Box.of("r"), cell, cell)
    slots = slots.select(F.col("image_id").alias("s_image"), "region_id", *G.Box.of("r").named("r"), *slot.content.named("s_"), slot.scale_x.alias("sx"), slot.scale_y.alias("sy"))
    content = G.Box.of("s_")
    found = packed.join(slots, (F.col("image_id") == F.col("s_image")) & G.center_in(G.Box.of(), content)).where(G.inside_share(G.Box.of(), content) >= G.CORE_SHARE)
    back = G.from_slot(G.Box.of(), G.Slot(F.lit(0), content, F.col("sx"), F.col("sy")), G.Box.of("r"))
    mapped = written(found.select("image_id", "det_id", "category_id", "score", "region_id", F.lit(0.1).alias("q"), *back.named()), "canvas-boxes")
    pairs = joins.iou_join(base, mapped, 0.5, "det_id", "det_id")
    useful = matching.candidate_utility(base.join(on, "image_id", "left_semi"), mapped, matching.assignment_match(pairs), UTILITY, publish, 2.0, cell * 2, 1920).where("q > 0").select("image_id")
    union = fusion.with_source(base, "base").unionByName(fusion.with_source(mapped.join(useful, "image_id", "left_semi"), "local"))
    return fusion.fuse(union, "wbf", publish, threshold=0.55, probe=0.05, base_weight=1.0, low=0.5, high=1.5, max_det=300)


#: Weights of the parts of a candidate's utility.
UTILITY = {"confidence_gain": 0.3, "stability": 0.3, "rescue": 0.2, "unsupported_fp": 0.1, "count_explosion": 0.05, "compute": 0.05}


def escalation_features(base: DataFrame, scout: DataFrame, images: DataFrame, classes: list[int]) -> DataFrame:
    """What a gate may know of an image before its full flip: size, both views, and how they differ."""
    w, h = F.col("width"), F.col("height")
    size = images.select("image_id", (w / 1000).alias("image_width_kpx"), (h / 1000).alias("image_height_kpx"), (w / h).alias("image_aspect"), (w * h / 1e6).alias("image_megapixels"))
    views = []
    for df, prefix in ((base, "b0"), (scout, "scout")):
        f = A.view_features(df, images, classes)
        views.append(f.select("image_id", *[F.col(c).alias(f"{prefix}_{c}") for c in f.columns if c != "image_id"]))
    pairs = joins.iou_join(base, scout, 0.3, "det_id", "det_id")
    return reduce(lambda a, b: a.join(b, "image_id"), [*views, A.cross_view_features(base, scout, pairs, images, classes)], size)


def scout_escalation(base: DataFrame, scout: DataFrame, full_flip: DataFrame, scores: DataFrame, rate: float, publish: float = 0.25, max_det: int = 500) -> DataFrame:
    """The output with the full flip for the share of images with the highest ``gate``, base and scout merged for the others."""
    on = select.activate_fraction(scores.select("image_id", "gate"), rate).select("image_id").withColumn("active", F.lit(True))
    routes = scores.select("image_id").join(on, "image_id", "left").fillna(False, ["active"])
    bypass = publish_filter(fusion.classwise_nms_merge([fusion.with_source(base, "base"), fusion.with_source(scout, "scout")], 0.7, max_det), publish)
    return select.route_outputs(routes, full_flip, bypass)


def evaluate_run(truth: DataFrame, detections: DataFrame, images: DataFrame) -> DataFrame:
    """AP by class over the evaluated images; images without detections count."""
    kept = truth.join(images.select("image_id"), "image_id", "left_semi"), detections.join(images.select("image_id"), "image_id", "left_semi")
    m = written(coco_eval.match_packed(*kept, areas=("all",)), "matches")
    return coco_eval.evaluated_packed(kept[0], m, [("all", k, None) for k in range(len(coco_eval.THRESHOLDS))]).groupBy("category_id").agg(F.avg("ap").alias("ap"), F.avg("recall").alias("recall"))
