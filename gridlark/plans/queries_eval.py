"""Registered queries: fusion, matching, average precision, resampling, near-duplicates, sources, pixels, pipelines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import hooks
from ..operators import coco_eval as E
from ..operators import dedup as D
from ..operators import fusion as M
from ..operators import images as I
from ..operators import joins as J
from ..operators import matching as K
from ..operators import stats as B
from ..plans import pipelines as C
from ..registry import query
from ..sources import readers as R
from ..sources import writers as W
from ..sources import stored as T
from ..sources.shared import new_folder, written
from .queries_geometry import CLIP
from .queries_selection import WEIGHTS_U

SIDES = ["x1", "y1", "x2", "y2"]
CATEGORIES = [1, 2, 3]
OPTIONS = {"threshold": 0.55, "probe": 0.05, "base_weight": 1.0, "low": 0.5, "high": 1.5, "max_det": 300}


def r(*names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


def out(df):
    return df.select("image_id", "category_id", *r("score", *SIDES), "source")


def views(v, *names):
    made = {"base": v.xy_dt, "local": v.xy_local, "flip": None}
    if "flip" in names:
        made["flip"] = C.unflipped(v.xy_flip, v.images)
    return reduce(lambda a, b: a.unionByName(b), [M.with_source(made[n], n) for n in names])


def gt_pairs(v, t=0.5):
    return J.iou_join(v.xy_gt, v.xy_dt, t, "ann_id", "det_id")


@query("m1_greedy_match")
def _(v):
    return K.greedy_match(gt_pairs(v)).select(F.col("left_id").alias("ann_id"), F.col("right_id").alias("det_id"), *r("iou"))


@query("m2_assignment_match")
def _(v):
    return K.assignment_match(gt_pairs(v, 0.3)).select(F.col("left_id").alias("ann_id"), F.col("right_id").alias("det_id"), *r("iou"))


@query("m3_hard_nms")
def _(v):
    return out(M.hard_nms(views(v, "base", "local"), 0.55, 0.25, 300))


@query("m4_classwise_nms_merge")
def _(v):
    return out(M.classwise_nms_merge([views(v, "base"), views(v, "flip"), views(v, "local")], 0.7, 300))


@query("m5_soft_nms")
def _(v):
    return out(M.soft_nms(views(v, "base", "local"), 0.5, 0.05, 0.25, 0.5, 1.5, 300))


@query("m6_weighted_box_fusion")
def _(v):
    return out(M.weighted_box_fusion(views(v, "base", "local"), publish=0.25, **OPTIONS))


@query("m7_anchored_wbf")
def _(v):
    return out(M.anchored_wbf(views(v, "base", "local"), anchor_iou=0.5, q_min=0.1, publish=0.25, rescue=0.5, **OPTIONS))


@query("m8_consensus_anchor")
def _(v):
    return out(M.consensus_anchor(views(v, "base", "flip", "local"), 0.75, 0.5, 0.5, 300))


@query("m9_fuse_reference")
def _(v):
    return out(M.fuse_reference(views(v, "base", "local"), 0.55))


def clipped(df, v):
    """Boxes as a detector gives them: inside their image."""
    from ..functions import geometry as G

    met = df.join(v.images.select("image_id", "width", "height"), "image_id")
    return met.withColumns(dict(zip(SIDES, G.clip(G.Box.of(), F.col("width"), F.col("height")), strict=True))).select(*df.columns)


@query("m10_fuse")
def _(v):
    return out(M.fuse(clipped(views(v, "base", "local"), v), "wbf", 0.25, v.images, **OPTIONS))


UTILITY_SQL = """WITH m AS (SELECT b.image_id, b.ann_id, b.det_id, b.score AS rs, CAST(b.ann_id % 10 AS DOUBLE)/10 AS ls, b.iou FROM best b),
a AS (SELECT image_id, count(*) AS n_ref FROM gt GROUP BY 1), p AS (SELECT image_id, count(*) AS n_pred FROM dt GROUP BY 1),
g AS (SELECT image_id, count(*) AS n, avg(rs-ls) AS gain, avg(iou) AS mi, sum(CASE WHEN ls < 0.25e0 AND rs >= 0.25e0 THEN rs ELSE 0e0 END) AS resc FROM m GROUP BY 1),
l AS (SELECT image_id, sum(greatest(0e0, score-0.25e0)) AS loose FROM dt WHERE det_id NOT IN (SELECT det_id FROM m) GROUP BY 1),
j AS (SELECT coalesce(a.image_id, p.image_id) AS image_id, coalesce(n_ref,0) AS n_ref, coalesce(n_pred,0) AS n_pred FROM a FULL JOIN p ON a.image_id = p.image_id),
c AS (SELECT j.image_id, least(1e0,greatest(0e0,coalesce(gain,0e0))) AS confidence_gain, least(1e0,greatest(0e0,coalesce(n,0)/(n_ref+1e-12)*coalesce(mi,0e0))) AS stability, least(1e0,greatest(0e0,coalesce(resc,0e0)/(n_ref+1e-12))) AS rescue,
 least(1e0,greatest(0e0,coalesce(loose,0e0)/(n_pred+1e-12))) AS unsupported_fp, least(1e0,greatest(0e0,n_pred/(n_ref+1e0)-2)) AS count_explosion, 1/9e0 AS compute FROM j LEFT JOIN g USING (image_id) LEFT JOIN l USING (image_id))
SELECT image_id, round(0.3e0*confidence_gain+0.3e0*stability+0.2e0*rescue-0.1e0*unsupported_fp-0.05e0*count_explosion-0.05e0*compute, 6) AS q, round(stability, 6) AS stability, round(rescue, 6) AS rescue FROM c"""


def best_pairs(v):
    """The mutual-best match table in the layout of the match operators."""
    return J.mutual_best(gt_pairs(v))


@query("m11_candidate_utility", UTILITY_SQL)
def _(v):
    m = best_pairs(v).withColumn("l_score", (F.col("left_id") % 10).cast("double") / 10)
    return K.candidate_utility(v.gt, v.dt, m, C.UTILITY, 0.25, 2.0, 640, 1920).select("image_id", *r("q", "stability", "rescue"))


@query("m12_flip_inconsistency", "WITH n AS (SELECT image_id, count(*) AS n FROM (SELECT image_id FROM gt UNION ALL SELECT image_id FROM dt) u GROUP BY 1), m AS (SELECT image_id, count(*) AS m FROM best GROUP BY 1) SELECT image_id, round(least(1e0, greatest(0e0, 1 - 2*coalesce(m, 0)/(n + 1e-12))), 6) AS inconsistency FROM n LEFT JOIN m USING (image_id)")
def _(v):
    return K.flip_inconsistency(v.gt, v.dt, best_pairs(v), ["image_id"]).select("image_id", *r("inconsistency"))


@query("m13_detection_f1")
def _(v):
    return K.detection_f1(v.images, v.gt, v.dt, gt_pairs(v)).select("image_id", *r("f1"))


@query("a3_cross_view_features")
def _(v):
    from ..operators.aggregates import cross_view_features

    v = v.once("dt")  # both views come from it
    base, flip = v.xy_dt, written(C.unflipped(v.xy_flip, v.images), "flip")
    f = cross_view_features(base, flip, J.iou_join(base, flip, 0.3, "det_id", "det_id", same_class=True), v.images, CATEGORIES, confident=True)
    return f.select("image_id", *r(*[c for c in f.columns if c != "image_id"]))


# ---- average precision

NPOS = "SELECT category_id, count(*) AS npos FROM gt GROUP BY category_id"


def ap_sql(matches, keys, npos, weight="1"):
    """AP by keys in SQL: cumulative counts, envelope, 101 recall points.  ``matches`` and ``npos`` are names of CTEs."""
    k = ", ".join(keys)
    return f"""c_ AS (SELECT {k}, tp, {weight} AS wt, score, image_id, det_id, sum({weight}*tp) OVER w AS ctp, sum({weight}) OVER w AS cn, row_number() OVER w AS i FROM {matches} WINDOW w AS (PARTITION BY {k} ORDER BY score DESC, image_id, det_id ROWS UNBOUNDED PRECEDING)),
e_ AS (SELECT *, max(ctp/(cn + 2.220446049250313e-16)) OVER (PARTITION BY {k} ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS env FROM c_),
p_ AS (SELECT {k}, env*(floor(100*ctp/npos) - floor(100*(ctp - wt*tp)/npos) + CASE WHEN ctp = wt*tp AND wt*tp > 0 THEN 1 ELSE 0 END) AS part, ctp FROM e_ JOIN {npos} USING ({k})),
s_ AS (SELECT {k}, sum(part)/101e0 AS ap, max(ctp) AS top FROM p_ GROUP BY {k}),
ap_ AS (SELECT {k}, coalesce(ap, 0e0) AS ap, coalesce(top, 0)/npos AS recall FROM {npos} LEFT JOIN s_ USING ({k}))"""


def sql_matches(v):
    """Detections marked by the mutual-best table; written, as what follows reads them more than once."""
    tp = best_pairs(v).select(F.col("right_id").alias("det_id"), F.lit(1).alias("hit"))
    return written(v.dt.join(tp, "det_id", "left").select("det_id", "image_id", "category_id", "score", F.coalesce("hit", F.lit(0)).alias("tp"), F.lit(1).alias("weight")), "marked")


def npos(v):
    return v.gt.groupBy("category_id").agg(F.count("*").alias("npos"))


@query("e1_match_coco")
def _(v):
    m = E.match_coco(v.xy_gt, v.xy_dt)
    return m.groupBy("category_id", "area", "threshold").agg(F.sum("tp").alias("tp"), F.count_if("ignored").alias("ignored"), F.count("*").alias("n"))


@query("e2_cap_detections", "SELECT det_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id, category_id ORDER BY score DESC, det_id) AS k FROM dt) q WHERE k <= 5")
def _(v):
    return E.cap_detections(v.dt, 5).select("det_id")


@query("e3_average_precision", f"WITH n_ AS ({NPOS}), {ap_sql('matches', ['category_id'], 'n_')} SELECT category_id, round(ap, 6) AS ap, round(recall, 6) AS recall FROM ap_")
def _(v):
    return E.average_precision(sql_matches(v), npos(v), ["category_id"]).select("category_id", *r("ap", "recall"))


@query("e4_ap_metrics")
def _(v):
    m = E.ap_metrics(v.xy_gt, v.xy_dt)
    return m.select(*r(*m.columns))


@query("e5_ap_per_class")
def _(v):
    m = written(E.match_coco(v.xy_gt, v.xy_dt, thresholds=(0.5,), areas=("all",)), "matches")
    return E.evaluated(v.xy_gt, m, [], ("all",), (0.5,)).select("category_id", *r("ap", "recall"))


FLOORS = [0.05, 0.25, 0.5]


@query("e6_score_floor_sweep", f"""WITH f_ AS (SELECT unnest([0.05e0, 0.25e0, 0.5e0]) AS floor), m_ AS (SELECT floor, m.* FROM matches m, f_ WHERE score >= floor), n_ AS (SELECT floor, category_id, count(*) AS npos FROM gt, f_ GROUP BY ALL),
{ap_sql('m_', ['category_id', 'floor'], 'n_')} SELECT a.category_id, a.floor, round(a.ap, 6) AS ap, round(a.ap - b.ap, 6) AS change FROM ap_ a JOIN ap_ b ON a.category_id = b.category_id AND b.floor = 0.05e0""")
def _(v):
    return E.score_floor_sweep(sql_matches(v), npos(v), ["category_id"], FLOORS).select("category_id", "floor", *r("ap", "change"))


@query("e6_floor_deltas", f"""WITH f_ AS (SELECT unnest([0.05e0, 0.25e0, 0.5e0]) AS floor), x_ AS (SELECT 'base' AS run, * FROM matches UNION ALL SELECT 'method', m.det_id, m.image_id, m.category_id, d.score, m.tp FROM matches m JOIN dt_method d ON d.det_id = m.det_id),
m_ AS (SELECT floor, x_.* FROM x_, f_ WHERE score >= floor), n_ AS (SELECT run, floor, category_id, count(*) AS npos FROM gt, f_, (SELECT unnest(['base', 'method']) AS run) r GROUP BY ALL), {ap_sql('m_', ['run', 'category_id', 'floor'], 'n_')},
d_ AS (SELECT a.category_id, a.floor, b.ap - a.ap AS delta FROM ap_ a JOIN ap_ b ON a.category_id = b.category_id AND a.floor = b.floor AND a.run = 'base' AND b.run = 'method')
SELECT category_id, floor, round(delta, 6) AS delta, min(delta) OVER (PARTITION BY category_id) > 0 AS positive_at_all, round(min(delta) OVER (PARTITION BY category_id), 6) AS least_delta FROM d_""")
def _(v):
    two = two_runs(v)
    runs = two["base"].withColumn("run", F.lit("base")).unionByName(two["method"].withColumn("run", F.lit("method"))).withColumn("weight", F.lit(1))
    both = npos(v).withColumn("run", F.explode(F.array(F.lit("base"), F.lit("method"))))
    swept = E.score_floor_sweep(runs, both, ["run", "category_id"], FLOORS)
    return E.floor_deltas(swept, ["category_id"], "run", "base", "method").select("category_id", "floor", *r("delta"), "positive_at_all", *r("least_delta"))


def two_runs(v):
    """Matches of the base run, and the same boxes with the scores of the other; both are read from one written table."""
    tp = best_pairs(v).select(F.col("right_id").alias("det_id"), F.lit(1).alias("hit"))
    both = v.dt.join(v.dt_method.select("det_id", F.col("score").alias("s2")), "det_id", "left").join(tp, "det_id", "left")
    both = written(both.select("det_id", "image_id", "category_id", "score", "s2", F.coalesce("hit", F.lit(0)).alias("tp")), "marked")
    columns = ["det_id", "image_id", "category_id", "score", "tp"]
    return {"base": both.select(*columns), "method": both.where("s2 is not null").withColumn("score", F.col("s2")).select(*columns)}


@query("e7_score_grid", f"""WITH i_ AS (SELECT image_id, cluster_id % 5 AS scope FROM images), m_ AS (SELECT scope, m.* FROM matches m JOIN i_ USING (image_id)), n_ AS (SELECT scope, category_id, count(*) AS npos FROM gt JOIN i_ USING (image_id) GROUP BY ALL),
{ap_sql('m_', ['scope', 'category_id'], 'n_')} SELECT scope, round(avg(ap), 6) AS ap FROM ap_ GROUP BY scope""")
def _(v):
    i = v.images.select("image_id", (F.col("cluster_id") % 5).alias("scope"))
    n = v.gt.join(i, "image_id").groupBy("scope", "category_id").agg(F.count("*").alias("npos"))
    return E.average_precision(sql_matches(v).join(i, "image_id"), n, ["scope", "category_id"]).groupBy("scope").agg(F.round(F.avg("ap"), 6).alias("ap"))


# ---- resampling

DRAWS = "SELECT r.n AS resample, CAST({H:concat('11|', r.n, '|', j.n)} % 25 AS INT) AS unit, CAST(count(*) AS INT) AS m FROM (SELECT unnest(range(200)) AS n) r, (SELECT unnest(range(25)) AS n) j GROUP BY ALL"


# every image is a unit, numbered in hash order
UNITS = "SELECT image_id, CAST(row_number() OVER (ORDER BY {SHA:concat('3:', image_id)}, image_id) - 1 AS INT) AS unit FROM images"
IMAGE_DRAWS = "SELECT r.n AS resample, CAST({H:concat('11|', r.n, '|', j.unit)} % (SELECT count(*) FROM images) AS INT) AS unit, CAST(count(*) AS INT) AS m FROM (SELECT unnest(range(1000)) AS n) r, units_ j GROUP BY ALL"


def image_units(v):
    from ..operators.select import hash_order

    return hash_order(v.images.select("image_id"), "image_id", 3).select("image_id", F.col("position").cast("int").alias("unit"))


def image_bootstrap(v, each, statistic):
    """1,000 resamples of images; ``each`` gives an image's value from its scores."""
    a = v.dt.join(v.dt_method.select("det_id", F.col("score").alias("s2")), "det_id").join(image_units(v), "image_id")
    pairs = a.groupBy("unit").agg(each("score").alias("baseline"), each("s2").alias("method"))
    return B.paired_bootstrap(pairs, v.images.count(), 1000, 11, statistic).select("resample", *r("delta"))


@query("b1_paired_bootstrap", f"""WITH units_ AS ({UNITS}), d_ AS ({IMAGE_DRAWS}), p_ AS (SELECT i.unit, avg(a.score) AS a, avg(b.score) AS b FROM units_ i JOIN dt a ON a.image_id = i.image_id JOIN dt_method b ON b.det_id = a.det_id GROUP BY 1)
SELECT CAST(resample AS INT) AS resample, round(sum((b - a)*m)/sum(m), 6) AS delta FROM p_ JOIN d_ USING (unit) GROUP BY resample""")
def _(v):
    return image_bootstrap(v, F.avg, B.weighted_mean_delta)


@query("u1_user_statistic", f"""WITH units_ AS ({UNITS}), d_ AS ({IMAGE_DRAWS}), p_ AS (SELECT i.unit, min(a.score) AS a, min(b.score) AS b FROM units_ i JOIN dt a ON a.image_id = i.image_id JOIN dt_method b ON b.det_id = a.det_id GROUP BY 1)
SELECT CAST(resample AS INT) AS resample, round(max(b) - max(a), 6) AS delta FROM p_ JOIN d_ USING (unit) GROUP BY resample""")
def _(v):
    return image_bootstrap(v, F.min, lambda x, y: F.max(y) - F.max(x))


@query("b2_ap_image_bootstrap")
def _(v):
    """Both runs, 1,000 resamples of all images."""
    v = v.once("boxes")
    matches = {run: E.match_coco(v.xy_gt, df, areas=("all",), thresholds=(0.5,)).where("not ignored") for run, df in (("base", v.xy_dt), ("method", v.xy_method))}
    n = v.gt.groupBy("image_id", "category_id").agg(F.count("*").alias("npos"))
    return B.ap_cluster_bootstrap(matches, n, image_units(v), v.images.count(), 1000, 13).select("run", "resample", *r("ap"))


@query("b3_ap_cluster_bootstrap", f"""WITH d_ AS ({DRAWS}), m_ AS (SELECT d_.resample, m.*, d_.m AS wt_ FROM matches m JOIN images i ON m.image_id = i.image_id JOIN d_ ON d_.unit = i.cluster_id),
n_ AS (SELECT d_.resample, g.category_id, sum(d_.m) AS npos FROM gt g JOIN images i ON g.image_id = i.image_id JOIN d_ ON d_.unit = i.cluster_id GROUP BY ALL), {ap_sql('m_', ['resample', 'category_id'], 'n_', 'wt_')}
SELECT 'base' AS run, CAST(resample AS INT) AS resample, round(avg(ap), 6) AS ap FROM ap_ GROUP BY resample""")
def _(v):
    units = v.images.select("image_id", F.col("cluster_id").cast("int").alias("unit"))
    n = v.gt.groupBy("image_id", "category_id").agg(F.count("*").alias("npos"))
    return B.ap_cluster_bootstrap({"base": sql_matches(v)}, n, units, 25, 200, 11).select("run", "resample", *r("ap"))


@query("b4_pending_resamples", "SELECT method, seed, resample FROM deltas WHERE resample % 3 = 0 OR resample % 50 = 1")
def _(v):
    stored = v.deltas.withColumn("delta", F.when(F.col("resample") % 50 != 1, F.col("delta"))).where("resample % 3 <> 0")
    return B.pending_resamples(v.deltas.select("method", "seed", "resample"), stored, ["method", "seed", "resample"]).select("method", "seed", "resample")


@query("b4_stored_resamples", f"""WITH units_ AS ({UNITS}), d_ AS ({IMAGE_DRAWS}), p_ AS (SELECT i.unit, avg(a.score) AS a, avg(b.score) AS b, min(a.score) AS a2, min(b.score) AS b2 FROM units_ i JOIN dt a ON a.image_id = i.image_id JOIN dt_method b ON b.det_id = a.det_id GROUP BY 1)
SELECT 'mean' AS contrast, CAST(resample AS INT) AS resample, round(sum((b - a)*m)/sum(m), 6) AS delta FROM p_ JOIN d_ USING (unit) GROUP BY resample UNION ALL SELECT 'least', CAST(resample AS INT), round(sum((b2 - a2)*m)/sum(m), 6) FROM p_ JOIN d_ USING (unit) GROUP BY resample""")
def _(v):
    """1,000 resamples of two contrasts in a stored table: one contrast has 350 of them from a run that was stopped, the rest is made by the next."""
    a = v.dt.join(v.dt_method.select("det_id", F.col("score").alias("s2")), "det_id").join(image_units(v), "image_id")
    pairs = a.groupBy("unit").agg(*[F.struct(each("score").alias("baseline"), each("s2").alias("method")).alias(n) for n, each in (("mean", F.avg), ("least", F.min))])
    pairs = written(pairs.select("unit", F.inline(F.array(*[F.struct(F.lit(n).alias("contrast"), F.col(f"{n}.baseline"), F.col(f"{n}.method")) for n in ("mean", "least")]))), "pairs")
    path, n_units = new_folder(v.spark, "deltas"), v.images.count()
    T.stored_deltas(path, pairs.where("contrast = 'mean'"), n_units, 350, 11, B.weighted_mean_delta)
    return T.stored_deltas(path, pairs, n_units, 1000, 11, B.weighted_mean_delta).select("contrast", "resample", *r("delta"))


PV = "SELECT method, seed, least(1e0, 2*least((count(*) FILTER (delta <= 0) + 1)/(count(*) + 1), (count(*) FILTER (delta >= 0) + 1)/(count(*) + 1))) AS p FROM deltas GROUP BY method, seed"


def pvalues(v):
    return v.deltas.groupBy("method", "seed").agg(B.sign_pvalue().alias("p"))


@query("b5_sign_pvalue", f"SELECT method, seed, round(p, 6) AS p FROM ({PV}) q")
def _(v):
    return pvalues(v).select("method", "seed", *r("p"))


HOLM = "least(1e0, max(s) OVER (PARTITION BY method ORDER BY p, seed ROWS UNBOUNDED PRECEDING))"
BH = "least(1e0, min(b) OVER (PARTITION BY method ORDER BY p, seed ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
STEP = f"WITH q AS ({PV}), s_ AS (SELECT *, (count(*) OVER (PARTITION BY method) - row_number() OVER (PARTITION BY method ORDER BY p, seed) + 1)*p AS s, p*count(*) OVER (PARTITION BY method)/row_number() OVER (PARTITION BY method ORDER BY p, seed) AS b FROM q)"


@query("b6_holm", f"{STEP} SELECT method, seed, round({HOLM}, 6) AS p_holm FROM s_")
def _(v):
    return B.holm(pvalues(v), ["method"], "p", "seed").select("method", "seed", *r("p_holm"))


@query("b7_benjamini_hochberg", f"{STEP} SELECT method, seed, round({BH}, 6) AS p_bh FROM s_")
def _(v):
    return B.benjamini_hochberg(pvalues(v), ["method"], "p", "seed").select("method", "seed", *r("p_bh"))


ROW = "count(*) AS n, round(avg(delta), 9) AS mean, round(quantile_cont(delta, 0.025), 9) AS low, round(quantile_cont(delta, 0.975), 9) AS high, round(stddev_samp(delta), 9) AS std, round(least(1e0, 2*least((count(*) FILTER (delta <= 0) + 1)/(count(*) + 1), (count(*) FILTER (delta >= 0) + 1)/(count(*) + 1))), 9) AS p, round(avg(delta)/stddev_samp(delta), 6) AS effect"


def row_cols():
    return ["n", *r("mean", "low", "high", "std", "p", digits=9), *r("effect")]


@query("b8_cluster_summary", f"WITH m_ AS (SELECT method, resample, avg(delta) AS delta FROM deltas GROUP BY ALL) SELECT method, {ROW} FROM m_ GROUP BY method")
def _(v):
    return B.cluster_summary(v.deltas, ["seed"], ["method"]).select("method", *row_cols())


@query("b9_contrast_row", f"SELECT method, seed, {ROW} FROM deltas GROUP BY method, seed")
def _(v):
    return B.contrast_row(v.deltas, ["method", "seed"]).select("method", "seed", *row_cols())


@query("b10_recenter", "SELECT d.method, d.seed, d.resample, round(d.delta + r.ap - r.eic_mean, 6) AS delta FROM deltas d JOIN runs r ON d.method = r.method AND d.seed = r.seed")
def _(v):
    points = v.runs.select("method", "seed", F.col("ap").alias("direct"), F.col("eic_mean").alias("raw"))
    return B.recenter(v.deltas, points, ["method", "seed"]).select("method", "seed", "resample", *r("delta"))


@query("b11_factorial_2x2", "WITH j AS (SELECT a.seed, a.resample, a.delta AS x, b.delta AS y FROM deltas a JOIN deltas b ON a.seed = b.seed AND a.resample = b.resample WHERE a.method = '1-URGENT' AND b.method = '2-HIGH') SELECT seed, resample, 'main' AS effect, round((x+y)/2, 6) AS delta FROM j UNION ALL SELECT seed, resample, 'interaction', round(x-y, 6) FROM j")
def _(v):
    return B.factorial_2x2(v.deltas, "1-URGENT", "2-HIGH").select("seed", "resample", "effect", *r("delta"))


LEFT_OUT = f"""o_ AS (SELECT DISTINCT cluster_id AS omitted FROM images UNION ALL SELECT -1), x_ AS (SELECT 'base' AS run, * FROM matches UNION ALL SELECT 'method', m.det_id, m.image_id, m.category_id, d.score, m.tp FROM matches m JOIN dt_method d ON d.det_id = m.det_id),
m_ AS (SELECT omitted, x_.* FROM x_ JOIN images i ON x_.image_id = i.image_id JOIN o_ ON i.cluster_id <> omitted),
n_ AS (SELECT run, omitted, category_id, count(*) AS npos FROM gt g JOIN images i ON g.image_id = i.image_id JOIN o_ ON i.cluster_id <> omitted, (SELECT unnest(['base', 'method']) AS run) r GROUP BY ALL), {ap_sql('m_', ['run', 'omitted', 'category_id'], 'n_')},
l_ AS (SELECT omitted, avg(ap) FILTER (run = 'base') AS baseline_ap, avg(ap) FILTER (run = 'method') AS method_ap FROM ap_ GROUP BY omitted),
d_ AS (SELECT *, method_ap - baseline_ap AS delta, (SELECT method_ap - baseline_ap FROM l_ WHERE omitted = -1) AS full_delta FROM l_ WHERE omitted <> -1)"""


def left_out(v):
    v = v.once("boxes")
    n = v.gt.groupBy("image_id", "category_id").agg(F.count("*").alias("npos"))
    return B.leave_one_group_out(two_runs(v), n, v.images.select("image_id", F.col("cluster_id").alias("unit")), "base", "method")


@query("b12_leave_one_group_out", f"WITH {LEFT_OUT} SELECT omitted, round(baseline_ap, 6) AS baseline_ap, round(method_ap, 6) AS method_ap, round(delta, 6) AS delta, round(delta - full_delta + 1e-10, 6) AS shift FROM d_")
def _(v):
    return left_out(v).withColumn("shift", F.col("shift") + 1e-10).select("omitted", *r("baseline_ap", "method_ap", "delta", "shift"))


@query("b12_influence_summary", f"""WITH {LEFT_OUT} SELECT round(any_value(full_delta), 6) AS full_delta, round(min(delta), 6) AS min_delta, round(max(delta), 6) AS max_delta, round(max(abs(delta - full_delta)), 6) AS largest_shift,
arg_max(omitted, abs(delta - full_delta)) AS most_influential, round(arg_max(delta, abs(delta - full_delta)), 6) AS influential_delta, avg(CASE WHEN delta > 0 THEN 1e0 ELSE 0e0 END) AS share_positive FROM d_""")
def _(v):
    s = B.influence_summary(left_out(v))
    return s.select(*r("full_delta", "min_delta", "max_delta", "largest_shift"), "most_influential", *r("influential_delta"), "share_positive")


@query("b13_spearman", "WITH k AS (SELECT image_id, rank() OVER (PARTITION BY image_id ORDER BY d) + (count(*) OVER (PARTITION BY image_id, d) - 1)/2e0 AS x, rank() OVER (PARTITION BY image_id ORDER BY u) + (count(*) OVER (PARTITION BY image_id, u) - 1)/2e0 AS y FROM traits) SELECT image_id, round(corr(x, y) + 1e-10, 6) + 0e0 AS spearman FROM k GROUP BY image_id")
def _(v):
    return B.spearman(v.traits, ["image_id"], "d", "u").select("image_id", (F.round(F.col("spearman") + 1e-10, 6) + 0.0).alias("spearman"))


@query("b14_multiplicity_table", f"{STEP}, h_ AS (SELECT method, seed, p, {HOLM} AS h, {BH} AS f FROM s_) SELECT method, seed, p < 0.05 AS raw_significant, h < 0.05 AS holm_significant, f < 0.05 AS bh_significant FROM h_")
def _(v):
    return B.multiplicity_table(pvalues(v), ["method"], "p", "seed").select("method", "seed", "raw_significant", "holm_significant", "bh_significant")


# ---- near-duplicates and partitions

# 9 x 8 numbers of each vector: its 64 and the first eight again
BITS = " + ".join(f"CAST(CASE WHEN e[{i + i // 8 + 2}] > e[{i + i // 8 + 1}] THEN 1 ELSE 0 END AS HUGEINT) * {1 << (63 - i)}" for i in range(64))
HASH = f"SELECT vec_id, CAST(CASE WHEN b >= 9223372036854775808 THEN b - 18446744073709551616 ELSE b END AS BIGINT) AS hash64 FROM (SELECT vec_id, {BITS} AS b FROM (SELECT vec_id, list_concat(embedding, embedding[1:8]) AS e FROM embeddings) x) y"


def hashes(v):
    return v.embeddings.select("vec_id", D.dhash64(F.concat("embedding", F.slice("embedding", 1, 8))).alias("hash64"))


def planted(v):
    h = hashes(v)
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))
    near = h.where("vec_id % 3 = 0").select((F.col("vec_id") + 1000000).alias("vec_id"), F.col("hash64").bitwiseXOR(bit(F.col("vec_id") % 64)).bitwiseXOR(bit((F.col("vec_id") * 7 + 1) % 64)).alias("hash64"))
    return h.unionByName(near)


@query("d1_dhash64", HASH)
def _(v):
    return hashes(v)


@query("d1_phash64")
def _(v):
    return D.image_hashes(pixel_table(v)).select("image_id", F.get("phashes", 0).alias("hash64"))


@query("d2_near_images")
def _(v):
    """Documents as images; every third one also upside down."""
    images = pixel_table(v)
    turned = I.enhanced_views(images.where("image_id % 3 = 0"), {"turn": 0.0}, {"turn": lambda image, value, seed: image[::-1, ::-1]})
    both = images.unionByName(turned.select((F.col("image_id") + 1_000_000_000_000).alias("image_id"), "height", "width", "data"))
    return D.near_edges(written(D.image_hashes(both), "hashes"), 4, "image_id", ["phashes", "dhashes"])


@query("d2_hamming_pairs", f"""WITH h_ AS ({HASH}), p_ AS (SELECT * FROM h_ UNION ALL SELECT vec_id + 1000000, xor(xor(hash64, CASE WHEN vec_id % 64 = 63 THEN -9223372036854775808 ELSE 1::BIGINT << CAST(vec_id % 64 AS INT) END), CASE WHEN (vec_id*7+1) % 64 = 63 THEN -9223372036854775808 ELSE 1::BIGINT << CAST((vec_id*7+1) % 64 AS INT) END) FROM h_ WHERE vec_id % 3 = 0)
SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(a.hash64, b.hash64)) AS INT) AS distance FROM p_ a JOIN p_ b ON a.vec_id < b.vec_id AND bit_count(xor(a.hash64, b.hash64)) <= 4""")
def _(v):
    return D.hamming_pairs(planted(v), 4, "vec_id", "hash64")


COMPONENTS = f"""WITH RECURSIVE h_ AS ({HASH}), m_ AS (SELECT vec_id AS doc_id, hash64 FROM h_ WHERE vec_id % 11 <> 5 UNION ALL SELECT vec_id + 5, xor(hash64, 1::BIGINT) FROM h_ WHERE vec_id % 11 = 0),
n_ AS (SELECT m_.* FROM m_ JOIN members USING (doc_id)),
e_ AS (SELECT a.doc_id AS a, b.doc_id AS b FROM members a JOIN members b ON a.doc_id <> b.doc_id AND (a.source_key = b.source_key OR a.sha = b.sha)
  UNION SELECT a.doc_id, b.doc_id FROM n_ a JOIN n_ b ON a.doc_id <> b.doc_id AND bit_count(xor(a.hash64, b.hash64)) <= 4),
w_ AS (SELECT doc_id AS v, doc_id AS r FROM members UNION SELECT e_.b, w_.r FROM w_ JOIN e_ ON e_.a = w_.v),
c_ AS (SELECT v AS doc_id, min(r) AS component FROM w_ GROUP BY v)"""


def member_hashes(v):
    """The hash of the vector of the same id; members five above a multiple of eleven look like that one, but for a bit."""
    h = hashes(v)
    copies = h.where("vec_id % 11 = 0").select((F.col("vec_id") + 5).alias("doc_id"), F.col("hash64").bitwiseXOR(F.lit(1).cast("long")).alias("hash64"))
    own = h.where("vec_id % 11 <> 5").select(F.col("vec_id").alias("doc_id"), "hash64").unionByName(copies)
    return own.join(D.by_shuffle(v.members.select("doc_id")), "doc_id", "left_semi").select("doc_id", F.array("hash64").alias("hashes"))


def member_components(v):
    """Same source, same content or near hashes."""
    m = v.members
    near = D.near_edges(member_hashes(v), 4, "doc_id", ["hashes"]).select("a", "b")
    edges = D.star_edges(m, "doc_id", "source_key").unionByName(D.star_edges(m, "doc_id", "sha")).unionByName(near)
    return m.join(D.by_shuffle(D.components(m, edges, "doc_id")), "doc_id")


@query("d3_components", f"{COMPONENTS} SELECT doc_id, component FROM c_")
def _(v):
    return member_components(v).select("doc_id", "component")


@query("d4_component_id", f"{COMPONENTS} SELECT component, sha256(string_agg(sha, '|' ORDER BY sha)) AS component_sha, count(*) AS size FROM members JOIN c_ USING (doc_id) GROUP BY component")
def _(v):
    return D.component_id(member_components(v), "component", "sha")


@query("d5_partition_components")
def _(v):
    sizes = D.component_id(member_components(v), "component", "sha")
    return D.partition_components(sizes, 300, 20).groupBy("role").agg(F.count("*").alias("n_components"), F.sum("size").alias("n"))


@query("d6_partition_audit", f"{COMPONENTS}, r_ AS (SELECT m.doc_id, m.sha, component, CASE WHEN component % 3 = 0 THEN 'B' ELSE 'A' END AS role FROM members m JOIN c_ USING (doc_id)), x_ AS (SELECT sha FROM r_ GROUP BY sha HAVING count(DISTINCT role) > 1) SELECT role, count(*) AS n, count(DISTINCT component) AS n_components, count(x_.sha) AS n_leaks, CAST(0 AS BIGINT) AS n_broken FROM r_ LEFT JOIN x_ ON r_.sha = x_.sha GROUP BY role")
def _(v):
    m = member_components(v).withColumn("role", F.when(F.col("component") % 3 == 0, "B").otherwise("A"))
    return D.partition_audit(m)


@query("d6_component_sizes", f"{COMPONENTS} SELECT size, count(*) AS n_components FROM (SELECT component, count(*) AS size FROM c_ GROUP BY component) q GROUP BY size")
def _(v):
    return D.component_sizes(member_components(v))


@query("d7_compose_training_set", """WITH t AS (SELECT image_id FROM images WHERE image_id % 3 <> 0), s AS (SELECT image_id FROM images WHERE image_id % 3 = 0 ORDER BY {SHA:concat('5:', image_id)}, image_id LIMIT 100)
SELECT image_id, view, copy, 'target' AS role FROM t, (VALUES ('original'), ('fog')) v(view), (VALUES (0), (1)) c(copy) UNION ALL SELECT image_id, CASE (image_id-1) % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'blur' ELSE 'rain' END, 0, 'target' FROM t
UNION ALL SELECT image_id, 'extra', 0, 'target' FROM (SELECT image_id FROM t ORDER BY image_id LIMIT 50) q UNION ALL SELECT image_id, 'original', 0, 'replay' FROM s""")
def _(v):
    from ..operators.select import hash_sample

    replay = hash_sample(v.images.where("image_id % 3 = 0"), "image_id", 100, 5)
    return D.compose_training_set(v.images.where("image_id % 3 <> 0"), replay, ["original", "fog"], 2, ["low", "blur", "rain"], 50)


@query("d8_primary_scope", "SELECT doc_id, source_key AS cluster FROM members WHERE doc_id % 7 <> 0 AND source_key NOT IN (SELECT source_key FROM members WHERE doc_id % 7 = 0)")
def _(v):
    return D.primary_scope(v.members.where("doc_id % 7 <> 0"), v.members.where("doc_id % 7 = 0"), "source_key").select("doc_id", "cluster")


# ---- sources and sinks

def folder(v, name):
    """A new folder that driver and executors share."""
    from ..sources.shared import new_folder

    return new_folder(v.spark, name)


@query("s1_read_coco", "SELECT category_id, count(*) AS n, round(sum(w*h), 3) AS area FROM gt GROUP BY category_id")
def _(v):
    path = folder(v, "coco")
    doc = lambda df, cols, name: df.agg(F.collect_list(F.struct(*cols)).alias(name))
    per = v.gt.withColumn("part", F.floor(F.col("image_id") / 1000)).groupBy("part").agg(F.collect_list(F.struct(F.col("ann_id").alias("id"), "image_id", "category_id", F.array("x", "y", "w", "h").alias("bbox"), (F.col("w") * F.col("h")).alias("area"), F.lit(0).alias("iscrowd"))).alias("annotations"))
    img = v.images.withColumn("part", F.floor(F.col("image_id") / 1000)).groupBy("part").agg(F.collect_list(F.struct(F.col("image_id").alias("id"), F.concat(F.col("image_id").cast("string"), F.lit(".jpg")).alias("file_name"), "width", "height")).alias("images"))
    cats = doc(v.gt.select("category_id").distinct().withColumn("name", F.concat(F.lit("c"), F.col("category_id").cast("string"))), [F.col("category_id").alias("id"), "name"], "categories")
    per.join(img, "part").crossJoin(cats).drop("part").write.option("maxRecordsPerFile", 1).json(path)
    _, ann, _ = R.read_coco(v.spark, path)
    return ann.groupBy("category_id").agg(F.count("*").alias("n"), F.round(F.sum("area"), 3).alias("area"))


@query("s2_csv_boxes", "SELECT image_id, CAST(category_id AS INT) AS category_id, x, y, w, h FROM gt_dirty WHERE ann_id % 13 <> 0 AND w > 0 AND h > 0")
def _(v):
    number = lambda c: F.col(c).cast("int").cast("string")
    line = F.concat_ws(",", number("x"), number("y"), number("w"), number("h"), F.when(F.col("ann_id") % 13 == 0, "0").otherwise("1"), (F.col("category_id") + 1).cast("string"), F.lit("0"), F.lit("1,"))
    return R.parse_csv_boxes(v.gt_dirty.select("image_id", line.alias("line"))).where("not dropped").select("image_id", "category_id", "x", "y", "w", "h")


@query("s3_sequence_boxes", "SELECT sequence, count(*) FILTER (event_id % 4 <> 0) AS boxes, count(*) FILTER (event_id % 4 = 0) AS ignored FROM frames GROUP BY sequence")
def _(v):
    f = v.frames
    line = F.concat_ws(",", F.col("frame_index").cast("string"), F.lit("1"), F.lit("10"), F.lit("10"), F.lit("20"), F.lit("20"), F.lit("1"), F.lit("1"), F.when(F.col("event_id") % 4 == 0, "0").otherwise("1"))
    boxes, ignored = R.parse_sequence_boxes(f.select("sequence", line.alias("line")), f)
    both = boxes.select("sequence", F.lit(1).alias("b"), F.lit(0).alias("i")).unionByName(ignored.select("sequence", F.lit(0).alias("b"), F.lit(1).alias("i")))
    return both.groupBy("sequence").agg(F.sum("b").alias("boxes"), F.sum("i").alias("ignored"))


@query("s4_obb_labels", "SELECT ann_id, 'c' || category_id AS class_name, round(x1/1920, 8) AS x1, round(y1/1080, 8) AS y1, round(x2/1920, 8) AS x2, round(y2/1080, 8) AS y2 FROM xy_gt WHERE category_id <> 3")
def _(v):
    g = v.xy_gt
    px = lambda c: F.format_string("%.12f", F.col(c) / 1920)
    py = lambda c: F.format_string("%.12f", F.col(c) / 1080)
    line = F.concat_ws(" ", F.col("category_id").cast("string"), px("x1"), py("y1"), px("x2"), py("y1"), px("x2"), py("y2"), px("x1"), py("y2"))
    return R.parse_obb_labels(g.select("ann_id", line.alias("line")), ["c0", "c1", "c2", "c3"], ["c3"]).where("not skipped").select("ann_id", "class_name", *r(*SIDES, digits=8))


def documents(elements, part, root):
    """A well-formed document for each part, its elements (``value``) inside one root; written one a file."""
    whole = F.concat(F.lit(f"<{root}>"), F.array_join(F.collect_list("value"), ""), F.lit(f"</{root}>"))
    return elements.groupBy(part.alias("part")).agg(whole.alias("value")).select("value")


@query("s5_track_xml", "SELECT CASE WHEN event_id % 2 = 1 THEN 'outside' WHEN frame_index NOT BETWEEN 1 AND 20 THEN 'out_of_range' ELSE 'kept' END AS outcome, count(*) AS n FROM frames GROUP BY 1")
def _(v):
    path = folder(v, "tracks")
    box = F.concat(F.lit('<box frame="'), F.col("frame_index").cast("string"), F.lit('" outside="'), (F.col("event_id") % 2).cast("string"), F.lit('" xtl="10" ytl="20" xbr="50" ybr="60" rotation="'), (F.col("event_id") % 90).cast("string"), F.lit('"/>')  )
    track = F.concat(F.lit('<track id="'), F.col("sequence").cast("string"), F.lit('" label="car">'), F.array_join(F.array_sort(F.collect_list(box)), ""), F.lit("</track>"))
    documents(v.frames.groupBy("sequence").agg(track.alias("value")), F.floor(F.col("sequence") / 100), "annotations").write.option("maxRecordsPerFile", 1).text(path)
    return R.read_track_xml(v.spark, path, 1, 20, 1920, 1080).groupBy("outcome").agg(F.count("*").alias("n"))


@query("s6_frame_json", "SELECT category_id*10 AS category_id, w <= 0 AS dropped, count(*) AS n FROM gt_dirty WHERE category_id < 9 GROUP BY ALL")
def _(v):
    path = folder(v, "frames")
    box = F.struct(F.col("y").alias("top"), F.col("x").alias("left"), F.col("h").alias("height"), F.col("w").alias("width"), F.col("category_id").alias("class"))
    v.gt_dirty.where("category_id < 9").groupBy(F.col("image_id").cast("string").alias("image_name")).agg(F.collect_list(box).alias("bbox")).withColumn("image_width", F.lit(1920)).withColumn("image_height", F.lit(1080)).write.json(path)
    return R.read_frame_json(v.spark, path, {1: 10, 2: 20, 3: 30}).groupBy("category_id", "dropped").agg(F.count("*").alias("n"))


@query("s7_object_xml", "SELECT CAST(category_id AS INT) AS category_id, CASE WHEN ann_id % 5 = 0 THEN 'unresolvable' ELSE 'box' END AS status, count(*) AS n, round(sum(CASE WHEN ann_id % 5 <> 0 THEN trunc(x2) - trunc(x1) END), 3) AS width FROM xy_gt GROUP BY ALL")
def _(v):
    path = folder(v, "objects")
    n = lambda c: F.col(c).cast("int").cast("string")
    bnd = F.concat(F.lit("<bndbox><xmin>"), n("x1"), F.lit("</xmin><ymin>"), n("y1"), F.lit("</ymin><xmax>"), n("x2"), F.lit("</xmax><ymax>"), n("y2"), F.lit("</ymax></bndbox>"))
    corners = [("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2")]
    poly = F.concat(F.lit("<polygon>"), *[F.concat(F.lit(f"<x{i}>"), n(a), F.lit(f"</x{i}><y{i}>"), n(b), F.lit(f"</y{i}>")) for i, (a, b) in enumerate(corners, 1)], F.lit("</polygon>"))
    point = F.lit("<point><x>5</x><y>6</y></point>")
    k = F.col("ann_id") % 5
    body = F.when(k == 0, point).when(k < 3, bnd).otherwise(poly)
    v.xy_gt.select(F.concat(F.lit("<object><name>c"), F.col("category_id").cast("string"), F.lit("</name>"), body, F.lit("</object>")).alias("value"), F.floor(F.col("image_id") / 100).alias("part")).transform(lambda df: documents(df, F.col("part"), "annotation")).write.option("maxRecordsPerFile", 1).text(path)
    return R.read_object_xml(v.spark, path, {"c1": 1, "c2": 2, "c3": 3}).groupBy("category_id", "status").agg(F.count("*").alias("n"), F.round(F.sum(F.col("x2") - F.col("x1")), 3).alias("width"))


@query("s8_read_predictions", "SELECT image_id, category_id*10 AS class_id, score, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM dt")
def _(v):
    path = folder(v, "predictions")
    W.write_predictions(v.xy_dt, path, {1: 1, 2: 2, 3: 3})
    return R.read_predictions(v.spark, path, {1: 10, 2: 20, 3: 30})


@query("s9_read_traces", "SELECT model_id, count(*) AS n, round(sum(total_ms), 4) AS total_ms FROM timings GROUP BY model_id")
def _(v):
    path = folder(v, "traces")
    v.timings.select("image_id", "model_id", "total_ms").write.json(path)
    t = R.read_traces(v.spark, path, "image_id long, model_id int, total_ms double")
    return t.groupBy("model_id").agg(F.count("*").alias("n"), F.round(F.sum("total_ms"), 4).alias("total_ms"))


@query("s10_file_inventory")
def _(v):
    return R.file_inventory(v.spark, f"{v.sf_dir}/*.parquet").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "size", "sha256")


@query("s11_prediction_rows", "SELECT image_id, category_id + 10 AS category_id, x, y, w, h, score FROM dt")
def _(v):
    p = W.prediction_rows(v.xy_dt, {1: 11, 2: 12, 3: 13})
    return p.select("image_id", "category_id", *[F.get("bbox", i).alias(n) for i, n in enumerate("xywh")], "score")


@query("s12_write_timings", "SELECT model_id, count(*) AS n, round(max(total_ms), 6) AS top FROM timings GROUP BY model_id")
def _(v):
    path = folder(v, "timings")
    full = v.timings.select(F.col("model_id").cast("string").alias("run_id"), "image_id", *[F.col("total_ms") if c == "total_ms" else F.lit(0.0).alias(c) for c in R.TIMING[2:]])
    W.write_timings(full, path, R.TIMING)
    return v.spark.read.parquet(path).groupBy(F.col("run_id").cast("int").alias("model_id")).agg(F.count("*").alias("n"), F.round(F.max("total_ms"), 6).alias("top"))


@query("s13_yolo_label_lines", f"""WITH b AS (SELECT det_id, image_id, category_id, x1 AS a1, y1 AS b1, x2 AS a2, y2 AS b2, {CLIP} FROM xy_dt), l AS (SELECT *, greatest(abs(a1-x1), abs(b1-y1), abs(a2-x2), abs(b2-y2)) > 0 AS moved, x2 > x1 AND y2 > y1 AS keep FROM b)
SELECT i.image_id, count(*) FILTER (moved) AS outside, count(*) FILTER (moved AND keep) AS clipped, count(*) FILTER (NOT keep) AS degenerate, count(*) FILTER (keep) AS n_lines FROM images i LEFT JOIN l ON i.image_id = l.image_id GROUP BY i.image_id""")
def _(v):
    y = W.yolo_label_lines(v.images, v.xy_dt)
    return y.select("image_id", "outside", "clipped", "degenerate", (F.size(F.split("text", "\n")) - 1).cast("long").alias("n_lines"))


@query("s14_assign_coco_ids", "SELECT ann_id, row_number() OVER (ORDER BY image_id, ann_id) AS coco_id, image_id*1000000 + category_id AS composite FROM gt")
def _(v):
    ids = W.assign_coco_ids(v.gt.withColumn("bucket", F.col("image_id")), "bucket", ["ann_id"])
    return ids.select("ann_id", F.col("coco_id").cast("long").alias("coco_id"), W.composite_id(F.col("image_id"), F.col("category_id")).alias("composite"))


@query("s15_metric_table", "SELECT method, CAST(seed AS VARCHAR) AS seed, rtrim(rtrim(printf('%.8f', latency_mean_ms), '0'), '.') AS latency_mean_ms FROM runs")
def _(v):
    return W.metric_table(v.runs.select("seed", "method", "latency_mean_ms"), ["method", "seed"])


@query("s16_upsert_manifest", "SELECT image_id, CASE WHEN cluster_id % 2 = 0 THEN 'val' ELSE 'train' END AS source_split, CASE WHEN cluster_id % 2 = 0 THEN 2 ELSE 1 END AS version FROM images")
def _(v):
    """A stored manifest of two splits, one of which is written again."""
    base = v.images.select("image_id", F.when(F.col("cluster_id") % 2 == 0, "val").otherwise("train").alias("source_split"))
    path, key = new_folder(v.spark, "manifest"), ["image_id"]
    T.upsert_splits(path, base.withColumn("version", F.lit(1)), ["train", "val"], key)
    return T.upsert_splits(path, base.where("source_split = 'val'").withColumn("version", F.lit(2)), ["val"], key).select("image_id", "source_split", "version")


@query("s17_merge_preserving", "SELECT method, seed, CASE WHEN seed < 3 THEN ap + 1 ELSE ap END AS ap FROM runs")
def _(v):
    old, path = v.runs.select("method", "seed", "ap"), new_folder(v.spark, "runs")
    T.merge_stored(path, old, ["method", "seed"], "seed")
    return T.merge_stored(path, old.where("seed < 3").withColumn("ap", F.col("ap") + 1), ["method", "seed"], "seed").select("method", "seed", "ap")


@query("s17_replace_prefix", "SELECT method, seed, CASE WHEN method LIKE '1%' THEN 0e0 ELSE ap END AS ap FROM runs")
def _(v):
    old, path = v.runs.select("method", "seed", "ap"), new_folder(v.spark, "runs")
    T.merge_stored(path, old, ["method", "seed"], "method")
    return T.replace_stored_prefix(path, old.where("method like '1%'").withColumn("ap", F.lit(0.0)), "method", "1", "method").select("method", "seed", "ap")


@query("s18_discover_runs", "SELECT method, seed, ap FROM runs WHERE seed IN (1, 2) AND method = '2-HIGH'")
def _(v):
    return W.discover_runs(v.runs, {"seed": [1, 2], "method": "2-HIGH"}).select("method", "seed", "ap")


@query("s19_join_run_predictions", "SELECT method, seed, ap FROM runs")
def _(v):
    x = v.runs.select("method", "seed", "ap")
    return W.join_run_predictions(x.where("method < '3'"), x.where("method >= '3'"), "method", cover=["seed"])


# ---- pixels and hooks

def pixel_table(v):
    """Images of 64 columns, one a document: the bytes of its whole text, repeated to fill at least 48 rows and the last row."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" "))
    size = F.octet_length(text)
    height = F.greatest(F.lit(48), F.ceil(size / 192).cast("int"))
    data = F.substring(F.encode(F.repeat(text, F.ceil(height * 192 / size).cast("int")), "utf-8"), F.lit(1), height * 192)
    return v.documents.select(F.col("doc_id").alias("image_id"), height.alias("height"), F.lit(64).alias("width"), data.alias("data"))


@query("i1_region_quality")
def _(v):
    from ..operators.windows import make_grid

    p = pixel_table(v)
    q = I.region_quality(p, make_grid(p.select("image_id", "width", "height"), 2, 2))
    return q.select("image_id", "region_id", *r("luminance", "contrast", "blur", "haze", "entropy"))


@query("i2_degraded_views")
def _(v):
    return I.degraded_views(pixel_table(v), 42, keep_pixels=False).select("image_id", "kind", "parameter", F.col("seed").cast("string").alias("seed"), "output_sha256")


@query("i3_enhanced_views")
def _(v):
    return I.enhanced_views(pixel_table(v), {"gamma": 0.7, "unsharp": 1.0}, keep_pixels=False).select("image_id", "kind", "parameter", "output_sha256")


@query("i4_border_stats")
def _(v):
    return I.border_stats(pixel_table(v), 4).select("image_id", *r("border_mean", "white_fraction"))


def bright_boxes():
    """A stand-in detector: one box around the brighter half of each image."""
    import numpy as np
    import pandas as pd

    def predict(batch: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for row in batch.itertuples():
            g = I.gray(I.pixels(row))
            y, x = np.nonzero(g >= min(g.mean(), g.max()))  # the mean of equal pixels can round above them all
            rows.append((row.image_id, 1, float(g.mean()), float(x.min()), float(y.min()), float(x.max() + 1), float(y.max() + 1)))
        return pd.DataFrame(rows, columns=["image_id", "category_id", "score", *SIDES])

    return predict


@query("u2_user_detector")
def _(v):
    return hooks.detect(pixel_table(v), bright_boxes).select("image_id", "category_id", *r("score", *SIDES))


@query("u2_checked_detector")
def _(v):
    """With an IoU for the model's own suppression, and the output held against the rules for detections."""

    def make():
        predict = bright_boxes()
        return lambda batch, conf, iou, max_det: predict(batch)

    images = pixel_table(v)
    return hooks.detect_checked(images, make, [1], conf=0.1, iou=0.5, max_det=10).select("image_id", "category_id", *r("score", *SIDES))


@query("u3_user_image_operation")
def _(v):
    kernels = {"invert": lambda image, value, seed: 255 - image}
    return I.enhanced_views(pixel_table(v), {"invert": 0.0}, kernels).select("image_id", "kind", "output_sha256")


# ---- pipelines

@query("c1_flip_merge")
def _(v):
    return out(C.flip_merge(v.xy_dt, v.xy_flip, v.images))


@query("c2_candidate_bank_fuse")
def _(v):
    return out(C.candidate_bank_fuse(v.xy_dt, [v.xy_local, v.xy_method], "wbf", 0.25, **OPTIONS))


def crop_tables(v):
    """Base boxes and boxes of crops, both from one written table, as what follows reads them many times; boxes that operations on crops gave; the parts of degradation of regions."""
    seen = v.once("dt")
    base, local = seen.xy_dt, seen.xy_local
    gains = F.inline(F.array(*[F.struct(F.lit(name).alias("operation"), F.lit(gain).alias("gain")) for name, gain in (("gamma", 0.05), ("clahe", 0.1), ("unsharp", -0.05))]))
    tried = local.select("*", gains).where("(det_id + length(operation)) % 6 > 0")
    found = tried.withColumn("score", F.expr("least(1e0, greatest(0e0, score + gain * ((det_id % 7) - 2)))")).select("det_id", "image_id", "category_id", "region_id", "q", *SIDES, "operation", "score")
    parts = v.sql("SELECT image_id, region_id, d AS luminance, u AS contrast, edge AS haze, 1 - d AS blur, abs(d - u) AS entropy FROM traits")
    return base, local, found, parts


def selective(v):
    base, local, found, parts = crop_tables(v)
    return C.selective_regions(base, local, found, v.traits, parts, v.regions, v.images)


@query("c3_selective_regions")
def _(v):
    return out(selective(v).final)


@query("c3_candidate_trace")
def _(v):
    return selective(v).trace.select("image_id", "region_id", "round", "operation", *r("q"), "selected", "early_stopped")


@query("c3_selective_work")
def _(v):
    from ..operators.aggregates import timing_rows

    chosen = selective(v)
    crops = v.regions.join(chosen.trace.where("round = 0").select("image_id", "region_id"), ["image_id", "region_id"])
    return chosen.work.join(timing_rows(v.images, crops, v.timings), "image_id").select("image_id", "num_regions", "num_candidates", *r("stage_ms", "cost"), "calls")


@query("c4_uncertainty_gate")
def _(v):
    base, local, found, parts = crop_tables(v)
    return out(C.uncertainty_gate(base, local, found, v.traits, parts, v.regions, v.images, WEIGHTS_U, 0.7))


@query("c5_guarded_fusion")
def _(v):
    v = v.once("dt")  # all views come from it
    return out(C.guarded_fusion(v.xy_dt, v.xy_flip, v.xy_local, v.regions, v.images, WEIGHTS_U, 0.3, consensus=True))


@query("c6_packed_view_fusion")
def _(v):
    packed = v.xy_dt.select("image_id", "det_id", "category_id", "score", *[(F.col(c) / 3).alias(c) for c in SIDES])
    gate = C.image_gate(v.xy_local, v.regions, WEIGHTS_U)
    return out(C.packed_view_fusion(v.xy_dt, packed, v.regions, v.images, v.traits, gate, 0.3))


@query("c7_scout_escalation")
def _(v):
    f = C.escalation_features(v.xy_dt, v.xy_method, v.images, CATEGORIES)
    gates = f.select("image_id", (F.col("scout_score_std") + F.abs(F.col("count_delta")) / (F.col("b0_count") + 1) + F.col("image_megapixels") / 100).alias("gate"))
    return out(C.scout_escalation(v.xy_dt, v.xy_method, C.flip_merge(v.xy_dt, v.xy_flip, v.images), gates, 0.3))


@query("c8_evaluate_run")
def _(v):
    return C.evaluate_run(v.xy_gt, v.xy_dt, v.images.where("cluster_id < 20")).select("category_id", *r("ap", "recall"))
