"""Registered queries: validation, joins, set operations, aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import validate as V
from ..registry import query

CATEGORIES = [1, 2, 3]


def r(*names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


@query("v1_publish_filter", "SELECT det_id, score FROM dt WHERE score >= 0.25e0")
def _(v):
    return V.publish_filter(v.dt, 0.25).select("det_id", "score")


@query("v2_valid_box", "SELECT ann_id FROM gt_dirty WHERE w > 0 AND h > 0 AND x >= 0 AND y >= 0")
def _(v):
    return v.gt_dirty.where(V.valid_box(*(F.col(c) for c in "xywh"))).select("ann_id")


OUTCOME = """WITH j AS (SELECT g.*, i.image_id AS img, row_number() OVER (PARTITION BY g.image_id, category_id, x, y, w, h ORDER BY ann_id) AS nth FROM gt_dirty g LEFT JOIN images i ON g.image_id = i.image_id),
o AS (SELECT ann_id, CASE WHEN img IS NULL THEN 'unknown_image' WHEN category_id NOT IN (1,2,3) THEN 'unknown_category' WHEN x < -1e-6 OR y < -1e-6 THEN 'negative_origin' WHEN w <= 0 OR h <= 0 THEN 'non_positive' {} WHEN nth > 1 THEN 'duplicate' ELSE 'valid' END AS outcome FROM j)
SELECT * FROM o"""


@query("v3_validate_annotations", OUTCOME.format("WHEN x + w > 1920.000001e0 OR y + h > 1080.000001e0 THEN 'out_of_bounds'"))
def _(v):
    return V.validate_annotations(v.images, v.gt_dirty, CATEGORIES)


@query("v3_validate_lenient", OUTCOME.format("WHEN (x + w > 1920.000001e0 OR y + h > 1080.000001e0) AND (x >= 1920 OR y >= 1080) THEN 'outside_dropped' WHEN x + w > 1920.000001e0 OR y + h > 1080.000001e0 THEN 'clipped'"))
def _(v):
    return V.validate_annotations(v.images, v.gt_dirty, CATEGORIES, lenient=True)


@query("v4_dedup_boxes", """WITH c AS (SELECT g.ann_id, g.image_id, category_id, least(greatest(x,0e0),1920e0) AS a, least(greatest(y,0e0),1080e0) AS b, least(greatest(x+w,0e0),1920e0) AS c, least(greatest(y+h,0e0),1080e0) AS d FROM gt_dirty g JOIN images i ON g.image_id = i.image_id)
SELECT min(ann_id) AS ann_id FROM c GROUP BY image_id, category_id, a, b, c, d""")
def _(v):
    return V.dedup_boxes(v.gt_dirty, v.images).select("ann_id")


@query("v5_size_mismatch", "SELECT CASE WHEN image_id % 10 = 0 THEN 'swapped' WHEN image_id % 10 = 1 THEN 'error' ELSE 'equal' END AS size_status, count(*) AS n FROM images GROUP BY 1")
def _(v):
    k = F.col("image_id") % 10
    df = v.images.withColumn("actual_width", F.when(k == 0, 1080).when(k == 1, 640).otherwise(1920)).withColumn("actual_height", F.when(k == 0, 1920).otherwise(1080))
    return V.size_mismatch(df).groupBy("size_status").agg(F.count("*").alias("n"))


@query("v6_pairing_coverage", "WITH a AS (SELECT DISTINCT image_id AS a FROM gt), b AS (SELECT DISTINCT image_id AS b FROM dt WHERE score > 0.9e0), j AS (SELECT a, b FROM a FULL JOIN b ON a = b) SELECT count(a) AS n_left, count(b) AS n_right, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS paired, count(*) FILTER (b IS NULL) AS only_left, count(*) FILTER (a IS NULL) AS only_right, round(count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(*), 9) AS coverage FROM j")
def _(v):
    return V.pairing_coverage(v.gt, v.dt.where("score > 0.9"), "image_id")


@query("v7_frame_gaps", "WITH f AS (SELECT sequence, frame_index FROM frames WHERE event_id % 7 <> 0), s AS (SELECT *, frame_index - coalesce(lag(frame_index) OVER (PARTITION BY sequence ORDER BY frame_index), 0) AS step FROM f) SELECT sequence, count(*) AS n_frames, min(frame_index) AS first_frame, max(frame_index) AS last_frame, count(*) FILTER (step <> 1) AS gaps, count(*) FILTER (frame_index % 5 <> 0) AS off_rule FROM s GROUP BY sequence")
def _(v):
    return V.frame_gaps(v.frames.where("event_id % 7 <> 0"), every=5)


@query("v8_group_completeness", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events) AS complete FROM events GROUP BY user_id")
def _(v):
    kinds = sorted(x[0] for x in v.events.select("event_type").distinct().collect())  # the few registered kinds
    return V.group_completeness(v.events, "user_id", "event_type", kinds)


@query("v9_cell_coverage", "WITH c AS (SELECT method, seed FROM runs WHERE NOT (seed = 3 AND method LIKE '1%') UNION ALL SELECT method, seed FROM runs WHERE seed = 5), n AS (SELECT method, seed, count(*) AS n FROM c GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT method FROM c) CROSS JOIN (SELECT DISTINCT seed FROM c)) SELECT g.method, g.seed, CASE WHEN n.n IS NULL THEN 'missing' ELSE 'duplicate' END AS problem, coalesce(n.n, 0) AS n FROM g LEFT JOIN n USING (method, seed) WHERE coalesce(n.n, 0) <> 1")
def _(v):
    runs = v.runs.select("method", "seed")
    return V.cell_coverage(runs.where("not (seed = 3 and method like '1%')").unionByName(runs.where("seed = 5")), ["method", "seed"])


@query("v10_validate_detections", """SELECT d.image_id, d.det_id, CASE WHEN d.x1 < 0 OR d.y1 < 0 OR d.x2 > 1920 OR d.y2 > 1080 THEN 'outside_image' END AS problem FROM xy_dt d WHERE d.x1 < 0 OR d.y1 < 0 OR d.x2 > 1920 OR d.y2 > 1080
UNION ALL SELECT image_id, NULL, 'missing_image' FROM images WHERE image_id NOT IN (SELECT image_id FROM dt)""")
def _(v):
    return V.validate_detections(v.xy_dt, v.images, CATEGORIES)


@query("v11_compare_sources", "WITH a AS (SELECT det_id, x, y, score FROM dt WHERE det_id % 10 <> 0), b AS (SELECT det_id, x, y, score FROM dt_method WHERE det_id % 11 <> 0) SELECT CASE WHEN b.det_id IS NULL THEN 'only_left' WHEN a.det_id IS NULL THEN 'only_right' WHEN a.x = b.x AND a.y = b.y AND a.score = b.score THEN 'same' ELSE 'changed' END AS status, count(*) AS n FROM a FULL JOIN b ON a.det_id = b.det_id GROUP BY 1")
def _(v):
    return V.compare_sources(v.dt.where("det_id % 10 <> 0"), v.dt_method.where("det_id % 11 <> 0"), "det_id", ["x", "y", "score"])


@query("v11_compare_by_kind", """WITH a AS (SELECT det_id % 50 AS k, category_id AS kind, det_id, x, score FROM dt WHERE det_id % 50 <> 7), b AS (SELECT det_id % 50 AS k, category_id AS kind, det_id, x, score FROM dt_method WHERE det_id % 50 <> 9),
ga AS (SELECT k, kind, count(*) AS n, string_agg(concat(det_id, '|', x, '|', score), ',' ORDER BY det_id) AS h FROM a GROUP BY ALL), gb AS (SELECT k, kind, count(*) AS n, string_agg(concat(det_id, '|', x, '|', score), ',' ORDER BY det_id) AS h FROM b GROUP BY ALL),
j AS (SELECT coalesce(ga.kind, gb.kind) AS kind, ga.h AS h0, gb.h AS h1, ga.n AS n0, gb.n AS n1 FROM ga FULL JOIN gb ON ga.k = gb.k AND ga.kind = gb.kind)
SELECT kind, count(*) FILTER (h0 = h1) AS same, count(*) FILTER (h0 <> h1) AS changed, count(*) FILTER (h1 IS NULL) AS only_left, count(*) FILTER (h0 IS NULL) AS only_right, CAST(coalesce(sum(n0), 0) AS BIGINT) AS left_rows, CAST(coalesce(sum(n1), 0) AS BIGINT) AS right_rows FROM j GROUP BY kind""")
def _(v):
    a, b = (df.select((F.col("det_id") % 50).alias("k"), F.col("category_id").alias("kind"), "det_id", "x", "score").where(F.col("k") != gone) for df, gone in ((v.dt, 7), (v.dt_method, 9)))
    return V.compare_by_kind(a, b, ["k"], "kind", ["det_id", "x", "score"])


@query("v11_category_check", "SELECT [1, 2, 3] AS observed, [5] AS missing, [3] AS unexpected, false AS complete FROM (SELECT count(DISTINCT category_id) AS n FROM dt) q WHERE n = 3")
def _(v):
    return V.category_check(v.dt, [1, 2, 5])


@query("v12_tables_identical", "WITH a AS (SELECT det_id, x, score FROM dt), b AS (SELECT det_id, x, score FROM dt_method) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_right, (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) = 0 AS identical")
def _(v):
    return V.tables_identical(v.dt.select("det_id", "x", "score"), v.dt_method.select("det_id", "x", "score"))


@query("v13_accept_runs", "WITH r AS (SELECT *, CASE WHEN NOT ap > 0.28e0 THEN 'ap' WHEN NOT latency_mean_ms < 4.6e0 THEN 'latency' END AS reason FROM runs) SELECT method, seed, reason, reason IS NULL AS accepted FROM r")
def _(v):
    rules = [("ap", F.col("ap") > 0.28), ("latency", F.col("latency_mean_ms") < 4.6)]
    return V.accept_runs(v.runs, rules).select("method", "seed", "reason", "accepted")


@query("v14_fair_group", "SELECT method, count(DISTINCT seed % 3) = 1 AND count(DISTINCT method) = 1 AS fair, count(DISTINCT seed % 3) AS n_model_hash, count(DISTINCT method) AS n_data_hash FROM runs WHERE seed IN (0, 3, 6) OR method LIKE '2%' GROUP BY method")
def _(v):
    runs = v.runs.where("seed in (0, 3, 6) or method like '2%'").select("method", (F.col("seed") % 3).alias("model_hash"), F.col("method").alias("data_hash"))
    return V.fair_group(runs, "method", ["model_hash", "data_hash"])


@query("v15_verify_manifest", "SELECT CASE WHEN doc_id % 20 = 0 THEN 'missing' WHEN doc_id % 20 = 1 THEN 'size' WHEN doc_id % 20 = 2 THEN 'hash' ELSE 'ok' END AS status, count(*) AS n FROM members GROUP BY 1")
def _(v):
    docs = v.documents.select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.octet_length("text").alias("size"), F.sha2("text", 256).alias("sha256"))
    k = F.col("doc_id") % 20
    manifest = docs.select("path", F.when(k == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(k == 2, F.lit("0")).otherwise(F.col("sha256")).alias("sha256"))
    return V.verify_manifest(manifest, docs.where(k != 0)).groupBy("status").agg(F.count("*").alias("n"))


@query("v16_anchor_check", "SELECT method, seed, abs(ap - 0.3e0) <= 0.01e0 AS within FROM runs")
def _(v):
    return V.anchor_check(v.runs.withColumn("anchor", F.lit(0.3)), "ap", "anchor", 0.01).select("method", "seed", "within")


@query("j1_iou_join", "SELECT ann_id, det_id, round(iou, 6) AS iou FROM pairs WHERE iou >= 0.5e0")
def _(v):
    return J.iou_join(v.xy_gt, v.xy_dt, 0.5, "ann_id", "det_id").select(F.col("left_id").alias("ann_id"), F.col("right_id").alias("det_id"), *r("iou"))


@query("j2_point_in_region", "SELECT d.det_id, d.image_id, min(r.region_id) AS region_id FROM xy_dt d JOIN regions r ON d.image_id = r.image_id AND (x1+x2)/2 >= rx1 AND (x1+x2)/2 < rx2 AND (y1+y2)/2 >= ry1 AND (y1+y2)/2 < ry2 GROUP BY d.det_id, d.image_id")
def _(v):
    return J.point_in_region(v.xy_dt, v.regions, "det_id")


@query("j3_covering_join", "SELECT i.image_id, i.cluster_id, c.c_name FROM images i JOIN customer c ON i.image_id = c.c_custkey")
def _(v):
    return J.covering_join(v.images.select("image_id", "cluster_id"), v.customer.select(F.col("c_custkey").alias("image_id"), "c_name"), "image_id")


@query("j4_restrict_images", "SELECT i.image_id, count(d.det_id) AS n FROM (SELECT image_id FROM images WHERE cluster_id < 10) i LEFT JOIN dt d ON i.image_id = d.image_id GROUP BY i.image_id")
def _(v):
    return J.restrict_to_images(v.dt, v.images, v.images.where("cluster_id < 10")).groupBy("image_id").agg(F.count("det_id").alias("n"))


@query("j5_decontaminate", "WITH t AS (SELECT * FROM members WHERE source_key % 3 = 0), v AS (SELECT * FROM members WHERE doc_id % 2 = 1 OR source_key % 3 <> 0) SELECT doc_id FROM v WHERE source_key NOT IN (SELECT source_key FROM t) AND sha NOT IN (SELECT sha FROM t)")
def _(v):
    m = v.members
    return J.decontaminate(m.where("doc_id % 2 = 1 or source_key % 3 <> 0"), m.where("source_key % 3 = 0"), ["source_key", "sha"]).select("doc_id")


@query("j6_exactly_one", "WITH q AS (SELECT p_partkey FROM part), n AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity >= 49 GROUP BY 1) SELECT p_partkey, n.n AS n_found, CASE WHEN n.n IS NULL THEN 'none' WHEN n.n = 1 THEN 'one' ELSE 'several' END AS status FROM q LEFT JOIN n ON p_partkey = l_partkey")
def _(v):
    return J.lookup_exactly_one(v.part.select("p_partkey"), v.lineitem.where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


METHODS = ("1-URGENT", "2-HIGH")


@query("j7_paired_runs", "SELECT a.seed, a.ap AS baseline, b.ap AS candidate, round(b.ap - a.ap, 9) AS delta FROM runs a JOIN runs b ON a.seed = b.seed WHERE a.method = '1-URGENT' AND b.method = '2-HIGH'")
def _(v):
    weights = v.runs.withColumn("weights", F.sha2(F.col("seed").cast("string"), 256))  # the same weights for both runs of a seed
    return J.paired_runs(weights, ["seed"], *METHODS, "ap", equal=["weights"]).withColumn("delta", F.round("delta", 9))


@query("j8_ablation_long", "SELECT axis, level, metric, value FROM (SELECT 'seeds' AS axis, seed AS level, method, ap, eic_mean FROM runs WHERE seed IN (1,2,3) UNION ALL SELECT 'rest', seed, method, ap, eic_mean FROM runs WHERE seed IN (0,3)) r UNPIVOT (value FOR metric IN (ap, eic_mean))")
def _(v):
    registry = v.region.select("r_regionkey").where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "seeds").otherwise("rest").alias("axis"), F.when(F.col("r_regionkey") == 0, F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(F.lit(0), F.lit(3))).alias("levels"))
    return J.ablation_long(registry, v.runs, "seed", ["ap", "eic_mean"])


@query("j9_axis_grid", "SELECT image_id, kind, severity FROM images CROSS JOIN (VALUES ('fog'), ('low_light'), ('gaussian_blur')) k(kind) CROSS JOIN (VALUES (1), (2), (3)) s(severity)")
def _(v):
    return J.axis_grid(v.images, ["fog", "low_light", "gaussian_blur"], [1, 2, 3])


@query("x1_union_boxes", "SELECT image_id, count(*) AS n, round(sum(score), 6) AS total FROM (SELECT image_id, score FROM dt UNION ALL SELECT image_id, score FROM dt_local) u GROUP BY image_id")
def _(v):
    u = v.dt.select("image_id", "score").unionByName(v.dt_local.select("image_id", "score"))
    return u.groupBy("image_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"))


@query("x2_bank_latency", "SELECT image_id, count(*) AS n, round(sum(total_ms), 6) AS total_ms FROM (SELECT image_id, total_ms FROM timings WHERE model_id = 0 UNION ALL SELECT image_id, total_ms FROM timings WHERE model_id = 1) u GROUP BY image_id")
def _(v):
    t = v.timings.select("image_id", "total_ms", "model_id")
    return t.where("model_id = 0").unionByName(t.where("model_id = 1")).groupBy("image_id").agg(F.count("*").alias("n"), *[F.round(F.sum("total_ms"), 6).alias("total_ms")])


@query("x3_intersect", "SELECT sha FROM members WHERE doc_id % 2 = 0 INTERSECT SELECT sha FROM members WHERE doc_id % 2 = 1")
def _(v):
    return v.members.where("doc_id % 2 = 0").select("sha").intersect(v.members.where("doc_id % 2 = 1").select("sha"))


@query("x4_except", "SELECT image_id FROM images EXCEPT ALL SELECT image_id FROM (SELECT DISTINCT image_id FROM dt WHERE score > 0.8e0) d")
def _(v):
    return v.images.select("image_id").exceptAll(v.dt.where("score > 0.8").select("image_id").distinct())


@query("a1_dataset_gaps", """WITH d AS (SELECT * FROM gt_dirty) SELECT (SELECT count(*) FROM images) AS n_images, (SELECT count(*) FROM images WHERE image_id NOT IN (SELECT image_id FROM d)) AS n_without_annotations,
(SELECT count(DISTINCT image_id) FROM d WHERE image_id NOT IN (SELECT image_id FROM images)) AS n_orphans, CAST((SELECT count(*) FROM d WHERE w <= 0 OR h <= 0) AS BIGINT) AS n_dropped""")
def _(v):
    return A.dataset_gaps(v.images, v.gt_dirty)


@query("a1_dataset_stats", "SELECT category_id, size, count(*) AS n FROM (SELECT category_id, CASE WHEN w*h < 1024 THEN 'small' WHEN w*h < 9216 THEN 'medium' ELSE 'large' END AS size FROM gt) g GROUP BY ROLLUP (category_id, size)")
def _(v):
    return A.dataset_stats(v.images, v.gt)


#: Means of exact halves of the last digit depend on the order of a sum in their last bit; this much settles them upward in both engines.
NUDGE = 1e-10


def _stats_sql(expr, name):
    q = "".join(f", round(coalesce(quantile_cont({expr}, {p}), 0) + {NUDGE}, 6) AS {name}_{n}" for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (0.9, "q90")))
    return f"round(coalesce(avg({expr}), 0) + {NUDGE}, 6) AS {name}_mean, round(coalesce(stddev_pop({expr}), 0) + {NUDGE}, 6) AS {name}_std, round(coalesce(min({expr}), 0) + {NUDGE}, 6) AS {name}_min{q}, round(coalesce(max({expr}), 0) + {NUDGE}, 6) AS {name}_max"


def _features_sql():
    out = ["image_id", "CAST(count(score) AS DOUBLE) AS count", f"round(ln(1+count(score)) + {NUDGE}, 6) AS log_count", f"round(count(score)/2.0736e0 + {NUDGE}, 6) AS count_per_megapixel", _stats_sql("score", "score")]
    for t in A.SCORE_LEVELS:
        out += [f"CAST(count(*) FILTER (score >= {t}e0) AS DOUBLE) AS count_ge_{round(t * 100)}", f"round(count(*) FILTER (score >= {t}e0)/greatest(count(score),1) + {NUDGE}, 6) AS fraction_ge_{round(t * 100)}"]
    for k in CATEGORIES:
        out += [f"CAST(count(*) FILTER (category_id = {k}) AS DOUBLE) AS class_{k}_count", f"round(count(*) FILTER (category_id = {k})/greatest(count(score),1) + {NUDGE}, 6) AS class_{k}_fraction"]
    for name, e in (("area", "((x2-x1)/1920)*((y2-y1)/1080)"), ("width", "(x2-x1)/1920"), ("height", "(y2-y1)/1080"), ("center_x", "cx"), ("center_y", "cy")):
        out.append(_stats_sql(e, f"box_{name}"))
    out += [
        f"round(count(*) FILTER (cx < 0.1e0 OR cx > 0.9e0 OR cy < 0.1e0 OR cy > 0.9e0)/greatest(count(score),1) + {NUDGE}, 6) AS border_fraction",
        f"round(abs(count(*) FILTER (cx < 0.5e0) - count(*) FILTER (cx >= 0.5e0))/greatest(count(score),1) + {NUDGE}, 6) AS left_right_imbalance",
        f"round(abs(count(*) FILTER (cy < 0.5e0) - count(*) FILTER (cy >= 0.5e0))/greatest(count(score),1) + {NUDGE}, 6) AS top_bottom_imbalance",
    ]
    return f"WITH d AS (SELECT i.image_id, score, category_id, x1, y1, x2, y2, (x1+x2)/3840e0 AS cx, (y1+y2)/2160e0 AS cy FROM images i LEFT JOIN xy_dt d ON i.image_id = d.image_id) SELECT {', '.join(out)} FROM d GROUP BY image_id"


@query("a2_view_features", _features_sql())
def _(v):
    f = A.view_features(v.xy_dt, v.images, CATEGORIES)
    return f.select("image_id", *[F.round(F.col(c) + NUDGE, 6).alias(c) for c in f.columns if c != "image_id"])


@query("a4_timing_summary", "SELECT model_id, count(*) AS n, round(avg(total_ms), 6) AS mean_ms, round(avg(total_ms), 6) AS mean_without_load_ms, round(stddev_pop(total_ms), 6) AS std_ms, round(quantile_cont(total_ms, 0.5), 6) AS p50_ms, round(quantile_cont(total_ms, 0.95), 6) AS p95_ms, round(1000/avg(total_ms), 6) AS fps, round(max(total_ms), 6) AS max_ms FROM timings GROUP BY model_id")
def _(v):
    return A.timing_summary(v.timings, "model_id").select("model_id", "n", *r("mean_ms", "mean_without_load_ms", "std_ms", "p50_ms", "p95_ms", "fps", "max_ms"))


@query("v13_run_evidence", """WITH i AS (SELECT image_id, CAST(image_id % 12 AS INT) AS run_id FROM images), g AS (SELECT run_id, count(*) AS n FROM i GROUP BY run_id)
SELECT run_id, CASE run_id WHEN 1 THEN 'no success marker' WHEN 2 THEN 'missing artifact' WHEN 3 THEN 'missing configuration field' WHEN 4 THEN 'tuned on a test split' WHEN 5 THEN 'config_sha256' WHEN 6 THEN 'annotation_sha256' WHEN 7 THEN 'model fingerprint'
 WHEN 8 THEN 'timing rows' WHEN 9 THEN 'foreign timing rows' WHEN 10 THEN 'evaluated images' END AS reason, run_id IN (0, 11) AS accepted, n AS n_images FROM g""")
def _(v):
    """Runs made of the images, each of ten with one fault."""
    i = v.images.select("image_id", (F.col("image_id") % 12).cast("int").alias("run_id"))
    n = i.groupBy("run_id").agg(F.count("*").alias("n"))
    sha = lambda *parts: F.sha2(F.concat_ws("/", *[F.col("run_id").cast("string"), *map(F.lit, parts)]), 256)
    fault = lambda k, bad, good: F.when(F.col("run_id") == k, bad).otherwise(good)
    text = {c: F.lit("x") for c in V.RUN_FIELDS if c not in ("dataset_split", "method_name", "runtime_tune")}
    runs = n.select(
        "run_id", *[c.alias(k) for k, c in text.items()], fault(4, F.lit("test-a"), F.lit("val")).alias("dataset_split"), fault(3, F.lit(None), F.lit("m")).alias("method_name"), (F.col("run_id") == 4).alias("runtime_tune"),
        fault(10, F.col("n") + 1, F.col("n")).alias("images_evaluated"), fault(7, F.lit("short"), sha("model")).alias("model_sha256"), sha("annotation").alias("annotation_sha256"),
    )
    files = n.select("run_id", F.explode(F.array(*[F.struct(F.lit(p).alias("path"), sha(p).alias("sha256")) for p in (V.RUN_MARKER, *V.RUN_ARTIFACTS)])).alias("f")).select("run_id", "f.path", "f.sha256")
    files = files.where(~((F.col("run_id") == 1) & (F.col("path") == V.RUN_MARKER)) & ~((F.col("run_id") == 2) & (F.col("path") == "metrics.json")))
    claims = n.select("run_id", *[fault(5, F.lit("other"), sha(p)).alias(h) if h == "config_sha256" else sha(p).alias(h) for h, p in V.RUN_HASHES.items()], fault(6, F.lit("other"), sha("annotation")).alias("annotation_sha256"))
    first = F.row_number().over(Window.partitionBy("run_id").orderBy("image_id")) == 1
    timed = i.withColumn("first", first).where(~((F.col("run_id") == 8) & F.col("first"))).select("run_id", F.when((F.col("run_id") == 9) & F.col("first"), F.lit(0)).otherwise(F.col("run_id")).alias("row_run_id"))
    return V.accept_runs(V.run_evidence(runs, files, claims, i, timed), V.run_rules()).select("run_id", "reason", "accepted", "n_images")


@query("a4_stage_summary", "SELECT model_id, count(*) AS n, round(avg(total_ms - total_ms/8), 6) AS mean_without_load_ms, round(avg(total_ms/4), 6) AS base_ms_mean, round(avg(total_ms/2), 6) AS crop_ms_mean, max(event_id % 1000) AS peak_memory FROM timings GROUP BY model_id")
def _(v):
    t = v.timings.withColumns({"load_ms": F.col("total_ms") / 8, "base_ms": F.col("total_ms") / 4, "crop_ms": F.col("total_ms") / 2, "memory_mb": F.col("event_id") % 1000})
    return A.timing_summary(t, "model_id", load="load_ms", stages=["base_ms", "crop_ms"], memory="memory_mb").select("model_id", "n", *r("mean_without_load_ms", "base_ms_mean", "crop_ms_mean"), "peak_memory")


@query("a5_repeat_statistics", "SELECT method, seed, round(avg(ap) OVER (PARTITION BY method), 6) AS ap_mean, round(stddev_pop(ap) OVER (PARTITION BY method), 6) AS ap_std, string_agg(CAST(seed AS VARCHAR), ',') OVER (PARTITION BY method ORDER BY CAST(seed AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS repeat_ids FROM runs")
def _(v):
    return A.repeat_statistics(v.runs, ["method"], "ap", "seed").select("method", "seed", *r("ap_mean", "ap_std"), "repeat_ids")


@query("a6_run_row", "SELECT r.method, r.seed, r.ap, CASE WHEN r.ap > b.ap THEN round((r.latency_mean_ms - b.latency_mean_ms)/(r.ap - b.ap), 2) END AS ms_per_ap, CASE WHEN r.ap > b.ap THEN round((r.eic_mean - b.eic_mean)/(r.ap - b.ap), 2) END AS cost_per_ap FROM runs r JOIN runs b ON r.seed = b.seed AND b.method = '1-URGENT'")
def _(v):
    return A.gain_cost(v.runs, "1-URGENT").select("method", "seed", "ap", *r("ms_per_ap", "cost_per_ap", digits=2))


EVIDENCE = """u AS (SELECT image_id, CAST(image_id % 4 AS INT) AS run_id FROM images), t AS (SELECT model_id AS run_id, image_id, total_ms, 1 + (event_id % 5)/4e0 AS inference_cost FROM timings)"""


@query("a6_run_rows", f"""WITH {EVIDENCE}, b AS (SELECT run_id, CAST(run_id AS DOUBLE)/10 + 0.3e0 AS ap, 0.4e0 AS baseline_ap, 40e0 AS baseline_ms FROM u GROUP BY run_id),
m AS (SELECT run_id, count(*) AS n_timed, avg(total_ms) AS mean_ms, quantile_cont(total_ms, 0.95) AS p95_ms, avg(inference_cost) AS cost_mean FROM t GROUP BY run_id),
s AS (SELECT CAST(image_id % 4 AS INT) AS run_id, image_id, count(*) FILTER (u > 0.7e0) AS n, count(*) FILTER (u > 0.7e0)/16e0 AS area FROM traits GROUP BY ALL), sr AS (SELECT run_id, avg(n) AS regions_mean, avg(area) AS area_ratio_mean, avg(CASE WHEN n > 0 THEN 1e0 ELSE 0e0 END) AS active_share FROM s GROUP BY run_id),
c AS (SELECT CAST(image_id % 4 AS INT) AS run_id, count(*) AS n_candidates, avg(d - u) AS q_mean, avg(CASE WHEN d - u > 0 THEN 1e0 ELSE 0e0 END) AS useful_share, count(*) FILTER (d - u > 0.5e0) AS n_chosen FROM traits GROUP BY 1)
SELECT b.run_id, n_timed, round(mean_ms, 6) AS mean_ms, round(p95_ms, 6) AS p95_ms, round(regions_mean, 6) AS regions_mean, round(area_ratio_mean, 6) AS area_ratio_mean, round(active_share, 6) AS active_share, n_candidates, round(q_mean + 1e-10, 6) AS q_mean, round(useful_share, 6) AS useful_share, n_chosen,
CASE WHEN ap > baseline_ap THEN round((mean_ms - baseline_ms)/(ap - baseline_ap), 3) END AS extra_ms_per_ap, CASE WHEN ap > baseline_ap THEN round((cost_mean - 1)/(ap - baseline_ap), 3) END AS extra_cost_per_ap
FROM b JOIN m USING (run_id) JOIN sr USING (run_id) JOIN c USING (run_id)""")
def _(v):
    run = (F.col("image_id") % 4).cast("int").alias("run_id")
    runs = v.images.select(run).distinct().select("run_id", (F.col("run_id").cast("double") / 10 + 0.3).alias("ap"), F.lit(0.4).alias("baseline_ap"), F.lit(40.0).alias("baseline_ms"))
    timings = v.timings.select(F.col("model_id").alias("run_id"), "total_ms", (1 + (F.col("event_id") % 5) / 4.0).alias("inference_cost"))
    chosen = v.traits.groupBy(run, "image_id").agg(F.count_if(F.col("u") > 0.7).alias("n_regions"), (F.count_if(F.col("u") > 0.7) / 16.0).alias("area_ratio"))
    candidates = v.traits.select(run, (F.col("d") - F.col("u")).alias("q"), (F.col("d") - F.col("u") > 0.5).alias("chosen"))
    rows = A.run_rows(runs, timings, chosen, candidates).withColumn("q_mean", F.col("q_mean") + 1e-10)
    return rows.select("run_id", "n_timed", *r("mean_ms", "p95_ms", "regions_mean", "area_ratio_mean", "active_share"), "n_candidates", *r("q_mean", "useful_share"), "n_chosen", *r("extra_ms_per_ap", "extra_cost_per_ap", digits=3))


@query("a7_trajectory_summary", """WITH j AS (SELECT r.*, r.ap - b.ap AS d FROM runs r JOIN runs b ON r.seed = b.seed AND b.method = '1-URGENT'), g AS (SELECT method, count(*) AS n, avg(ap) AS mean, stddev_samp(ap) AS std, min(ap) AS low, max(ap) AS high, avg(d) AS delta, stddev_samp(d) AS ds FROM j GROUP BY method)
SELECT method, n, round(mean, 6) AS mean, round(std, 6) AS std, round(low, 6) AS low, round(high, 6) AS high, round(delta, 6) AS delta, round(delta - 2.4469118487916806e0*ds/sqrt(n), 6) AS delta_low, round(delta + 2.4469118487916806e0*ds/sqrt(n), 6) AS delta_high FROM g""")
def _(v):
    return A.trajectory_summary(v.runs, "1-URGENT").select("method", "n", *r("mean", "std", "low", "high", "delta", "delta_low", "delta_high"))


@query("a8_threshold_checks", "SELECT method, seed, ap > 0.25e0 AS ap_floor, latency_mean_ms < 5 AS fast, ap > 0.25e0 AND latency_mean_ms < 5 AS all_pass FROM runs")
def _(v):
    return A.threshold_checks(v.runs, {"ap_floor": F.col("ap") > 0.25, "fast": F.col("latency_mean_ms") < 5}).select("method", "seed", "ap_floor", "fast", "all_pass")


@query("a9_latency_contrast", """WITH k AS (SELECT model_id, cycle, chunk, avg(total_ms) AS ms FROM timings GROUP BY ALL), c AS (SELECT model_id, cycle, avg(ms) AS ms FROM k GROUP BY ALL), j AS (SELECT c.*, c.ms/b.ms AS ratio FROM c JOIN c b ON c.cycle = b.cycle AND b.model_id = 0)
SELECT model_id, round(quantile_cont(ms, 0.5), 6) AS median_ms, round(min(ms), 6) AS min_ms, round(max(ms), 6) AS max_ms, round(quantile_cont(ratio, 0.5), 6) AS median_ratio, round(max(ratio), 6) AS max_ratio, quantile_cont(ratio, 0.5) BETWEEN 0.85 AND 1.15 AS equivalent, max(ratio) <= 1.5 AS under_ceiling FROM j GROUP BY model_id""")
def _(v):
    return A.latency_contrast(v.timings, 0).select("model_id", *r("median_ms", "min_ms", "max_ms", "median_ratio", "max_ratio"), "equivalent", "under_ceiling")


@query("a10_latency_ratio_max", "WITH c AS (SELECT model_id, cycle, avg(total_ms) AS ms FROM timings GROUP BY ALL) SELECT c.model_id, round(max(c.ms/b.ms), 6) AS worst_ratio FROM c JOIN c b ON c.cycle = b.cycle AND b.model_id = 0 GROUP BY c.model_id")
def _(v):
    return A.latency_ratio_max(v.timings, 0).select("model_id", *r("worst_ratio"))


@query("a11_mechanism_images", f"SELECT t.image_id, round(avg(d) + {NUDGE}, 6) AS d_mean, round(avg(u) + {NUDGE}, 6) AS u_mean, round(avg(d*u) + {NUDGE}, 6) AS du_mean, count(*) AS n_regions, any_value(i.cluster_id) AS cluster_id FROM traits t JOIN images i ON t.image_id = i.image_id WHERE d > 0.5e0 GROUP BY t.image_id")
def _(v):
    t = v.traits.withColumn("selected", F.col("d") > 0.5)
    return A.mechanism_images(t, v.images.select("image_id", "cluster_id")).select("image_id", *[F.round(F.col(c) + NUDGE, 6).alias(c) for c in ("d_mean", "u_mean", "du_mean")], "n_regions", "cluster_id")


@query("a12_outcome_summary", "SELECT method, count(*) AS n, round(avg(delta), 6) AS mean_delta, round(avg(CASE WHEN delta > 1e-12 THEN 1e0 ELSE 0e0 END), 6) AS positive_rate, round(avg(CASE WHEN delta < -1e-12 THEN 1e0 ELSE 0e0 END), 6) AS harm_rate, round(avg(CASE WHEN abs(delta) <= 1e-12 THEN 1e0 ELSE 0e0 END), 6) AS neutral_rate FROM deltas GROUP BY method")
def _(v):
    return A.outcome_summary(v.deltas, ["method"], "delta").select("method", "n", *r("mean_delta", "positive_rate", "harm_rate", "neutral_rate"))


@query("a13_coordinate_ranges", "SELECT method, CAST(seed % 3 AS INT) AS coordinate, round(min(ap), 9) AS minimum, round(max(ap), 9) AS maximum, round(max(ap) - min(ap), 9) AS spread FROM runs GROUP BY ALL")
def _(v):
    cells = v.runs.withColumn("coordinate", (F.col("seed") % 3).cast("int"))
    return A.coordinate_ranges(cells, ["method"], "coordinate", "ap").select("method", "coordinate", *r("minimum", "maximum", "spread", digits=9))


@query("a13_allocation_profile", "WITH d AS (SELECT r.method, r.seed, round(r.ap - b.ap, 6) AS delta FROM runs r JOIN runs b ON r.seed = b.seed AND b.method = '1-URGENT') SELECT method, " + ", ".join(f"max(delta) FILTER (seed = {s}) AS seed_{s}" for s in range(7)) + " FROM d GROUP BY method")
def _(v):
    p = A.allocation_profile(v.runs, "method", "seed", "ap", "1-URGENT", list(range(7)))
    return p.select("method", *[F.col(str(s)).alias(f"seed_{s}") for s in range(7)])


@query("a14_delta_vs_reference", "SELECT r.method, r.seed, round(r.ap - b.ap, 6) AS delta FROM runs r JOIN runs b ON r.method = b.method AND b.seed = 0")
def _(v):
    return A.delta_vs_reference(v.runs, ["method"], F.col("seed") == 0, "ap").select("method", "seed", *r("delta"))


@query("a15_median_mad", "WITH l AS (SELECT 'd' AS feature, d AS v FROM traits UNION ALL SELECT 'u', u FROM traits), m AS (SELECT feature, quantile_cont(v, 0.5) AS median FROM l GROUP BY 1) SELECT feature, round(median, 6) AS median, round(quantile_cont(abs(v - median), 0.5), 6) AS mad FROM l JOIN m USING (feature) GROUP BY feature, median")
def _(v):
    return A.median_mad(v.traits, ["d", "u"]).select("feature", *r("median", "mad"))


@query("a16_composition_counts", "SELECT CASE WHEN image_id % 3 = 0 THEN 'replay' ELSE 'target' END AS role, cluster_id AS view, count(*) AS n FROM images GROUP BY ALL")
def _(v):
    role = F.when(F.col("image_id") % 3 == 0, "replay").otherwise("target")
    return v.images.groupBy(role.alias("role"), F.col("cluster_id").alias("view")).agg(F.count("*").alias("n"))


@query("a17_metric_long_table", "SELECT method, 'ap' AS metric, ap AS value, seed FROM runs UNION ALL SELECT method, 'eic', eic_mean, NULL FROM runs")
def _(v):
    return A.metric_long_table([v.runs.select("method", F.lit("ap").alias("metric"), F.col("ap").alias("value"), "seed"), v.runs.select("method", F.lit("eic").alias("metric"), F.col("eic_mean").alias("value"))])


@query("a18_timing_rows", "WITH g AS (SELECT image_id, sum((rx2-rx1)*(ry2-ry1)) AS area, count(*) AS n FROM regions WHERE region_id < 3 GROUP BY 1), t AS (SELECT image_id, sum(total_ms) AS ms FROM timings GROUP BY 1) SELECT i.image_id, round(coalesce(ms, 0), 6) AS stage_ms, coalesce(g.n, 0) + 1 AS calls, round(coalesce(g.n, 0) + 1 + coalesce(g.area, 0)/2073600e0, 6) AS cost FROM images i LEFT JOIN g USING (image_id) LEFT JOIN t USING (image_id)")
def _(v):
    return A.timing_rows(v.images, v.regions.where("region_id < 3"), v.timings).select("image_id", *r("stage_ms"), "calls", *r("cost"))


