"""Registered queries: ranks, region scores, sampling and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import select as S
from ..operators import windows as W
from ..operators.skyline import pareto
from ..registry import query
from ..sources.shared import written

WEIGHTS_D = {"d": 0.6, "edge": 0.4}
WEIGHTS_U = {"entropy": 0.4, "proximity": 0.3, "class_conflict": 0.2, "density": 0.1}


def rank_sql(value, keys, table):
    return f"(rank() OVER (PARTITION BY {keys} ORDER BY {value}) + (count(*) OVER (PARTITION BY {keys}, {value}) - 1)/2e0)"


def rank01_sql(value, keys):
    return f"CASE WHEN count(*) OVER (PARTITION BY {keys}) = 1 THEN 0.5e0 ELSE ({rank_sql(value, keys, '')} - 1)/(count(*) OVER (PARTITION BY {keys}) - 1) END"


def mixed_sql(value, keys, mix):
    c = f"least(1e0, greatest(0e0, {value}))"
    w = f"OVER (PARTITION BY {keys})"
    return f"CASE WHEN count(*) {w} <= 1 OR max({value}) {w} - min({value}) {w} <= 1e-8 + 1e-5*abs(min({value}) {w}) THEN {c} ELSE {mix}*({rank01_sql(value, keys)}) + (1-{mix})*{c} END"


@query("w1_rank01", f"SELECT image_id, region_id, round({rank01_sql('d', 'image_id')}, 6) AS rank01 FROM traits")
def _(v):
    return v.traits.select("image_id", "region_id", F.round(W.rank01("d", ["image_id"]), 6).alias("rank01"))


@query("w2_avg_rank", f"SELECT image_id, region_id, round({rank_sql('u', 'image_id', '')}, 6) AS avg_rank FROM traits")
def _(v):
    return v.traits.select("image_id", "region_id", F.round(W.avg_rank("u", ["image_id"]), 6).alias("avg_rank"))


@query("w3_mixed_normalize", f"SELECT image_id, region_id, round({mixed_sql('d', 'image_id', '0.5e0')}, 6) AS value FROM traits")
def _(v):
    return v.traits.select("image_id", "region_id", F.round(W.mixed_normalize("d", ["image_id"], 0.5), 6).alias("value"))


def robust_sql(f, w):
    z = f"least(60e0, greatest(-60e0, ({f} - m.{f}_med)/(1.4826e0*m.{f}_mad + 1e-12)))"
    return f"{w}e0*(0.5e0*({rank01_sql(f, 'image_id')}) + 0.5e0/(1 + exp(-{z})))"


@query("w4_score_degradation", f"""WITH a AS (SELECT quantile_cont(d, 0.5) AS d_med, quantile_cont(edge, 0.5) AS edge_med FROM traits), m AS (SELECT d_med, edge_med, quantile_cont(abs(d - d_med), 0.5) AS d_mad, quantile_cont(abs(edge - edge_med), 0.5) AS edge_mad FROM traits, a GROUP BY ALL)
SELECT image_id, region_id, round(least(1e0, greatest(0e0, {robust_sql('d', 0.6)} + {robust_sql('edge', 0.4)})), 6) AS degradation FROM traits, m""")
def _(v):
    from ..operators.aggregates import median_mad

    traits = written(v.traits.select("image_id", "region_id", *WEIGHTS_D), "traits")
    return W.score_degradation(traits, median_mad(traits, list(WEIGHTS_D)), WEIGHTS_D, 0.5).select("image_id", "region_id", F.round("degradation", 6).alias("degradation"))


CONFLICT = """SELECT a.image_id, a.region_id, sum(greatest(0e0, least(a.x2,b.x2)-greatest(a.x1,b.x1))*greatest(0e0, least(a.y2,b.y2)-greatest(a.y1,b.y1))
 /((a.x2-a.x1)*(a.y2-a.y1)+(b.x2-b.x1)*(b.y2-b.y1)-greatest(0e0, least(a.x2,b.x2)-greatest(a.x1,b.x1))*greatest(0e0, least(a.y2,b.y2)-greatest(a.y1,b.y1)))*sqrt(a.score*b.score))/(count(*) + 1e-12) AS class_conflict
 FROM xy_local a JOIN xy_local b ON a.image_id = b.image_id AND a.region_id = b.region_id AND a.det_id < b.det_id AND a.category_id <> b.category_id GROUP BY a.image_id, a.region_id"""
RAW = f"""WITH k AS ({CONFLICT}), g AS (SELECT image_id, region_id, avg((-s*ln(s)-(1-s)*ln(1-s))/ln(2e0)) AS entropy, avg(exp(-abs(score-0.25e0)/0.1e0)) AS proximity, sum(1-score) AS residual, count(*) AS candidates
  FROM (SELECT *, least(1-1e-12, greatest(1e-12, score)) AS s FROM xy_local) q GROUP BY image_id, region_id),
raw AS (SELECT r.image_id, r.region_id, coalesce(entropy, 0) AS entropy, coalesce(proximity, 0) AS proximity, coalesce(class_conflict, 0) AS class_conflict, 1 - exp(-coalesce(residual, 0)/(1e-4*(rx2-rx1)*(ry2-ry1))) AS density, coalesce(candidates, 0) AS candidates
  FROM regions r LEFT JOIN g ON r.image_id = g.image_id AND r.region_id = g.region_id LEFT JOIN k ON r.image_id = k.image_id AND r.region_id = k.region_id)"""
UNCERTAIN = " + ".join(f"{w}e0*({mixed_sql(n, 'image_id', '0.5e0')})" for n, w in WEIGHTS_U.items())


@query("w5_score_uncertainty", f"{RAW} SELECT image_id, region_id, round(least(1e0, greatest(0e0, {UNCERTAIN})), 4) AS uncertainty FROM raw")
def _(v):
    return W.score_uncertainty(v.xy_local, v.regions, WEIGHTS_U).select("image_id", "region_id", F.round("uncertainty", 4).alias("uncertainty"))


@query("w6_class_conflict", f"SELECT image_id, region_id, round(class_conflict, 6) AS class_conflict FROM ({CONFLICT}) c")
def _(v):
    return W.class_conflict(v.xy_local, ["image_id", "region_id"], "det_id").select("image_id", "region_id", F.round("class_conflict", 6).alias("class_conflict"))


@query("w7_max_region_uncertainty", f"{RAW}, s AS (SELECT image_id, least(1e0, greatest(0e0, {UNCERTAIN})) AS u FROM raw) SELECT image_id, round(max(u), 4) AS gate FROM s GROUP BY image_id")
def _(v):
    return W.score_uncertainty(v.xy_local, v.regions, WEIGHTS_U).groupBy("image_id").agg(F.round(F.max("uncertainty"), 4).alias("gate"))


COMBINED = """WITH c AS (SELECT t.*, coalesce(g.n, 0) AS candidates FROM traits t LEFT JOIN (SELECT image_id, region_id, count(*) AS n FROM dt_local GROUP BY ALL) g ON t.image_id = g.image_id AND t.region_id = g.region_id),
b AS (SELECT *, candidates = 0 AND row_number() OVER (PARTITION BY image_id ORDER BY edge, region_id) <= ceil(count(*) OVER (PARTITION BY image_id)*0.25) AS blank, (0.5e0*d + 0.5e0*u + 0.25e0*d*u)/1.25e0 AS raw FROM c),
s AS (SELECT *, least(1e0, greatest(0e0, CASE WHEN blank THEN raw*0.3e0 ELSE raw END)) AS difficulty FROM b)"""


def combined(v):
    n = v.dt_local.groupBy("image_id", "region_id").agg(F.count("*").alias("candidates"))
    return W.combine_scores(v.traits.join(n, ["image_id", "region_id"], "left").fillna(0, ["candidates"]), 0.5, 0.25, 0.3)


@query("w8_combine_scores", f"{COMBINED} SELECT image_id, region_id, round(difficulty, 6) AS difficulty, blank FROM s")
def _(v):
    return combined(v).select("image_id", "region_id", F.round("difficulty", 6).alias("difficulty"), "blank")


@query("w9_make_grid", """WITH g AS (SELECT image_id, n AS region_id, n % 4 AS c, CAST(floor(n/4) AS INT) AS r FROM images, (SELECT CAST(unnest(range(16)) AS INT) AS n))
SELECT image_id, region_id, CAST(c*480 AS BIGINT) AS rx1, CAST(r*270 AS BIGINT) AS ry1, CAST(c*480+480 AS BIGINT) AS rx2, CAST(r*270+270 AS BIGINT) AS ry2, CAST(greatest(0, c*480-48) AS BIGINT) AS cx1, CAST(greatest(0, r*270-27) AS BIGINT) AS cy1, CAST(least(1920, c*480+528) AS BIGINT) AS cx2, CAST(least(1080, r*270+297) AS BIGINT) AS cy2, 0.0625e0 AS area_ratio FROM g""")
def _(v):
    return W.make_grid(v.images, 4, 4, 0.1)


@query("w10_precision_envelope", """WITH c AS (SELECT category_id, det_id, score, sum(tp) OVER w AS ctp, row_number() OVER w AS n, image_id FROM matches WINDOW w AS (PARTITION BY category_id ORDER BY score DESC, image_id, det_id ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, ctp/(n + 2.220446049250313e-16) AS prec FROM c)
SELECT category_id, det_id, CAST(ctp AS BIGINT) AS ctp, round(max(prec) OVER (PARTITION BY category_id ORDER BY n DESC ROWS UNBOUNDED PRECEDING), 6) AS envelope FROM p""")
def _(v):
    from ..operators.coco_eval import envelope

    return envelope(v.matches.withColumn("weight", F.lit(1)), ["category_id"]).select("category_id", "det_id", F.col("ctp").cast("long").alias("ctp"), F.round("envelope", 6).alias("envelope"))


@query("w11_quantile_bins", "SELECT image_id, region_id, CAST(least(4, floor((row_number() OVER (PARTITION BY image_id ORDER BY u, region_id) - 1)*5/count(*) OVER (PARTITION BY image_id))) AS INT) AS bin FROM traits")
def _(v):
    return W.quantile_bins(v.traits, ["image_id"], "u", "region_id", 5).select("image_id", "region_id", "bin")


@query("w12_temporal_blocks", "SELECT sequence, frame_index, CAST(ntile(4) OVER (PARTITION BY sequence ORDER BY frame_index) AS INT) AS block FROM frames")
def _(v):
    return W.temporal_blocks(v.frames, 4).select("sequence", "frame_index", "block")


@query("w13_panel_labels", "SELECT method, seed, 'V' || lpad(CAST(row_number() OVER (PARTITION BY method ORDER BY seed) AS VARCHAR), 2, '0') AS label FROM runs")
def _(v):
    return W.panel_labels(v.runs, "method", ["seed"]).select("method", "seed", "label")


@query("t1_topk_per_image", "SELECT image_id, det_id, CAST(k AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, category_id, x1, y1, x2, y2, det_id) AS k FROM xy_dt) q WHERE k <= 10")
def _(v):
    return S.topk_per_image(v.xy_dt, 10).select("image_id", "det_id", "place")


GATE = "SELECT image_id, max(u) AS gate FROM traits GROUP BY image_id"


def gates(v):
    return v.traits.groupBy("image_id").agg(F.max("u").alias("gate"))


@query("t2_activate_fraction", f"WITH g AS ({GATE}) SELECT image_id, gate FROM (SELECT *, row_number() OVER (ORDER BY gate DESC, CAST(image_id AS VARCHAR)) AS k, count(*) OVER () AS n FROM g) q WHERE k <= greatest(1, round_even(n*0.3, 0))")
def _(v):
    return S.activate_fraction(gates(v), 0.3)


@query("t3_route_outputs", f"WITH g AS ({GATE}) SELECT d.image_id, d.det_id, d.score FROM dt_method d JOIN g ON d.image_id = g.image_id WHERE gate >= 0.95e0 UNION ALL SELECT d.image_id, d.det_id, d.score FROM dt d JOIN g ON d.image_id = g.image_id WHERE NOT gate >= 0.95e0")
def _(v):
    cols = ["image_id", "det_id", "score"]
    return S.route_outputs(S.activate_threshold(gates(v), 0.95), v.dt_method.select(*cols), v.dt.select(*cols))


@query("t4_select_regions")
def _(v):
    df = combined(v).withColumn("area_ratio", F.lit(1 / 16))
    out = S.select_regions(df, "difficulty", 0.25, 3)
    return out.select("image_id", F.array_join("selected", ",").alias("selected"), "used_area")


@query("t5_hash_sample", "SELECT doc_id FROM members ORDER BY {SHA:concat('42:', doc_id)}, doc_id LIMIT 100")
def _(v):
    return S.hash_sample(v.members, "doc_id", 100, 42).select("doc_id")


@query("t6_hash_order", "SELECT image_id, row_number() OVER (ORDER BY {SHA:concat('7:', image_id)}, image_id) - 1 AS position FROM images")
def _(v):
    return S.hash_order(v.images, "image_id", 7).select("image_id", F.col("position").cast("long").alias("position"))


@query("t6_compare_orders", """WITH a AS (SELECT image_id, row_number() OVER (ORDER BY {SHA:concat('7:', image_id)}, image_id) AS k FROM images), b AS (SELECT image_id, row_number() OVER (ORDER BY {SHA:concat('8:', image_id)}, image_id) AS k FROM images)
SELECT count(*) AS n, count(*) FILTER (a.image_id = b.image_id) AS positional_matches, count(*) FILTER (a.image_id <> b.image_id) AS displaced, true AS same_multiset, true AS distinct_keys FROM a JOIN b USING (k)""")
def _(v):
    a, b = (S.hash_order(v.images.select("image_id"), "image_id", seed) for seed in (7, 8))
    return S.compare_orders(a, b, "image_id")


@query("t7_every_nth", "SELECT sequence, frame_index FROM frames WHERE frame_index % 5 = 0")
def _(v):
    return S.every_nth(v.frames, 5).select("sequence", "frame_index")


@query("t8_evenly_spaced", "SELECT sequence, frame_index FROM frames WHERE frame_index IN (1, 4, 7, 10)")
def _(v):
    return S.evenly_spaced(v.frames, 1, 10, 4).select("sequence", "frame_index")


CAND = "SELECT image_id, region_id, CAST(det_id % 3 AS INT) AS round, max(q) AS q, avg(score) AS stability, min(score) AS unsupported FROM dt_local GROUP BY ALL"


def candidates(v):
    return v.dt_local.groupBy("image_id", "region_id", (F.col("det_id") % 3).cast("int").alias("round")).agg(F.max("q").alias("q"), F.avg("score").alias("stability"), F.min("score").alias("unsupported"))


@query("t9_choose_best", f"WITH c AS ({CAND}) SELECT image_id, region_id, round, q FROM (SELECT *, row_number() OVER (PARTITION BY image_id, region_id ORDER BY q DESC, round) AS k FROM c WHERE q > 0) z WHERE k = 1")
def _(v):
    return S.choose_best(candidates(v), ["image_id", "region_id"]).select("image_id", "region_id", "round", "q")


@query("t10_early_stop", f"WITH c AS ({CAND}), s AS (SELECT *, min(CASE WHEN q >= 0.2e0 AND stability >= 0.4e0 AND unsupported <= 0.6e0 THEN round END) OVER (PARTITION BY image_id, region_id) AS stop FROM c) SELECT image_id, region_id, round FROM s WHERE stop IS NULL OR round <= stop")
def _(v):
    return S.early_stop(candidates(v), ["image_id", "region_id"], 0.2, 0.4, 0.6).select("image_id", "region_id", "round")


@query("t11_route_operations", """WITH r AS (SELECT image_id, region_id, unnest([{'v': -d, 'c': 'd', 'op': 'gamma'}, {'v': -u, 'c': 'u', 'op': 'unsharp'}, {'v': -edge, 'c': 'edge', 'op': 'gamma'}]) AS x FROM traits),
k AS (SELECT image_id, region_id, x.op AS op, min({'v': x.v, 'at': CASE x.c WHEN 'd' THEN 0 WHEN 'u' THEN 1 ELSE 2 END}) AS first FROM r GROUP BY ALL)
SELECT image_id, region_id, string_agg(op, ',' ORDER BY first) AS operations FROM k GROUP BY ALL""")
def _(v):
    ops = S.route_operations({"d": "gamma", "u": "unsharp", "edge": "gamma"}, ["unsharp", "gamma"], 2)
    return v.traits.select("image_id", "region_id", F.array_join(ops, ",").alias("operations"))


@query("t12_pareto", "SELECT method, seed FROM runs a WHERE NOT EXISTS (SELECT 1 FROM runs b WHERE b.seed = a.seed AND b.ap >= a.ap AND b.latency_mean_ms <= a.latency_mean_ms AND b.eic_mean <= a.eic_mean AND (b.ap > a.ap OR b.latency_mean_ms < a.latency_mean_ms OR b.eic_mean < a.eic_mean))")
def _(v):
    return pareto(v.runs, ["seed"], ["ap"], ["latency_mean_ms", "eic_mean"], "method").select("method", "seed")


@query("t13_maximin_intervals", """WITH c AS (SELECT method || '/' || seed AS cell, round(1 - eic_mean, 3) AS retention, ap FROM runs), p AS (SELECT DISTINCT retention AS point FROM c),
b AS (SELECT point, cell AS choice, ap AS value FROM (SELECT point, cell, ap, row_number() OVER (PARTITION BY point ORDER BY ap DESC, retention DESC, cell) AS k FROM p JOIN c ON point <= retention) q WHERE k = 1),
i AS (SELECT *, CASE WHEN lag(choice) OVER (ORDER BY point) IS NOT DISTINCT FROM choice THEN 0 ELSE 1 END AS fresh FROM b), s AS (SELECT *, sum(fresh) OVER (ORDER BY point) AS island FROM i)
SELECT choice, value, min(point) AS from_point, max(point) AS to_point, count(*) AS n_points FROM s GROUP BY island, choice, value""")
def _(v):
    cells = v.runs.select(F.concat_ws("/", "method", F.col("seed").cast("string")).alias("cell"), F.round(1 - F.col("eic_mean"), 3).alias("retention"), "ap")
    return S.maximin_intervals(cells, "cell", "retention", "ap")
