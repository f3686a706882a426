"""Registered queries: geometry and key expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import hashing as H
from ..functions.categories import attribute_flags, remap_audit, remap_category
from ..registry import query

W, H_ = 1920, 1080


def rounded(*pairs):
    return [F.round(c, 6).alias(n) for n, c in pairs]


def sides(b: G.Box, prefix: str = ""):
    return rounded(*((f"{prefix}{n}", c) for n, c in zip(("x1", "y1", "x2", "y2"), b, strict=True)))


@query("g1_box_conversion", "SELECT ann_id, x AS x1, y AS y1, x + w AS x2, y + h AS y2, w AS back_w, h AS back_h FROM gt")
def _(v):
    b = G.xywh_to_xyxy(*(F.col(c) for c in "xywh"))
    _, _, w, h = G.xyxy_to_xywh(b)
    return v.gt.select("ann_id", *b.named(), w.alias("back_w"), h.alias("back_h"))


@query("g2_iou", "SELECT ann_id, det_id, round(iou, 6) AS iou FROM pairs")
def _(v):
    from ..operators.joins import iou_join

    return iou_join(v.xy_gt, v.xy_dt, 0.0, "ann_id", "det_id").select(F.col("left_id").alias("ann_id"), F.col("right_id").alias("det_id"), F.round("iou", 6).alias("iou"))


@query("g3_center", "SELECT det_id, (x1 + x2)/2 AS cx, (y1 + y2)/2 AS cy FROM xy_dt")
def _(v):
    cx, cy = G.Box.of().center
    return v.xy_dt.select("det_id", cx.alias("cx"), cy.alias("cy"))


@query("g4_size_bucket", "SELECT CASE WHEN w*h < 1024 THEN 'small' WHEN w*h < 9216 THEN 'medium' ELSE 'large' END AS size, count(*) AS n FROM gt GROUP BY 1")
def _(v):
    return v.gt.groupBy(G.size_bucket(F.col("w"), F.col("h")).alias("size")).agg(F.count("*").alias("n"))


CLIP = "least(greatest(x1, 0e0), 1920e0) AS x1, least(greatest(y1, 0e0), 1080e0) AS y1, least(greatest(x2, 0e0), 1920e0) AS x2, least(greatest(y2, 0e0), 1080e0) AS y2"


@query("g5_clip", f"SELECT det_id, {CLIP} FROM xy_dt")
def _(v):
    return v.xy_dt.select("det_id", *G.clip(G.Box.of(), W, H_).named())


@query("g6_clip_fused", f"""WITH f AS (SELECT det_id, x1 + 3.5e0 AS x1, y1 + 3.5e0 AS y1, x2, y2 FROM xy_dt), c AS (
  SELECT f.det_id, c.x1, c.y1, c.x2, c.y2, greatest(abs(f.x1-c.x1), abs(f.y1-c.y1), abs(f.x2-c.x2), abs(f.y2-c.y2)) AS correction FROM f JOIN (SELECT det_id, {CLIP} FROM f) c USING (det_id))
SELECT det_id, x1, y1, x2, y2, correction FROM c WHERE correction <= 1 AND x2 - x1 >= 1 AND y2 - y1 >= 1""")
def _(v):
    moved = v.xy_dt.select("det_id", *G.Box(F.col("x1") + 3.5, F.col("y1") + 3.5, F.col("x2"), F.col("y2")).named())
    c = G.clip(G.Box.of(), W, H_)
    out = moved.select("det_id", *c.named("c_"), G.largest_shift(G.Box.of(), c).alias("correction"))
    b = G.Box.of("c_")
    return out.where((F.col("correction") <= G.FIX_LIMIT) & (b.width >= G.LEAST_SIDE) & (b.height >= G.LEAST_SIDE)).select("det_id", *b.named(), "correction")


LB = "WITH s AS (SELECT p_partkey, CAST(100 + (p_partkey * 37) % 1900 AS DOUBLE) AS w, CAST(100 + (p_partkey * 53) % 1000 AS DOUBLE) AS h FROM part), l AS (SELECT *, least(640e0/w, 640e0/h) AS scale FROM s), p AS (SELECT *, CAST(greatest(1, round_even(w*scale, 0)) AS INT) AS nw, CAST(greatest(1, round_even(h*scale, 0)) AS INT) AS nh FROM l)"


def sized(v):
    return v.part.select("p_partkey", (100 + (F.col("p_partkey") * 37) % 1900).cast("double").alias("w"), (100 + (F.col("p_partkey") * 53) % 1000).cast("double").alias("h"))


@query("g7_letterbox", f"{LB} SELECT p_partkey, round(scale, 6) AS scale, nw AS new_w, nh AS new_h, CAST(floor((640-nw)/2) AS INT) AS pad_x, CAST(floor((640-nh)/2) AS INT) AS pad_y FROM p")
def _(v):
    p = G.letterbox(F.col("w"), F.col("h"), 640, 640)
    return sized(v).select("p_partkey", F.round(p.scale, 6).alias("scale"), p.new_w.alias("new_w"), p.new_h.alias("new_h"), p.pad_x.alias("pad_x"), p.pad_y.alias("pad_y"))


@query("g8_letterbox_round_trip", "SELECT det_id, round(x1/3e0, 6) AS x1, round(y1/3e0 + 140, 6) AS y1, round(x2/3e0, 6) AS x2, round(y2/3e0 + 140, 6) AS y2, true AS restored FROM xy_dt")
def _(v):
    p = G.letterbox(F.lit(1920.0), F.lit(1080.0), 640, 640)
    b = G.to_letterbox(G.Box.of(), p)
    back = G.from_letterbox(b, p)
    return v.xy_dt.select("det_id", *sides(b), (G.largest_shift(G.Box.of(), back) < 1e-6).alias("restored"))


@query("g9_crop_maps", """SELECT d.det_id, round((x1*0.5e0) + rx1, 6) AS x1, round((y1*0.5e0) + ry1, 6) AS y1, round((x2*0.5e0) + rx1, 6) AS x2, round((y2*0.5e0) + ry1, 6) AS y2
FROM xy_local d JOIN regions r ON d.image_id = r.image_id AND d.region_id = r.region_id""")
def _(v):
    d = v.xy_local.join(v.regions, ["image_id", "region_id"])
    local = G.Box(*(c * 0.5 for c in G.Box.of()))
    return d.select("det_id", *sides(G.shift(local, F.col("rx1"), F.col("ry1"))))


@query("g10_map_local_box", """WITH c AS (SELECT d.det_id, d.x1, d.y1, d.x2, d.y2, r.region_id, r.rx1, r.ry1, r.rx2, r.ry2,
  greatest(0e0, least(d.x2, r.rx2 + 48) - greatest(d.x1, r.rx1 - 48)) * greatest(0e0, least(d.y2, r.ry2 + 27) - greatest(d.y1, r.ry1 - 27)) / ((d.x2-d.x1)*(d.y2-d.y1)) AS share
  FROM (SELECT det_id, image_id, least(greatest(x1, 0e0), 1920e0) AS x1, least(greatest(y1, 0e0), 1080e0) AS y1, least(greatest(x2, 0e0), 1920e0) AS x2, least(greatest(y2, 0e0), 1080e0) AS y2, region_id FROM xy_local) d
  JOIN regions r ON d.image_id = r.image_id AND d.region_id = r.region_id)
SELECT det_id, region_id, round(share, 6) AS share FROM c WHERE x2-x1 >= 1 AND y2-y1 >= 1 AND (x1+x2)/2 >= rx1 AND (x1+x2)/2 < rx2 AND (y1+y2)/2 >= ry1 AND (y1+y2)/2 < ry2 AND share >= 0.8e0""")
def _(v):
    d = v.xy_local.join(v.regions, ["image_id", "region_id"]).withColumns(dict(zip(("x1", "y1", "x2", "y2"), G.clip(G.Box.of(), W, H_), strict=True)))
    b, core = G.Box.of(), G.Box.of("r")
    crop = G.Box(core.x1 - 48, core.y1 - 27, core.x2 + 48, core.y2 + 27)
    share = G.inside_share(b, crop)
    ok = (b.width >= G.LEAST_SIDE) & (b.height >= G.LEAST_SIDE) & G.center_in(b, core) & (share >= G.CORE_SHARE)
    return d.where(ok).select("det_id", "region_id", F.round(share, 6).alias("share"))


@query("g11_restore_flip", "SELECT det_id, 1920 - x2 AS x1, y1, 1920 - x1 AS x2, y2 FROM xy_flip")
def _(v):
    return v.xy_flip.select("det_id", *G.restore_flip(G.Box.of(), W).named())


SLOT = """WITH r AS (SELECT *, region_id % 4 AS slot FROM regions WHERE region_id < 4), s AS (SELECT *, (slot % 2)*320 AS left_, CAST(floor(slot/2) AS INT)*320 + 70 AS top_ FROM r)"""


@query("g12_packed_slots", f"{SLOT} SELECT image_id, region_id, CAST(left_ AS DOUBLE) AS x1, CAST(top_ AS DOUBLE) AS y1, CAST(left_ + 320 AS DOUBLE) AS x2, CAST(top_ + 180 AS DOUBLE) AS y2, round(320/480e0, 6) AS scale_x, round(180/270e0, 6) AS scale_y FROM s")
def _(v):
    r = v.regions.where("region_id < 4")
    s = G.packed_slot(F.col("region_id") % 4, G.Box.of("r"), 320, 320)
    return r.select("image_id", "region_id", *s.content.named(), F.round(s.scale_x, 6).alias("scale_x"), F.round(s.scale_y, 6).alias("scale_y"))


@query("g13_restore_packed", f"""{SLOT}, d AS (SELECT det_id, image_id, x1/3 AS x1, y1/1.6875e0 AS y1, x2/3 AS x2, y2/1.6875e0 AS y2 FROM xy_dt), m AS (
  SELECT d.*, s.region_id, s.left_, s.top_, s.rx1, s.ry1, greatest(0e0, least(d.x2, left_+320)-greatest(d.x1, left_))*greatest(0e0, least(d.y2, top_+180)-greatest(d.y1, top_))/((d.x2-d.x1)*(d.y2-d.y1)) AS share
  FROM d JOIN s ON d.image_id = s.image_id AND (x1+x2)/2 >= left_ AND (x1+x2)/2 < left_+320 AND (y1+y2)/2 >= top_ AND (y1+y2)/2 < top_+180)
SELECT det_id, region_id, round((x1-left_)*1.5e0+rx1, 4) AS x1, round((y1-top_)*1.5e0+ry1, 4) AS y1, round((x2-left_)*1.5e0+rx1, 4) AS x2, round((y2-top_)*1.5e0+ry1, 4) AS y2 FROM m WHERE share >= 0.8e0""")
def _(v):
    r = v.regions.where("region_id < 4")
    slot = G.packed_slot(F.col("region_id") % 4, G.Box.of("r"), 320, 320)
    slots = r.select(F.col("image_id").alias("s_image"), "region_id", *G.Box.of("r").named("r"), *slot.content.named("s_"), slot.scale_x.alias("sx"), slot.scale_y.alias("sy"))
    d = v.xy_dt.select("det_id", "image_id", (F.col("x1") / 3).alias("x1"), (F.col("y1") / 1.6875).alias("y1"), (F.col("x2") / 3).alias("x2"), (F.col("y2") / 1.6875).alias("y2"))
    content = G.Box.of("s_")
    m = d.join(slots, (F.col("image_id") == F.col("s_image")) & G.center_in(G.Box.of(), content)).where(G.inside_share(G.Box.of(), content) >= G.CORE_SHARE)
    back = G.from_slot(G.Box.of(), G.Slot(F.lit(0), content, F.col("sx"), F.col("sy")), G.Box.of("r"))
    return m.select("det_id", "region_id", *[F.round(c, 4).alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), back, strict=True)])


@query("g14_rotated_enclosure", """WITH r AS (SELECT *, CAST(det_id % 90 AS DOUBLE) AS deg, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy FROM xy_dt),
e AS (SELECT det_id, cx, cy, ((x2-x1)*abs(cos(radians(deg))) + (y2-y1)*abs(sin(radians(deg))))/2 AS hw, ((x2-x1)*abs(sin(radians(deg))) + (y2-y1)*abs(cos(radians(deg))))/2 AS hh FROM r)
SELECT det_id, round(least(greatest(cx-hw,0e0),1920e0), 4) AS x1, round(least(greatest(cy-hh,0e0),1080e0), 4) AS y1, round(least(greatest(cx+hw,0e0),1920e0), 4) AS x2, round(least(greatest(cy+hh,0e0),1080e0), 4) AS y2 FROM e""")
def _(v):
    b = G.rotated_enclosure(G.Box.of(), (F.col("det_id") % 90).cast("double"), W, H_)
    return v.xy_dt.select("det_id", *[F.round(c, 4).alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), b, strict=True)])


@query("g15_polygon_enclosure", "SELECT ann_id, least(greatest(x1-100,0e0),1720e0) AS x1, least(greatest(y1-100,0e0),880e0) AS y1, least(greatest(x2-100,0e0),1720e0) AS x2, least(greatest(y2-100,0e0),880e0) AS y2, x1 < 100 OR y1 < 100 OR x2 > 1820 OR y2 > 980 AS clipped FROM xy_gt WHERE x2 > 100 AND y2 > 100 AND x1 < 1820 AND y1 < 980")
def _(v):
    xs, ys = F.array("x1", "x2", "x2", "x1"), F.array("y1", "y1", "y2", "y2")
    b, clipped = G.polygon_enclosure(xs, ys, 100, F.lit(1720), F.lit(880))
    return v.xy_gt.select("ann_id", *b.named(), clipped.alias("clipped")).where("x1 is not null")


@query("g16_normalized", f"WITH c AS (SELECT det_id, {CLIP} FROM xy_dt) SELECT det_id, round((x1+x2)/2/1920, 8) AS cx, round((y1+y2)/2/1080, 8) AS cy, round((x2-x1)/1920, 8) AS nw, round((y2-y1)/1080, 8) AS nh FROM c WHERE x2 > x1 AND y2 > y1")
def _(v):
    cx, cy, w, h = G.normalized(G.Box.of(), W, H_)
    return v.xy_dt.select("det_id", F.round(cx, 8).alias("cx"), F.round(cy, 8).alias("cy"), F.round(w, 8).alias("nw"), F.round(h, 8).alias("nh")).where("nw > 0 and nh > 0")


@query("g17_source_key", "SELECT p_partkey, 'img_' || p_partkey AS source_key FROM part")
def _(v):
    name = F.concat(F.lit("val/IMG_"), F.col("p_partkey").cast("string"), F.lit("_jpg.rf."), F.lower(F.hex(F.col("p_partkey"))), F.lit(".jpg"))
    return v.part.select("p_partkey", H.source_key(name).alias("source_key"))


@query("g18_stable_hash", "SELECT image_id, {H:concat('42|', image_id, '|fog|1')} AS h FROM images")
def _(v):
    return v.images.select("image_id", H.stable_hash(F.concat_ws("|", F.lit("42"), F.col("image_id").cast("string"), F.lit("fog"), F.lit("1"))).alias("h"))


def _row_sql(*columns):
    return " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns)


PARTS = ", ".join(f"CAST(sum(CAST(CAST('0x' || substr(h, {15 * i + 1}, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS s{i}" for i in range(4))


@query("g19_table_fingerprint", f"WITH r AS (SELECT sha256({_row_sql('image_id', 'cluster_id', 'source_key')}) AS h FROM images), s AS (SELECT count(*) AS n_rows, {PARTS} FROM r) SELECT n_rows, sha256(concat_ws('|', n_rows, s0, s1, s2, s3)) AS fingerprint FROM s")
def _(v):
    return H.fingerprint(v.images, ["image_id", "cluster_id", "source_key"])


@query("g20_inference_cost", "SELECT image_id, round(count(*) + sum((rx2-rx1)*(ry2-ry1))/2073600e0, 6) AS cost FROM regions WHERE region_id < 5 GROUP BY image_id")
def _(v):
    area = (F.col("rx2") - F.col("rx1")) * (F.col("ry2") - F.col("ry1"))
    return v.regions.where("region_id < 5").groupBy("image_id").agg(F.round(G.inference_cost(F.sum(area), F.lit(1920.0 * 1080.0), F.count("*")), 6).alias("cost"))


@query("g21_remap_category", "SELECT CASE category_id WHEN 1 THEN 10 WHEN 2 THEN 20 ELSE 30 END AS category_id, count(*) AS n_after, min(category_id) AS was FROM dt GROUP BY 1")
def _(v):
    after = remap_category(v.dt.withColumn("was", F.col("category_id")), {1: 10, 2: 20, 3: 30})
    return after.groupBy("category_id").agg(F.count("*").alias("n_after"), F.min("was").alias("was"))


@query("g21_remap_audit", "SELECT CAST(category_id AS INT) AS source, CAST(category_id*10 AS INT) AS target, count(*) AS n_before, count(*) AS n_after, true AS others_unchanged, true AS same_count FROM dt GROUP BY category_id")
def _(v):
    mapping = {1: 10, 2: 20, 3: 30}
    return remap_audit(v.dt, remap_category(v.dt, mapping), mapping)


FLAGS = "SELECT image_id, image_id % 2 = 1 AS night, CAST(floor(image_id/2) AS BIGINT) % 2 = 1 AS fog, CAST(floor(image_id/4) AS BIGINT) % 2 = 1 AS rain FROM images"


@query("g22_attribute_flags", f"SELECT *, CAST(night AS INT) + CAST(fog AS INT) + CAST(rain AS INT) = 1 AS exactly_one, fog OR rain AS wet FROM ({FLAGS}) q")
def _(v):
    bits = F.transform(F.array(F.lit(1), F.lit(2), F.lit(4)), lambda p: F.floor(F.col("image_id") / p) % 2)
    names = ["night", "fog", "rain"]
    return v.images.select("image_id", bits.alias("bits")).select("image_id", *attribute_flags(F.col("bits"), names, {"exactly_one": names}, {"wet": ["fog", "rain"]}))
