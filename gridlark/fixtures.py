"""Detection tables derived from the star-schema tables: one SQL text for Spark and for the oracle.

``{H:expr}`` is a stable 60-bit hash of a string and ``{SHA:expr}`` its SHA-256 in hex, written as each engine has them.
"""

from __future__ import annotations

import re
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession

from .sources.shared import written

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    "base": """SELECT l.*, o.o_custkey AS image_id,
  CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) AS INT) AS rn
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "boxes": """SELECT l_orderkey*100 + rn AS box_id, image_id, CAST(l_partkey % 3 + 1 AS INT) AS category_id, rn, l_orderkey, l_suppkey,
  CAST((l_partkey*37) % 1700 AS DOUBLE) AS x, CAST((l_suppkey*53 + rn*97) % 900 AS DOUBLE) AS y,
  CAST(10 + (l_partkey*7) % 150 AS DOUBLE) AS w, CAST(10 + (l_partkey*11) % 130 AS DOUBLE) AS h,
  CAST((l_orderkey*7919 + rn*104729) % 1000003 AS DOUBLE)/1000003e0 AS score FROM base""",
    "images": "SELECT c_custkey AS image_id, 1920 AS width, 1080 AS height, c_nationkey AS cluster_id, c_mktsegment AS source_key FROM customer",
    "gt": "SELECT box_id AS ann_id, image_id, category_id, x, y, w, h FROM boxes WHERE rn <= 3",
    "dt": "SELECT box_id AS det_id, image_id, category_id, x + (l_orderkey % 9) - 4 AS x, y + (l_orderkey % 7) - 3 AS y, w, h, score FROM boxes WHERE l_orderkey % 10 < 9",
    "dt_method": """SELECT box_id AS det_id, image_id, category_id,
  CASE WHEN l_suppkey % 2 = 0 THEN x ELSE x + (l_orderkey % 9) - 4 END AS x,
  CASE WHEN l_suppkey % 2 = 0 THEN y ELSE y + (l_orderkey % 7) - 3 END AS y, w, h,
  CASE WHEN rn <= 3 THEN least(1e0, score + 0.05e0) ELSE score END AS score FROM boxes WHERE l_orderkey % 10 < 9""",
    "dt_flip": "SELECT det_id, image_id, category_id, 1920 - x - w AS x, y, w, h, score*0.9e0 AS score FROM dt",
    "dt_local": """SELECT d.*, CAST(least(3, floor((d.x+d.w/2)/480)) + 4*least(3, floor((d.y+d.h/2)/270)) AS INT) AS region_id,
  CAST((det_id % 21) - 10 AS DOUBLE)/20e0 AS q FROM dt d""",
    "gt_k": "SELECT ann_id, image_id, category_id, x, y, w, h, CAST(floor(ann_id/100) AS BIGINT) % 50 AS k FROM gt",
    "gt_dirty": """SELECT ann_id, CASE WHEN k = 1 THEN image_id + 100000000 ELSE image_id END AS image_id,
  CASE WHEN k = 2 THEN 9 ELSE category_id END AS category_id, CASE WHEN k = 3 THEN -x - 1 ELSE x END AS x,
  CASE WHEN k = 4 THEN y + 1000 ELSE y END AS y, CASE WHEN k = 5 THEN 0e0 ELSE w END AS w, h FROM gt_k
  UNION ALL SELECT ann_id + 1000000000 AS ann_id, image_id, category_id, x, y, w, h FROM gt_k WHERE k = 6""",
    "timings": "SELECT event_id, user_id AS image_id, CAST(user_id % 4 AS INT) AS model_id, CAST(floor(event_id/100) AS INT) % 6 AS cycle, CAST(floor(event_id/20) AS BIGINT) AS chunk, 1e0 + value AS total_ms FROM events",
    "frames": "SELECT user_id AS sequence, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS frame_index, event_id FROM events",
    "runs": """SELECT o_orderpriority AS method, CAST(o_custkey % 7 AS INT) AS seed, round(avg(o_totalprice)/500000e0, 9) AS ap,
  CAST(count(*) AS DOUBLE)/100e0 AS latency_mean_ms, CAST(max(o_orderkey % 97) AS DOUBLE)/97e0 AS eic_mean
  FROM orders GROUP BY o_orderpriority, o_custkey % 7""",
    "members": "SELECT doc_id, {SHA:text} AS sha, CAST(floor(doc_id/4) AS BIGINT) AS source_key FROM documents",
    "xy_gt": "SELECT ann_id, image_id, category_id, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM gt",
    "xy_dt": "SELECT det_id, image_id, category_id, score, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM dt",
    "xy_flip": "SELECT det_id, image_id, category_id, score, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM dt_flip",
    "xy_method": "SELECT det_id, image_id, category_id, score, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM dt_method",
    "xy_local": "SELECT det_id, image_id, category_id, score, region_id, q, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM dt_local",
    "pairs": """SELECT a.ann_id, b.det_id, a.image_id, a.category_id, b.score,
  greatest(0e0, least(a.x2,b.x2)-greatest(a.x1,b.x1))*greatest(0e0, least(a.y2,b.y2)-greatest(a.y1,b.y1))
  / ((a.x2-a.x1)*(a.y2-a.y1)+(b.x2-b.x1)*(b.y2-b.y1)-greatest(0e0, least(a.x2,b.x2)-greatest(a.x1,b.x1))*greatest(0e0, least(a.y2,b.y2)-greatest(a.y1,b.y1))) AS iou
  FROM xy_gt a JOIN xy_dt b ON a.image_id = b.image_id AND a.category_id = b.category_id AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2""",
    # mutual best pairs: a match table that SQL can compute
    "best": """SELECT ann_id, det_id, image_id, category_id, score, iou FROM (SELECT *,
  row_number() OVER (PARTITION BY ann_id ORDER BY iou DESC, det_id) AS ra, row_number() OVER (PARTITION BY det_id ORDER BY iou DESC, ann_id) AS rb FROM pairs WHERE iou >= 0.5e0) t WHERE ra = 1 AND rb = 1""",
    "matches": """SELECT d.det_id, d.image_id, d.category_id, d.score, CASE WHEN b.det_id IS NULL THEN 0 ELSE 1 END AS tp FROM dt d LEFT JOIN best b ON d.det_id = b.det_id""",
    "regions": """SELECT image_id, CAST(r.n AS INT) AS region_id, 480 * (r.n % 4) AS rx1, 270 * CAST(floor(r.n/4) AS INT) AS ry1, 480 * (r.n % 4) + 480 AS rx2, 270 * CAST(floor(r.n/4) AS INT) + 270 AS ry2
  FROM images CROSS JOIN (SELECT DISTINCT CAST(o_orderkey % 16 AS INT) AS n FROM orders) r""",
    "traits": "SELECT image_id, region_id, CAST({H:concat(image_id, '|', region_id, '|d')} % 101 AS DOUBLE)/100e0 AS d, CAST({H:concat(image_id, '|', region_id, '|u')} % 101 AS DOUBLE)/100e0 AS u, CAST({H:concat(image_id, '|', region_id, '|e')} % 1001 AS DOUBLE)/1000e0 AS edge FROM regions",
    "deltas": "SELECT method, seed, CAST(r.n AS INT) AS resample, (CAST({H:concat(method, '|', seed, '|', r.n)} % 2001 AS DOUBLE) - 700e0)/10000e0 AS delta FROM runs CROSS JOIN (SELECT DISTINCT o_orderkey % 200 AS n FROM orders) r",
}

_MACRO = re.compile(r"\{(H|SHA):((?:[^{}])*)\}")


def _render(sql: str, spark: bool) -> str:
    def put(m: re.Match) -> str:
        e = m[2]
        if m[1] == "SHA":
            return f"sha2({e}, 256)" if spark else f"sha256({e})"
        return f"CAST(conv(substr(sha2({e}, 256), 1, 15), 16, 10) AS BIGINT)" if spark else f"CAST('0x' || substr(sha256({e}), 1, 15) AS BIGINT)"

    return _MACRO.sub(put, sql)


def _needed(sql: str, given: Collection[str] = ()) -> list[str]:
    """Views that a text uses, directly or through others, in order of definition; not those that are ``given``, nor what only they use."""
    seen: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for v in VIEWS:
            if v not in seen and v not in given and re.search(rf"\b{v}\b", text):
                seen.add(v)
                todo.append(VIEWS[v])
    return [v for v in VIEWS if v in seen]


def with_views(sql: str, spark: bool = False, given: Collection[str] = ()) -> str:
    ctes = ",\n".join(f"{v} AS ({_render(VIEWS[v], spark)})" for v in _needed(sql, given))
    sql = _render(sql.strip(), spark)
    if not ctes:
        return sql
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", sql):
        return f"WITH {m[1] or ''}{ctes},\n{sql[m.end() :]}"
    return f"WITH {ctes}\n{sql}"


class Views:
    """``v.gt``, ``v.lineitem``, ... as DataFrames over one table folder; views that are ``given`` are read, not derived."""

    def __init__(self, spark: SparkSession, sf_dir: str, given: dict[str, DataFrame] | None = None):
        self.spark, self.sf_dir, self.given = spark, sf_dir, given or {}

    def once(self, name: str) -> Views:
        """The same views over a view that is derived and written once."""
        return Views(self.spark, self.sf_dir, self.given | {name: written(getattr(self, name), name)})

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, text: str) -> DataFrame:
        full = with_views(text, spark=True, given=self.given)
        for name, df in self.given.items():
            df.createOrReplaceTempView(name)
        for t in TABLES:
            if re.search(rf"\b{t}\b", full):
                getattr(self, t).createOrReplaceTempView(t)
        return self.spark.sql(full)
