"""Tasks do not grow with the input."""

from pyspark.sql import functions as F

from gridlark.operators import windows
from gridlark.sources import shared

WEIGHTS = {"entropy": 0.4, "proximity": 0.3, "class_conflict": 0.2, "density": 0.1}


def test_uncertainty_makes_more_tasks_of_more_regions(spark, monkeypatch):
    regions = spark.range(400).select((F.col("id") / 4).cast("long").alias("image_id"), (F.col("id") % 4).cast("int").alias("region_id"), F.lit(0).alias("rx1"), F.lit(0).alias("ry1"), F.lit(480).alias("rx2"), F.lit(270).alias("ry2"))
    boxes = regions.select(
        "image_id", "region_id", F.monotonically_increasing_id().alias("det_id"), (F.col("region_id") % 3).cast("int").alias("category_id"), ((F.col("image_id") * 7 + F.col("region_id")) % 11 / 11).alias("score"),
        F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1"), F.lit(9.0).alias("x2"), F.lit(9.0).alias("y2"),
    )
    ask = lambda: windows.score_uncertainty(boxes, regions, WEIGHTS)
    few = ask()
    monkeypatch.setattr(shared, "TASK_ROWS", 40)
    many = ask()
    assert many.rdd.getNumPartitions() == 10 > few.rdd.getNumPartitions()
    got = lambda df: sorted((x.image_id, x.region_id, round(x.uncertainty, 9)) for x in df.collect())
    assert got(many) == got(few) and len(got(few)) == 400


def test_cross_view_pairs_are_made_once(spark):
    from gridlark.plans import queries_eval  # noqa: F401
    from gridlark.registry import QUERIES

    df = QUERIES["a3_cross_view_features"](spark, "/root/testdata/sf0.001")
    plain = df.queryExecution if hasattr(df, "queryExecution") else df._jdf.queryExecution()
    assert "l_orderkey" not in plain.toString()


def test_outcomes_stay_bits(spark):
    """Sixty ways at once: a detection is one row in what is written, and the figures are those of one row a way."""
    from gridlark.fixtures import Views
    from gridlark.operators import coco_eval as E

    v = Views(spark, "/root/testdata/sf0.001")
    few = v.xy_gt.where("image_id < 40"), v.xy_dt.where("image_id < 40")
    packed = shared.written(E.match_packed(*few), "packed")
    n = len(E.THRESHOLDS)
    ways = [(a, i * n + k, most) for i, a in enumerate(E.AREAS) for k in range(n) for most in ((None, 1) if a == "all" else (None,))]
    ways += [("all", k, 3) for k in range(n)]
    got = {(x.category_id, *ways[x.way]): (round(x.ap, 9), round(x.recall, 9)) for x in E.evaluated_packed(few[0], packed, ways).collect()}
    rows = shared.written(E.match_coco(*few), "rows")
    for most in (None, 1, 3):
        some = rows if most is None else rows.where((F.col("place") <= most) & (F.col("area") == "all"))
        areas = tuple(E.AREAS) if most is None else ("all",)
        for x in E.evaluated(few[0], some, [], areas).collect():
            bit = list(E.AREAS).index(x.area) * n + E.THRESHOLDS.index(x.threshold)
            assert got[x.category_id, x.area, bit, most] == (round(x.ap, 9), round(x.recall, 9))


def test_cross_view_pairs_are_dealt_once(spark):
    """Six kernels over the pairs used to shuffle all their columns, one a level of overlap or score; the matches are those of each alone."""
    from gridlark.operators import matching
    from gridlark.plans import queries_eval  # noqa: F401
    from gridlark.registry import QUERIES

    df = QUERIES["a3_cross_view_features"](spark, "/root/testdata/sf0.001")
    plain = df.queryExecution if hasattr(df, "queryExecution") else df._jdf.queryExecution()
    assert plain.analyzed().toString().count("MapInArrow") == 1
    pairs = spark.range(4000).selectExpr("id % 50 AS image_id", "(id * 7) % 13 AS left_id", "(id * 11) % 17 AS right_id", "cast((id * 37) % 101 AS double) / 101 AS iou", "cast((id * 53) % 97 AS double) / 97 AS l_score").dropDuplicates(["image_id", "left_id", "right_id"])
    among = [F.col("iou") >= 0.3, (F.col("iou") >= 0.5) & (F.col("l_score") >= 0.4), F.col("l_score") < 0]
    got = matching.greedy_matches(pairs, among).collect()
    key = lambda x: (x.image_id, x.left_id, x.right_id)
    for k, c in enumerate(among):
        want = {key(x) for x in matching.greedy_match(pairs.where(c)).collect()}
        assert {key(x) for x in got if x.taken >> k & 1} == want and bool(want) == (k < 2)
    assert {key(x) for x in got if x.iou >= 0.6 and x.taken & 1} == {key(x) for x in matching.greedy_match(pairs.where("iou >= 0.6")).collect()}


def test_gates_are_made_once(spark, monkeypatch):
    """The gate, a kernel over all boxes of regions, was made again for the count and for each table that is cut to the gated images."""
    from gridlark.plans import pipelines, queries_eval  # noqa: F401
    from gridlark.registry import QUERIES

    got = []
    for whole in (0, 1 << 20):
        monkeypatch.setattr(pipelines, "WHOLE_IDS", whole, raising=False)  # boxes are cut by a shuffle, and where they lie
        df = QUERIES["c5_guarded_fusion"](spark, "/root/testdata/sf0.001")
        plain = df.queryExecution if hasattr(df, "queryExecution") else df._jdf.queryExecution()
        assert plain.analyzed().toString().count("MapInArrow") == 1
        got.append(sorted(map(tuple, df.collect())))
    assert got[0] == got[1] and got[0]


def test_regions_are_not_derived_for_each_attempt(spark, monkeypatch):
    """Components of all regions, derived from orders, were joined to the chosen regions in three places of one table."""
    from gridlark.plans import pipelines, queries_eval  # noqa: F401
    from gridlark.registry import QUERIES

    plans, write = {}, pipelines.written

    def seen(df, name):
        plain = df.queryExecution if hasattr(df, "queryExecution") else df._jdf.queryExecution()
        plans[name] = plain.analyzed().toString()
        return write(df, name)

    monkeypatch.setattr(pipelines, "written", seen)
    QUERIES["c3_selective_regions"](spark, "/root/testdata/sf0.001")
    assert not any("o_orderkey" in plans[x] for x in ("attempt-pairs", "attempts", "untouched-crops", "mended-crops"))
