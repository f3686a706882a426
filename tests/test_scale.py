"""Operators that never hold a whole group in one task, against plain versions of their rules."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.operators import select, skyline, windows
from gridlark.operators.quantiles import exact_quantiles


def dominated(a, rows):
    return any(b[0] == a[0] and all(x <= y for x, y in zip(b[1:], a[1:])) and b[1:] != a[1:] for b in rows)


@pytest.mark.parametrize("groups, span", [(1, 8), (3, 40), (60, 6)])
def test_skyline_is_what_nothing_dominates(groups, span):
    r = np.random.default_rng(groups)
    rows = np.column_stack([r.integers(0, groups, 400), r.integers(0, span, (400, 3))])
    keep = skyline.undominated(rows[:, 0], rows[:, 1:].astype(float))
    listed = [tuple(x) for x in rows.tolist()]
    assert keep.tolist() == [not dominated(x, listed) for x in listed]
    lost = rows[:, 1:].astype(float)
    lost[::7, 1] = np.nan
    keep = skyline.undominated(rows[:, 0], lost)
    sure = [x for k, x in enumerate(listed) if k % 7]
    assert keep.tolist() == [k % 7 == 0 or not dominated(x, sure) for k, x in enumerate(listed)]


def test_pareto_of_groups_and_names(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["a", "b", None]), r.randrange(9) / 4, r.randrange(9), r.choice([None, *range(9)])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, team string, gain double, cost int, wait int").repartition(5)
    cost = lambda x: (x[1], -x[2], x[3], x[4])
    known = [cost(x) for x in rows if x[4] is not None]
    want = {x[0] for x in rows if x[4] is None or not dominated(cost(x), known)}
    out = skyline.pareto(df, ["team"], ["gain"], ["cost", "wait"], "id")
    assert out.columns == df.columns and {x.id for x in out.collect()} == want
    plain = out.queryExecution if hasattr(out, "queryExecution") else out._jdf.queryExecution()
    assert "Join" not in plain.toString()
    assert skyline.pareto(df.limit(0), [], ["gain"], ["cost"], "id").count() == 0


def test_a_million_points_in_seconds(spark):
    df = spark.range(1_000_000, numPartitions=8).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c"))
    began = time.time()
    n = skyline.pareto(df, [], ["a"], ["b", "c"], "id").count()
    assert 20 < n < 1000 and time.time() - began < 120  # the slowest machine of all


@pytest.mark.parametrize("seed", range(3))
def test_intervals_of_choices(spark, seed):
    r = random.Random(seed)
    cells = [(f"c{i:03}", r.randrange(40) / 40, r.randrange(12) / 12) for i in range(150)] + [("none", None, 2.0), ("unknown", 0.99, None)]
    points = sorted({x[1] for x in cells if x[1] is not None})
    choice = []
    for p in points:
        best = min((x for x in cells if x[1] is not None and x[1] >= p), key=lambda x: (x[2] is None, -(x[2] or 0), -x[1], x[0]))
        choice.append((best[0], best[2]))
    want, at = [], 0
    for k, g in itertools.groupby(choice):
        n = len(list(g))
        want.append((*k, points[at], points[at + n - 1], n))
        at += n
    got = select.maximin_intervals(spark.createDataFrame(cells, "cell string, keep double, worst double").repartition(4), "cell", "keep", "worst")
    assert sorted(map(tuple, got.collect()), key=lambda x: x[2]) == want and len(want) >= 3


@pytest.mark.parametrize("small, accuracy", [(20_000, 2000), (10, 16)])
def test_exact_quantiles(spark, small, accuracy):
    r = np.random.default_rng(5)
    groups = {
        "even": r.random(1000), "odd": r.random(777) ** 9 * 1e9, "ties": np.repeat([1.0, 2.0, 3.0], [500, 3, 400]), "one": np.array([4.5]), "equal": np.full(600, -2.0),
        "edge": np.concatenate([np.full(450, 7.0), r.random(450) * 7]), "wide": np.concatenate([[-np.inf, np.inf], 10 ** r.integers(-300, 300, 500).astype(float)]), "two": np.array([1.0, 2.0]),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("even", None), (None, 3.0), (None, 5.0), ("void", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    shares = [0.0, 0.1, 0.5, 0.95, 1.0]
    want = {x.g: x.q for x in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()}
    got = {x.g: x.quantiles for x in exact_quantiles(df, ["g"], "v", shares, small, accuracy).collect()}
    assert got.keys() == want.keys()
    for k, q in got.items():
        assert q == (want[k] or [None] * len(shares)) or all(math.isclose(a, b, rel_tol=1e-15) for a, b in zip(q, want[k]))


def test_class_conflict_by_all_pairs(spark):
    r = random.Random(4)
    rows = []
    for region in range(40):
        for _ in range(r.randint(1, 12)):
            x, y = r.randrange(9), r.randrange(9)
            rows.append((region // 4, region % 4, len(rows), r.randrange(3), r.random(), float(x), float(y), float(x + r.randrange(6)), float(y + 4)))
    df = spark.createDataFrame(rows, "image_id long, region_id int, det_id long, category_id int, score double, x1 double, y1 double, x2 double, y2 double")
    want = {}
    for key, g in itertools.groupby(rows, key=lambda x: x[:2]):
        pairs = [(a, b) for a, b in itertools.combinations(list(g), 2) if a[3] != b[3]]
        if pairs:
            total = 0.0
            for a, b in pairs:
                w, h = min(a[7], b[7]) - max(a[5], b[5]), min(a[8], b[8]) - max(a[6], b[6])
                common = max(w, 0) * max(h, 0)
                union = (a[7] - a[5]) * 4 + (b[7] - b[5]) * 4 - common
                total += (common / union if union else 0) * math.sqrt(a[4] * b[4])
            want[key] = total / (len(pairs) + windows.EPSILON)
    got = {(x.image_id, x.region_id): x.class_conflict for x in windows.class_conflict(df, ["image_id", "region_id"], "det_id").collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)


def test_median_mad_reads_rows_once(spark):
    """Rows are counted by value in one pass; medians are those of ``percentile``, whatever repeats, is null or falls between two values."""
    from gridlark.operators.aggregates import median_mad

    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [(float(i % 7), None if i % 5 == 0 else float(i * i % 1013) / 8) for i in range(1000)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(3).mapInArrow(count, "a double, b double")
    got = {x.feature: (x.median, x.mad) for x in median_mad(df, ["a", "b"]).collect()}
    assert read.value == 1000
    for i, f in enumerate("ab"):
        values = np.array([x[i] for x in rows if x[i] is not None])
        assert got[f] == (np.median(values), np.median(np.abs(values - np.median(values))))


def test_counted_quantiles(spark):
    from gridlark.operators.quantiles import counted_quantiles

    r = np.random.default_rng(6)
    rows = [(k, float(v)) for k, n in (("x", 500), ("y", 77), (None, 2), ("z", 1)) for v in r.integers(0, 60, n) / 4] + [("x", None), ("void", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    shares = [0.0, 0.1, 0.5, 0.95, 1.0]
    want = {x.g: x.quantiles for x in exact_quantiles(df, ["g"], "v", shares).collect()}
    got = {x.g: x.quantiles for x in counted_quantiles(df.groupBy("g", "v").agg(F.count("*").alias("n")), ["g"], shares).collect()}
    assert got == want
