"""Draws of many units: nothing of their number is in a plan, and rows meet them by blocks."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.operators import stats


def plain_draws(n_resamples, n, seed):
    each = lambda r: Counter(int(hashlib.sha256(f"{seed}|{r}|{j}".encode()).hexdigest()[:15], 16) % n for j in range(n))
    return [each(r) for r in range(n_resamples)]


def plan(df):
    return (df.queryExecution if hasattr(df, "queryExecution") else df._jdf.queryExecution()).toString()


@pytest.mark.parametrize("whole", [0, 10**9])
def test_rows_meet_draws_by_blocks(spark, monkeypatch, whole):
    monkeypatch.setattr(stats, "WHOLE_UNITS", whole)
    n, want = 9000, plain_draws(3, 9000, 7)
    pairs = spark.range(n).where("id % 5 <> 0").select(F.col("id").alias("unit"), (F.col("id") % 97).cast("double").alias("baseline"), (F.col("id") % 89).cast("double").alias("method"))
    got = {r.resample: r.delta for r in stats.paired_bootstrap(pairs, n, 3, 7, stats.weighted_mean_delta).collect()}
    for r, c in enumerate(want):
        some = {u: m for u, m in c.items() if u % 5}
        assert abs(got[r] - sum((u % 89 - u % 97) * m for u, m in some.items()) / sum(some.values())) < 1e-9
    assert {(x.resample, x.unit): x.m for x in stats.draws(spark, 3, n, 7).collect()} == {(r, u): m for r, c in enumerate(want) for u, m in c.items()}


def test_plans_do_not_grow_with_units(spark):
    pairs = spark.createDataFrame([(0, 1.0, 2.0)], "unit int, baseline double, method double")
    sizes = [len(plan(stats.paired_bootstrap(pairs, n, 5, 7, stats.weighted_mean_delta))) for n in (1000, 100_000)]
    assert sizes[1] < sizes[0] + 500


@pytest.mark.parametrize("most", [0, 1 << 30])
def test_weights_of_units(spark, monkeypatch, most):
    monkeypatch.setattr(stats, "WHOLE_MATRIX", most)
    n = 4500
    got = stats.drawn_weights(spark, 4, n, 3)
    if not most:
        rows = {r.unit: np.frombuffer(r.m, np.uint16) for r in got.collect()}
        assert sorted(rows) == list(range(n))
        got = np.stack([rows[u] for u in range(n)])
    want = plain_draws(4, n, 3)
    assert got.tolist() == [[c[u] for c in want] for u in range(n)]


def test_draws_beyond_a_small_matrix_give_the_same_precision(spark, monkeypatch):
    """A table of weights used to reach the workers' functions, which fails; the draws are made for the weights and the positives alone."""
    made = []
    drawn = stats.drawn_blocks
    monkeypatch.setattr(stats, "drawn_blocks", lambda *a, **k: made.append(1) or drawn(*a, **k))
    n_units = 150
    units = spark.range(n_units).selectExpr("id AS image_id", "cast(id AS int) AS unit")
    rows = spark.range(900).selectExpr(f"id % {n_units} AS image_id", "cast(id % 2 AS int) AS category_id", "id AS det_id", "cast((id * 37) % 101 AS double) / 101 AS score", "cast((id * 7) % 3 = 0 AS int) AS tp")
    npos = rows.groupBy("image_id", "category_id").agg(F.sum("tp").alias("npos"))

    def run():
        return {x.resample: x.ap for x in stats.ap_cluster_bootstrap({"base": rows}, npos, units, n_units, 30, 5).collect()}

    small = run()
    monkeypatch.setattr(stats, "WHOLE_MATRIX", 0)
    large = run()
    assert len(small) == 30 and large == small and len(made) == 4


@pytest.mark.parametrize("held", [1, 1 << 28])
def test_rows_never_meet_a_vector_of_weights(spark, monkeypatch, held):
    """Beyond a small matrix every row used to be joined to a number a resample: two kilobytes a row in each shuffle."""
    import re

    monkeypatch.setattr(stats, "WHOLE_MATRIX", 0)
    monkeypatch.setattr(stats, "HELD_DRAWS", held, raising=False)  # one resample a task, and one task a core
    units = spark.range(5000).selectExpr("id AS image_id", "cast(id AS int) AS unit")  # more than a block of units
    rows = spark.range(9000).selectExpr("id % 4990 AS image_id", "1 AS category_id", "id AS det_id", "cast((id * 37) % 1001 AS double) / 1001 AS score", "cast((id * 7) % 3 = 0 AS int) AS tp")
    npos = rows.groupBy("image_id", "category_id").agg(F.sum("tp").alias("npos"))
    df = stats.ap_cluster_bootstrap({"base": rows}, npos, units, 5000, 6, 5)
    assert not re.search(r"\(unit#\d+L? = unit#\d+L?\)", plan(df))
    got = {x.resample: x.ap for x in df.collect()}
    local = sorted(((i * 37) % 1001 / 1001, -(i % 4990), -i, int((i * 7) % 3 == 0)) for i in range(9000))[::-1]
    for k, c in enumerate(plain_draws(6, 5000, 5)):
        m = np.array([c[-image] for _, image, _, _ in local])
        hit = m * np.array([x[3] for x in local])
        precision = np.maximum.accumulate((np.cumsum(hit) / np.maximum(np.cumsum(m), 1))[::-1])[::-1]
        reached = np.searchsorted(100 * np.cumsum(hit), np.maximum(np.arange(101) * hit.sum(), 1))
        assert abs(got[k] - precision[reached].sum() / 101) < 1e-9


def test_draws_of_many_units_are_never_sent_to_all(spark, monkeypatch):
    """Spark's estimate of their size is that of a range of resamples, so that it broadcast all draws through the driver."""
    monkeypatch.setattr(stats, "WHOLE_UNITS", 0)
    pairs = spark.range(20_000).select(F.col("id").alias("unit"), F.lit(0.0).alias("baseline"), F.col("id").cast("double").alias("method"))
    df = stats.paired_bootstrap(pairs, 20_000, 4, 7, stats.weighted_mean_delta)
    got = {x.resample: x.delta for x in df.collect()}
    assert "Broadcast" not in plan(df)
    assert all(abs(got[k] - sum(u * m for u, m in c.items()) / 20_000) < 1e-6 for k, c in enumerate(plain_draws(4, 20_000, 7)))
