"""Groups left out one at a time: rows meet once in order of score, and what walks over them takes blocks of rows."""

import random

import numpy as np
import pytest

from gridlark import fixtures
from gridlark.operators import coco_eval, stats
from gridlark.plans import queries_eval
from gridlark.registry import QUERIES
from gridlark.sources import shared

SF = "/root/testdata/sf0.001"


def plain(df):
    return (df.queryExecution if hasattr(df, "queryExecution") else df._jdf.queryExecution()).toString()


def test_tables_are_read_once_and_rows_are_walked_in_blocks(spark, monkeypatch):
    made = []
    once = shared.written

    def noted(df, name):
        made.append((name, plain(df), once(df, name)))
        return made[-1][2]

    for module in (fixtures, stats, coco_eval, queries_eval):
        monkeypatch.setattr(module, "written", noted, raising=False)
    assert len(QUERIES["b12_leave_one_group_out"](spark, SF).collect()) == 25
    assert sum("lineitem.parquet" in text for _, text, _ in made) == 1
    assert not any("LeftSemi" in text for _, text, _ in made)  # all rows of a category in one task
    rows = {name: df.count() for name, _, df in made}
    assert rows["matches-of-runs"] > 5000 and rows["blocks"] < 100


def test_views_over_a_written_one_are_the_same(spark):
    v, other = fixtures.Views(spark, SF), fixtures.Views(spark, "/root/testdata/sf0.01")
    kept = v.once("boxes")
    for name in ("gt", "dt", "dt_method", "best"):
        a, b = getattr(v, name), getattr(kept, name)
        assert a.schema == b.schema and "lineitem" not in plain(b) and sorted(a.collect()) == sorted(b.collect())
    assert other.gt.count() > 5 * kept.gt.count()


@pytest.mark.parametrize("held, batch", [(True, 3), (True, 10000), (False, 5)])
def test_ranges_and_batches_cut_anywhere(spark, monkeypatch, held, batch):
    """All ways of weights at ranges of a few rows and batches that end anywhere, against one sorted list; a class has no positives."""
    monkeypatch.setattr(coco_eval, "RANGE_ROWS", 9)
    monkeypatch.setattr(stats, "WHOLE_MATRIX", 1 << 26 if held else 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    r = random.Random(5)
    n = 6
    rows = [(run, i % 3, i // 4, i, r.choice([0.0, 0.25, 0.5, r.random()]), int(r.random() < 0.6), i // 4 % n) for run in ("a", "b") for i in range(120)]
    npos = {0: 60, 1: 47}
    table = shared.written(spark.createDataFrame(rows, "run string, category_id int, image_id long, det_id long, score double, tp int, unit int").repartition(3), "rows")
    need = spark.createDataFrame([(k, c, p) for k in range(n + 1) for c, p in npos.items()], "resample int, category_id int, npos long")
    weight = 1 - np.eye(n, n + 1, dtype=np.uint16)
    ways = [weight, lambda unit: weight[unit]] if held else [spark.createDataFrame([(u, bytearray(weight[u].tobytes())) for u in range(n)], "unit int, m binary")]
    try:
        got = [{(x.run, x.category_id, x.resample): (x.ap, x.recall) for x in stats.ap_under_weights(table, need, n + 1, w).collect()} for w in ways]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for run in ("a", "b"):
        for c, p in npos.items():
            for k in range(n + 1):
                curve, true = [], 0
                for x in sorted((x for x in rows if x[:2] == (run, c) and x[6] != k), key=lambda x: (-x[4], x[2], x[3])):
                    true += x[5]
                    curve.append((true, true / (len(curve) + 1)))
                ap = sum(max([q for t, q in curve if 100 * t >= point * p], default=0) for point in range(101)) / 101
                for g in got:
                    assert abs(g[run, c, k][0] - ap) < 1e-9 and abs(g[run, c, k][1] - true / p) < 1e-12
    assert all(len(g) == 2 * 2 * (n + 1) for g in got)
