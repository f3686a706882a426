"""Resampling statistics over long tables of (contrast, resample, delta) and weighted average precision."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .coco_eval import EPS, dealt_by_score, score_ranges


#: Units whose multiplicities travel together, and multiplicities that a task makes at a time.
UNIT_BLOCK = 4096
PART = 64  # units of a block that get their weights together
DRAWN_AT_ONCE = 8_000_000
#: Units up to which every task holds the rows of all blocks; beyond, blocks meet by a shuffle.
WHOLE_UNITS = 500_000


def drawn_blocks(spark, n_resamples: int, n_units: int, seed: int, resamples: DataFrame | None = None) -> DataFrame:
    """resample, block, ms: how often each of the ``UNIT_BLOCK`` units of a block is drawn.  A draw depends only on (seed, resample,
    number), so any of the resamples (a table with that column) can be made anywhere; a task makes whole resamples, some at a
    time, and keeps four bytes a unit for each."""
    at_once = max(1, min(16, DRAWN_AT_ONCE // max(1, n_units)))
    tasks = -(-n_resamples // at_once)
    r = spark.range(0, n_resamples, 1, tasks).select(F.col("id").cast("int").alias("resample")) if resamples is None else resamples.select(F.col("resample").cast("int").alias("resample")).repartition(tasks, "resample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            for i in range(0, len(numbers), at_once):
                some = numbers[i : i + at_once]
                counts = [np.zeros(n_units, np.int32) for _ in some]
                for low in range(0, n_units, 1 << 16):
                    names = [b"%d" % j for j in range(low, min(n_units, low + (1 << 16)))]
                    for k, count in zip(some, counts, strict=True):
                        front = f"{seed}|{k}|".encode()
                        bits = np.frombuffer(b"".join([sha256(front + j).digest()[:8] for j in names]), ">u8") >> 4  # the first 60, as stable_hash
                        units, m = np.unique(bits % n_units, return_counts=True)
                        count[units.astype(np.int64)] += m.astype(np.int32)
                for k, count in zip(some, counts, strict=True):
                    starts = np.append(np.arange(0, n_units, UNIT_BLOCK), n_units).astype(np.int32)
                    ms = pa.ListArray.from_arrays(pa.array(starts), pa.array(count))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ms), k, np.int32)), pa.array(np.arange(len(ms), dtype=np.int32)), ms], ["resample", "block", "ms"])

    return r.mapInArrow(run, "resample int, block int, ms array<int>")


def draws(spark, n_resamples: int, n_units: int, seed: int, resamples: DataFrame | None = None) -> DataFrame:
    """resample, unit (0..n-1), m: how often each unit is drawn (see ``drawn_blocks``)."""
    each = drawn_blocks(spark, n_resamples, n_units, seed, resamples).select("resample", "block", F.posexplode("ms").alias("place", "m"))
    return each.where("m > 0").select("resample", (F.col("block") * UNIT_BLOCK + F.col("place")).alias("unit"), "m")


def resampled(rows: DataFrame, n_units: int, n_resamples: int, seed: int, resamples: DataFrame | None = None) -> DataFrame:
    """``rows`` (with ``unit``) of each resample, with ``resample`` and ``m`` in place of the unit.  Rows meet the draws by blocks of
    units, so a resample and a block are one row of the join."""
    others = [c for c in rows.columns if c != "unit"]
    held = F.array_sort(F.collect_list(F.struct((F.col("unit") % UNIT_BLOCK).cast("int").alias("_place"), *others)))  # the rows of UNIT_BLOCK units; sums go in their order
    blocks = rows.where(F.col("unit").between(0, n_units - 1)).groupBy(F.floor(F.col("unit") / UNIT_BLOCK).cast("int").alias("block")).agg(held.alias("_rows"))
    # without a hint Spark takes the draws for as small as the range they come from, and sends them all through the driver
    met = drawn_blocks(rows.sparkSession, n_resamples, n_units, seed, resamples).join(F.broadcast(blocks) if n_units <= WHOLE_UNITS else blocks.hint("shuffle_hash"), "block")
    return met.select("resample", "ms", F.inline("_rows")).select("resample", *others, F.get("ms", F.col("_place")).alias("m")).where("m > 0")


def paired_bootstrap(pairs: DataFrame, n_units: int, n_resamples: int, seed: int, statistic: Callable[[Column, Column], Column]) -> DataFrame:
    """delta of a user statistic by resample.  ``pairs``: unit, baseline, method; the statistic gets the two columns and the multiplicity ``m``."""
    drawn = resampled(pairs.select("unit", "baseline", "method"), n_units, n_resamples, seed)
    return drawn.groupBy("resample").agg(statistic(F.col("baseline"), F.col("method")).alias("delta"))


def weighted_mean_delta(a: Column, b: Column) -> Column:
    return F.sum((b - a) * F.col("m")) / F.sum("m")


def _vector(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.float64)


KEY = ["run", "category_id", "_b"]
KEY_TYPES = "run string, category_id int, _b int"
#: Bytes of a weight matrix up to which every task holds it whole; of a larger one a task holds some resamples, so many bytes at most.
WHOLE_MATRIX = 64 << 20
HELD_DRAWS = 256 << 20
POINTS = 101  # of recall
#: A head (totals down to a range, positives), or None, then true positives and weights of consecutive rows, of one key.
Piece = tuple[tuple, tuple[np.ndarray, ...] | None, np.ndarray | None, np.ndarray | None]


def _cuts(columns: list[np.ndarray], most: int) -> list[tuple[int, int]]:
    """Ranges of rows that are equal in all columns, at most ``most`` rows together."""
    n = len(columns[0])
    new = np.arange(n) % most == 0
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new).tolist()
    return list(zip(starts, [*starts[1:], n], strict=True))


def _blocks(rows: DataFrame, kinds: tuple, ranges: int | None) -> DataFrame:
    """Ranges of scores (``dealt_by_score``), each sorted once, worst first: consecutive rows of a key are one row with the numbers ``tp`` and ``unit``
    of them all; ``at`` tells their order.  What follows needs neither scores nor ids, and shuffles a few bytes for a row."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, batch in enumerate(batches):
            codes = {k: batch.column(k).dictionary_encode().indices.to_numpy() for k in KEY}
            places = [np.sort(x) for x in pd.DataFrame(codes).groupby(KEY, sort=False).indices.values()]  # few keys meet in a range
            numbers = [batch.column(c).to_numpy(zero_copy_only=False).astype(k) for c, k in zip(("tp", "unit"), kinds, strict=True)]
            keys = batch.select(KEY).take(pa.array([x[0] for x in places], pa.int64())).columns
            yield pa.RecordBatch.from_arrays([*keys, pa.array([at] * len(places), pa.int32()), *[pa.array([x[i].tobytes() for i in places], pa.binary()) for x in numbers]], [*KEY, "at", "tp", "unit"])

    # by score first: keys that meet in a range are told apart above, and numbers sort faster than names
    dealt = dealt_by_score(rows, KEY[:2], ranges).sortWithinPartitions("score", F.desc("image_id"), F.desc("det_id"))
    return written(dealt.select(*KEY, "tp", "unit").mapInArrow(packed, f"{KEY_TYPES}, at int, tp binary, unit binary"), "blocks")


def _scored(rows: DataFrame, unit: str) -> DataFrame:
    return rows.where("category_id is not null").select("run", F.col("category_id").cast("int").alias("category_id"), "image_id", "det_id", F.col("score").cast("double").alias("score"), F.col("tp").cast("long").alias("tp"), F.col(unit).alias("unit"))


def _needed(need: DataFrame) -> DataFrame:
    return need.select("resample", F.col("category_id").cast("int").alias("category_id"), F.col("npos").cast("long").alias("npos")).where("npos > 0")


def _area(best: np.ndarray) -> np.ndarray:
    """Sums of the envelope at the recall points, of the best precision (point, weighting) found from each point to the next."""
    return np.cumsum(np.maximum.accumulate(best[::-1], axis=0)[::-1], axis=0)[-1]


def _with_ap(need: DataFrame, runs: DataFrame, area: DataFrame) -> DataFrame:
    wanted = need.crossJoin(F.broadcast(runs))  # a few runs
    return wanted.join(area, ["run", "category_id", "resample"], "left").select("run", "category_id", "resample", (F.coalesce("area", F.lit(0.0)) / POINTS).alias("ap"), (F.coalesce("top", F.lit(0.0)) / F.col("npos")).alias("recall"))


def ap_under_weights(rows: DataFrame, need: DataFrame, n: int, weights: np.ndarray | DataFrame | Callable[[np.ndarray], np.ndarray] | None, ranges: int | None = None) -> DataFrame:
    """run, category_id, resample, ap, recall: average precision under ``n`` weightings at once.

    ``rows``: run, category_id, image_id, det_id, score, tp, unit; ``need``: resample, category_id, npos; ``weights``: how often each
    unit counts, as a matrix (unit x resample), a function from units to its rows, or a table (unit, m: 16-bit numbers).  Without ``weights`` rows have instead of a unit the bits ``counts``, which of at most
    63 weightings count the row, and ``tp`` holds bits too.  Rows are not repeated: tasks walk once through ranges
    of about equal size (``dealt_by_score``), worst first, with one vector for all weightings, in pieces of bounded size; only rows that answer for
    recall points leave them.  Totals and best precisions of a range are carried over in groups of at most ``ranges`` rows.  ``rows`` are read
    three times.  Categories without detections have AP 0, without positives no row."""
    spark = rows.sparkSession
    most = max(1, 500_000 // n)
    runs = rows.select("run").distinct()
    by_bits, joined = weights is None, isinstance(weights, DataFrame)  # functions that go to the workers must not hold a table
    rows = _scored(rows, "counts" if by_bits else "unit")
    bits = np.arange(n)
    kinds = (np.int64, np.int64) if by_bits else (np.int8, np.int32)
    if joined:
        rows = score_ranges(rows, KEY[:2], ranges)
        table, order = rows.join(weights, "unit").select(*KEY, "score", "image_id", "det_id", "tp", "m"), ["score", F.desc("image_id"), F.desc("det_id")]
    else:
        rows = _blocks(rows, kinds, ranges)
        table, order = rows, ["at"]
    n_ranges = rows.agg(F.max("_b")).first()[0]
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * ((n_ranges or 0) + 1))  # keys meet by chance in a task
    if by_bits:

        def matrix(unit: np.ndarray) -> np.ndarray:
            return (unit[:, None] >> bits) & 1
    elif callable(weights):

        def matrix(unit: np.ndarray) -> np.ndarray:
            return weights(unit).astype(np.int64)
    elif not joined:
        held = spark.sparkContext.broadcast(weights.astype(np.uint16))

        def matrix(unit: np.ndarray) -> np.ndarray:
            return held.value[unit].astype(np.int64)

    def head(g: pd.DataFrame, i: int) -> tuple[np.ndarray, ...] | None:
        return tuple(_vector(g[c].iloc[i]) for c in ("t", "w", "npos")) if "head" in g and g["head"].iloc[i] == 0 else None

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[Piece]:
        for g in batches:
            keys = [g[k].to_numpy() for k in KEY]
            for i, j in _cuts(keys, most):
                key, first = tuple(k[i] for k in keys), head(g, i)
                if first:
                    yield key, first, None, None
                    i += 1
                if i < j:
                    yield key, None, g["tp"].to_numpy()[i:j].astype(np.int64), np.frombuffer(b"".join(g["m"].iloc[i:j]), np.uint16).reshape(-1, n).astype(np.int64)

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[Piece]:
        for g in batches:
            for i, key in enumerate(zip(*[g[k] for k in KEY], strict=True)):
                first = head(g, i)
                if first:
                    yield key, first, None, None
                    continue
                tp, unit = (np.frombuffer(g[c].iloc[i], k).astype(np.int64) for c, k in zip(("tp", "unit"), kinds, strict=True))
                for low in range(0, len(tp), most):
                    yield key, None, tp[low : low + most], matrix(unit[low : low + most])

    pieces = listed if joined else unpacked

    def hits(tp: np.ndarray, m: np.ndarray) -> np.ndarray:
        return m * ((tp[:, None] >> bits) & 1 if by_bits else tp[:, None])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, t, w = None, np.zeros(n), np.zeros(n)
        for key, _, tp, m in pieces(batches):
            if key != now:
                if now:
                    yield pd.DataFrame([(*now, t.tobytes(), w.tobytes())], columns=[*KEY, "t", "w"])
                now, t, w = key, np.zeros(n), np.zeros(n)
            t += hits(tp, m).sum(axis=0)
            w += m.sum(axis=0)
        if now:
            yield pd.DataFrame([(*now, t.tobytes(), w.tobytes())], columns=[*KEY, "t", "w"])

    def carried(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_b", ascending=False)
        for c in ("t", "w"):
            g[c] = [x.tobytes() for x in np.cumsum(np.stack([_vector(x) for x in g[c]]), axis=0)]
        return g.drop_duplicates("_b", keep="last")[[*KEY, "t", "w"]]  # a range may come in several parts

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done() -> pd.DataFrame:
            found.append((np.arange(n, dtype=np.int32), place[-1], best))  # the best of the range, from its first row on
            at, points, value = (np.concatenate(x).tobytes() for x in zip(*found, strict=True))
            return pd.DataFrame([(*now, top.tobytes(), at, points, value)], columns=[*KEY, "top", "at", "point", "value"])

        now, best, top, place, found = None, None, None, np.zeros((1, n)), []
        for key, first, tp, m in pieces(batches):
            if key != now:
                if now:
                    yield done()
                now, best, place, found = None, np.zeros(n), np.zeros((1, n)), []
                if not first:  # the category has no positives
                    continue
                now, top = key, first[0]
                t, w, npos = first[0].copy(), first[1].copy(), first[2]  # totals down to this range
                continue
            hit = hits(tp, m)
            true = t - (np.cumsum(hit, axis=0) - hit)
            precision = true / (w - (np.cumsum(m, axis=0) - m) + EPS)
            envelope = np.maximum.accumulate(np.vstack([best[None], precision]), axis=0)[1:]
            place = np.floor(100 * true / npos)  # the last recall point that is reached
            row, at = np.nonzero((place > np.floor(100 * (true - hit) / npos)) | ((true == hit) & (hit > 0)))
            found.append((at.astype(np.int32), place[row, at], envelope[row, at]))
            best = envelope[-1]
            t -= hit.sum(axis=0)
            w -= m.sum(axis=0)
        if now:
            yield done()

    def areas(g: pd.DataFrame) -> pd.DataFrame:
        best = np.zeros((POINTS, n))
        for at, point, value in zip(g["at"], g["point"], g["value"], strict=True):
            np.maximum.at(best, (np.minimum(_vector(point), POINTS - 1).astype(int), np.frombuffer(at, np.int32)), _vector(value))
        top = np.max([_vector(x) for x in g["top"]], axis=0)
        return pd.DataFrame([(g["run"].iloc[0], g["category_id"].iloc[0], _area(best), top)], columns=["run", "category_id", "area", "top"])

    def vectors(g: pd.DataFrame) -> pd.DataFrame:
        npos = np.ones(n)  # weightings without positives are left out at the end
        npos[g["resample"].to_numpy()] = g["npos"].to_numpy(float)
        return pd.DataFrame([(g["category_id"].iloc[0], npos.tobytes())], columns=["category_id", "npos"])

    need = _needed(need)
    npos = need.groupBy("category_id").applyInPandas(vectors, "category_id int, npos binary")
    by_range = table.repartition(n_ranges, *KEY).sortWithinPartitions(*KEY, *order) if joined else table
    totals = by_range.mapInPandas(sums, f"{KEY_TYPES}, t binary, w binary").groupBy("run", "category_id").applyInPandas(carried, f"{KEY_TYPES}, t binary, w binary")
    # heads have numbers too: a null would make the column float, which holds 53 bits only
    heads = written(totals.join(npos, "category_id"), "ap-totals").withColumns({"head": F.lit(0), "at": F.lit(0)} | ({"tp": F.lit(0).cast("long")} if joined else {}))
    both = table.withColumn("head", F.lit(1)).unionByName(heads.drop("at") if joined else heads, allowMissingColumns=True)
    dealt = both.repartition(n_ranges, F.hash(*KEY)).sortWithinPartitions(*KEY, "head", *order)  # by an expression, see ``segmented``
    walked = dealt.mapInPandas(walk, f"{KEY_TYPES}, top binary, at binary, point binary, value binary")
    parts = walked.groupBy("run", "category_id").applyInPandas(areas, "run string, category_id int, area array<double>, top array<double>")
    area = parts.select("run", "category_id", F.posexplode(F.arrays_zip("area", "top")).alias("resample", "_v"))
    return _with_ap(need, runs, area.select("run", "category_id", "resample", "_v.area", "_v.top"))


def raise_best(best: np.ndarray, true: np.ndarray, seen: np.ndarray, npos: np.ndarray) -> None:
    """Enter true positives, best first, into ``best`` (point, weighting); counts up to each of them are given by weighting."""
    precision = true / (seen + EPS)
    first, last = (np.minimum(np.floor(100 * true[i] / npos), POINTS - 1).astype(int) for i in (0, -1))
    at = np.arange(len(npos))
    best[first, at] = np.maximum(best[first, at], precision.max(axis=0))
    moved = np.flatnonzero(first < last)  # few weightings pass a point in one piece
    if len(moved):
        place = np.minimum(np.floor(100 * true[1:, moved] / npos[moved]), POINTS - 1).astype(int)
        envelope = np.maximum.accumulate(precision[:0:-1, moved], axis=0)[::-1]
        row, k = np.nonzero(np.diff(place, axis=0, prepend=first[None, moved]))
        np.maximum.at(best, (place[row, k], moved[k]), envelope[row, k])


def ap_under_draws(rows: DataFrame, need: DataFrame, n: int, n_units: int, seed: int) -> DataFrame:
    """``ap_under_weights`` of ``n`` draws whose matrix is too large to be held: the resamples are dealt to tasks.

    A task keeps the multiplicities of its resamples, mostly a byte a unit for each, and walks once through the blocks of all rows, best
    first: counts begin at 0, and of the precisions only the best from each recall point to the next is kept.  A row costs
    five bytes a task and never meets its weights in a join.  ``rows`` are read three times, ``need`` twice."""
    spark = rows.sparkSession
    at_once = -(-n // min(n, max(-(-n * n_units // HELD_DRAWS), spark.sparkContext.defaultParallelism)))
    tasks = -(-n // at_once)
    kinds = (np.int8, np.int32)
    runs, need = rows.select("run").distinct(), _needed(need)

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ms = [x.values.to_numpy() for x in batch.column("ms")]
            data = pa.array([x.astype(np.uint8 if x.max() < 256 else np.int32).tobytes() for x in ms], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("resample"), batch.column("block"), data], ["resample", "block", "data"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, 100_000 // at_once)  # what the caches of a core hold
        task, now, held, npos, true, seen, best = None, None, None, {}, None, None, None

        def done() -> pa.RecordBatch:
            k = min(at_once, n - task * at_once)
            numbers = np.arange(task * at_once, task * at_once + k, dtype=np.int32)
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * k, pa.string()), pa.array(np.full(k, now[1], np.int32)), pa.array(numbers), pa.array(_area(best)[:k]), pa.array(true[:k])], ["run", "category_id", "resample", "area", "top"])

        for batch in batches:
            c = {x: batch.column(x).to_numpy(zero_copy_only=False) for x in ("task", "kind", "run", "category_id", "at", "number")}
            first, second = (batch.column(x) for x in ("tp", "unit"))
            for i in range(batch.num_rows):
                if c["task"][i] != task or (c["kind"][i] == 2 and (c["run"][i], c["category_id"][i]) != now):
                    if now:
                        yield done()
                    now = None
                if c["task"][i] != task:
                    task, held, npos = c["task"][i], np.zeros((n_units, at_once), np.uint8), {}
                if c["kind"][i] == 0:  # the draws of a resample and a block of units
                    m = np.frombuffer(first[i].as_buffer(), np.uint8 if c["at"][i] == 1 else np.int32)
                    held = held if m.dtype == held.dtype else held.astype(np.int32, copy=False)
                    low = c["number"][i] * UNIT_BLOCK
                    held[low : low + len(m), c["category_id"][i] - task * at_once] = m
                elif c["kind"][i] == 1:  # a resample's positives of a category
                    npos.setdefault(c["category_id"][i], np.ones(at_once))[c["number"][i] - task * at_once] = c["at"][i]
                else:
                    if now is None:
                        now, true, seen, best = (c["run"][i], c["category_id"][i]), np.zeros(at_once), np.zeros(at_once), np.zeros((POINTS, at_once))
                    if now[1] not in npos:
                        continue
                    tp, unit = (np.frombuffer(x[i].as_buffer(), k)[::-1] for x, k in zip((first, second), kinds, strict=True))
                    for low in range(0, len(tp), most):
                        m = held[unit[low : low + most]].astype(np.int32)
                        hit = np.flatnonzero(tp[low : low + most])  # the best from any row on is at one of them
                        t, so_far = np.cumsum(m[hit], axis=0), np.cumsum(m, axis=0)
                        if len(hit):
                            raise_best(best, true + t, seen + so_far[hit], npos[now[1]])
                            true = true + t[-1]
                        seen = seen + so_far[-1]
        if now:
            yield done()

    drawn = drawn_blocks(spark, n, n_units, seed).mapInArrow(narrowed, "resample int, block int, data binary")
    task = F.floor(F.col("resample") / at_once).cast("int").alias("task")
    size = F.least(F.lit(UNIT_BLOCK), F.lit(n_units) - F.col("block") * UNIT_BLOCK)
    none = F.lit(None).cast("binary")
    # what a row is by its kind: draws, positives, block of rows
    draws_ = drawn.select(task, F.lit(0).alias("kind"), F.lit("").alias("run"), F.col("resample").alias("category_id"), (F.length("data") / size).cast("long").alias("at"), F.col("block").alias("number"), F.col("data").alias("tp"), none.alias("unit"))
    needs = need.select(task, F.lit(1).alias("kind"), F.lit("").alias("run"), "category_id", F.col("npos").alias("at"), F.col("resample").alias("number"), none.alias("tp"), none.alias("unit"))
    blocks = _blocks(_scored(rows, "unit"), kinds, None)
    every = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task")
    blocks = blocks.select(every, F.lit(2).alias("kind"), "run", "category_id", F.col("at").cast("long").alias("at"), F.col("_b").alias("number"), "tp", "unit")
    dealt = draws_.unionByName(needs).unionByName(blocks).repartitionById(tasks, F.col("task"))
    dealt = dealt.sortWithinPartitions("task", "kind", "run", "category_id", F.desc("number"), F.desc("at"))
    return _with_ap(need, runs, dealt.mapInArrow(walk, "run string, category_id int, resample int, area double, top double"))


def drawn_weights(spark, n_resamples: int, n_units: int, seed: int) -> np.ndarray | DataFrame:
    """The draws as a matrix where it is small, else as a table of one row a unit."""

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, d in zip(batch.column(0).to_pylist(), batch.column(1)):
                ms = d.values.field("ms")
                m = np.zeros((len(ms[0]), n_resamples), np.uint16)
                m[:, d.values.field("resample").to_numpy()] = ms.flatten().to_numpy().reshape(len(ms), -1).T
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(m), dtype=np.int32) + block * PART), pa.array([x.tobytes() for x in m], pa.binary())], ["unit", "m"])

    by_part = drawn_blocks(spark, n_resamples, n_units, seed).select("resample", "block", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(UNIT_BLOCK - 1), F.lit(PART)), lambda at: F.slice("ms", at + 1, PART))).alias("part", "ms")).where("size(ms) > 0")
    by_part = by_part.select("resample", (F.col("block") * (UNIT_BLOCK // PART) + F.col("part")).alias("block"), "ms")
    table = by_part.groupBy("block").agg(F.collect_list(F.struct("resample", "ms")).alias("d"))  # n_resamples x PART numbers
    table = table.mapInArrow(dense, "unit int, m binary")
    if 2 * n_units * n_resamples > WHOLE_MATRIX:
        return written(table, "draws")
    matrix = np.zeros((n_units, n_resamples), np.uint16)
    for row in table.toLocalIterator():
        matrix[row["unit"]] = np.frombuffer(row["m"], np.uint16)
    return matrix


def _of_runs(matches: dict[str, DataFrame], clusters: DataFrame) -> DataFrame:
    each = [df.select("image_id", "category_id", "det_id", "score", "tp").withColumn("run", F.lit(run)) for run, df in matches.items()]
    return reduce(DataFrame.unionByName, each).join(clusters, "image_id")


def ap_cluster_bootstrap(matches: dict[str, DataFrame], npos: DataFrame, clusters: DataFrame, n_clusters: int, n_resamples: int, seed: int) -> DataFrame:
    """resample and AP of every run, all on the same draws: matches are made once and weighted by how often their cluster is drawn.

    ``matches``: run -> (image_id, category_id, det_id, score, tp); ``npos``: image_id, category_id, npos; ``clusters``: image_id, unit (0 to n_clusters - 1)."""
    spark = npos.sparkSession
    by_unit = npos.join(clusters, "image_id").groupBy("unit", "category_id").agg(F.sum("npos").alias("npos"))
    need = resampled(by_unit, n_clusters, n_resamples, seed).groupBy("resample", "category_id").agg(F.sum(F.col("npos") * F.col("m")).alias("npos"))
    need = written(need, "positives")  # read several times, and each time all would be drawn again
    rows = written(_of_runs(matches, clusters), "matches-of-runs")
    if 2 * n_clusters * n_resamples > WHOLE_MATRIX:
        ap = ap_under_draws(rows, need, n_resamples, n_clusters, seed)
    else:
        ap = ap_under_weights(rows, need, n_resamples, drawn_weights(spark, n_resamples, n_clusters, seed))
    return ap.groupBy("run", "resample").agg(F.avg("ap").alias("ap"))


def pending_resamples(planned: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Planned (contrast, resample) slots without a stored delta."""
    return planned.join(stored.where("delta is not null").select(*keys).distinct(), keys, "left_anti")


def sign_pvalue(delta: str = "delta") -> Column:
    n = F.count("*") + 1
    low, high = (F.count_if(F.col(delta) <= 0) + 1) / n, (F.count_if(F.col(delta) >= 0) + 1) / n
    return F.least(F.lit(1.0), 2 * F.least(low, high))


def holm(df: DataFrame, family: list[str], p: str, tie: str) -> DataFrame:
    w = Window.partitionBy(*family)
    rank = F.row_number().over(w.orderBy(p, tie))
    step = (F.count("*").over(w) - rank + 1) * F.col(p)
    raw = df.withColumn("_s", step)
    return raw.withColumn("p_holm", F.least(F.lit(1.0), F.max("_s").over(w.orderBy(p, tie).rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def benjamini_hochberg(df: DataFrame, family: list[str], p: str, tie: str) -> DataFrame:
    w = Window.partitionBy(*family)
    rank = F.row_number().over(w.orderBy(p, tie))
    raw = df.withColumn("_s", F.col(p) * F.count("*").over(w) / rank)
    return raw.withColumn("p_bh", F.least(F.lit(1.0), F.min("_s").over(w.orderBy(F.desc(p), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def contrast_row(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, 95 % interval, deviation, standardised effect and p of each contrast."""
    ci = F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975)))
    g = deltas.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("delta").alias("mean"), F.get(ci, 0).alias("low"), F.get(ci, 1).alias("high"), F.stddev_samp("delta").alias("std"), sign_pvalue().alias("p"))
    return g.withColumn("effect", F.when(F.col("std") > 0, F.col("mean") / F.col("std")))


def cluster_summary(deltas: DataFrame, cells: list[str], keys: list[str]) -> DataFrame:
    """Deltas averaged over cells inside each resample, then summarised."""
    mean = deltas.groupBy(*keys, "resample").agg(F.avg("delta").alias("delta"))
    return contrast_row(mean, keys)


def recenter(deltas: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Shift by direct minus raw point estimate."""
    return deltas.join(points, keys).withColumn("delta", F.col("delta") + F.col("direct") - F.col("raw"))


def factorial_2x2(deltas: DataFrame, first: str, second: str) -> DataFrame:
    """Main effect (half the sum) and interaction (difference) of two contrasts on the same resamples."""
    p = deltas.where(F.col("method").isin(first, second)).groupBy("seed", "resample").pivot("method", [first, second]).agg(F.first("delta"))
    a, b = F.col(f"`{first}`"), F.col(f"`{second}`")
    return p.select("seed", "resample", F.inline(F.array(F.struct(F.lit("main").alias("effect"), ((a + b) / 2).alias("delta")), F.struct(F.lit("interaction").alias("effect"), (a - b).alias("delta")))))


def leave_one_group_out(matches: dict[str, DataFrame], npos: DataFrame, clusters: DataFrame, baseline: str, method: str) -> DataFrame:
    """omitted, baseline_ap, method_ap, delta, shift (from the delta of all) for each cluster left out; all runs in one walk, in
    which weighting k leaves cluster k out, the last one none.

    Clusters are registered groups: their names are numbered on the driver."""
    spark = npos.sparkSession
    units = sorted(r[0] for r in clusters.select("unit").distinct().collect())
    n = len(units)
    numbers = spark.createDataFrame(list(enumerate(units)), "number int, omitted " + dict(clusters.dtypes)["unit"])
    numbered = clusters.join(numbers, F.col("unit") == F.col("omitted")).select("image_id", F.col("number").alias("unit"))
    counts = written(npos.join(numbered, "image_id").groupBy("unit", "category_id").agg(F.sum("npos").alias("npos")), "positives")
    total = counts.groupBy("category_id").agg(F.sum("npos").alias("all"))
    ways = spark.range(n + 1).select(F.col("id").cast("int").alias("resample"))
    own = counts.select(F.col("unit").alias("resample"), "category_id", "npos")
    need = total.crossJoin(ways).join(own, ["resample", "category_id"], "left").select("resample", "category_id", (F.col("all") - F.coalesce("npos", F.lit(0))).alias("npos"))
    ap = ap_under_weights(written(_of_runs(matches, numbered), "matches-of-runs"), need, n + 1, lambda unit: unit[:, None] != np.arange(n + 1)).groupBy("run", "resample").agg(F.avg("ap").alias("ap"))
    both = ap.groupBy("resample").pivot("run", [baseline, method]).agg(F.first("ap"))
    both = written(both.select("resample", F.col(f"`{baseline}`").alias("baseline_ap"), F.col(f"`{method}`").alias("method_ap")).withColumn("delta", F.col("method_ap") - F.col("baseline_ap")), "left-out")
    full = both.where(F.col("resample") == n).select(F.col("delta").alias("full_delta"))
    out = both.join(numbers, F.col("resample") == F.col("number")).crossJoin(F.broadcast(full))  # one row
    return out.select("omitted", "baseline_ap", "method_ap", "delta", (F.col("delta") - F.col("full_delta")).alias("shift"), "full_delta")


def influence_summary(left_out: DataFrame) -> DataFrame:
    """One row: the delta of all, the least and the greatest delta without a group, the group of the largest shift with that shift
    and its delta (the least name of equals), and the share of positive deltas."""
    worst = F.min(F.struct((-F.abs("shift")).alias("less"), "omitted", "delta"))
    g = left_out.agg(F.first("full_delta").alias("full_delta"), F.min("delta").alias("min_delta"), F.max("delta").alias("max_delta"), worst.alias("worst"), F.avg((F.col("delta") > 0).cast("double")).alias("share_positive"))
    return g.select("full_delta", "min_delta", "max_delta", (-F.col("worst.less")).alias("largest_shift"), F.col("worst.omitted").alias("most_influential"), F.col("worst.delta").alias("influential_delta"), "share_positive")


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    from .windows import avg_rank

    ranked = df.withColumn("_rx", avg_rank(x, keys)).withColumn("_ry", avg_rank(y, keys))
    return ranked.groupBy(*keys).agg(F.when((F.stddev_pop("_rx") > 0) & (F.stddev_pop("_ry") > 0), F.corr("_rx", "_ry") + 0.0).alias("spearman"))


def multiplicity_table(df: DataFrame, family: list[str], p: str, tie: str, level: float = 0.05) -> DataFrame:
    both = benjamini_hochberg(holm(df, family, p, tie), family, p, tie)
    return both.withColumns({"raw_significant": F.col(p) < level, "holm_significant": F.col("p_holm") < level, "bh_significant": F.col("p_bh") < level})
