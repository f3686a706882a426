"""Rows that nothing dominates, found without comparing all pairs.

A dominating row has a smaller sum of costs, so rows are taken in order of that sum and compared to the skyline so far only.
Each task keeps the skyline of its own rows; the survivors meet in fewer and fewer tasks, at last one a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import ranges

#: Rows of a task that are compared together, and survivors of how many tasks meet in one.
CHUNK = 1 << 16
FAN_IN = 16
BLOCK = 512


def undominated(group: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Which rows no row of their group dominates: no greater in any cost and less in one.  A row with an unknown cost (NaN)
    neither dominates nor is dominated; equal rows stay together."""
    keep = np.ones(len(group), bool)
    known = np.flatnonzero(~np.isnan(cost).any(axis=1))
    order = known[np.lexsort((*cost[known].T[::-1], cost[known].sum(axis=1), group[known]))]
    first = np.flatnonzero(np.diff(group[order], prepend=-1)) if len(order) else order
    size = np.diff(np.append(first, len(order)))
    small = size <= 64
    # small groups: all their pairs (row, earlier row) at once, a bounded number of groups at a time
    at = np.flatnonzero(small)
    for some in np.array_split(at, max(1, int((size[at] ** 2).sum()) // 1_000_000 + 1)) if len(at) else []:
        row = ranges(first[some], size[some])
        other = ranges(np.repeat(first[some], size[some]), np.repeat(size[some], size[some]))
        row = np.repeat(row, np.repeat(size[some], size[some]))
        a, b = cost[order[row]], cost[order[other]]
        keep[order[row[(b <= a).all(axis=1) & (b < a).any(axis=1)]]] = False
    for k in np.flatnonzero(~small):
        rows = order[first[k] : first[k] + size[k]]
        best = np.zeros((0, cost.shape[1]))
        for i in range(0, len(rows), BLOCK):
            block = rows[i : i + BLOCK]
            live = np.ones(len(block), bool)
            for j in range(0, len(best), 8 * BLOCK):
                live[live] = ~_beaten(cost[block[live]], best[j : j + 8 * BLOCK])
            block_live = block[live]
            inner = _beaten(cost[block_live], cost[block_live])
            keep[block[~live]] = keep[block_live[inner]] = False
            best = np.concatenate([best, cost[block_live[~inner]]])
    return keep


def _beaten(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` a row of ``b`` dominates."""
    no_worse, better = np.ones((len(a), len(b)), bool), np.zeros((len(a), len(b)), bool)
    for d in range(a.shape[1]):
        no_worse &= b[None, :, d] <= a[:, None, d]
        better |= b[None, :, d] < a[:, None, d]
    return (no_worse & better).any(axis=1)


def pareto(df: DataFrame, group: list[str], maximise: list[str], minimise: list[str], key: str) -> DataFrame:
    """Rows that no other row of the group dominates.  ``key`` tells rows apart for the reader only; equal rows all stay."""
    costs = [*maximise, *minimise]
    sign = np.array([-1.0] * len(maximise) + [1.0] * len(minimise))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = settled = 0

        def survivors() -> pa.Table:
            table = pa.Table.from_batches(held).combine_chunks()
            cost = np.stack([table.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in costs], axis=1).astype(float) * sign
            label = np.zeros(len(table), np.int64)
            for c in group:
                codes = table.column(c).combine_chunks().dictionary_encode()
                codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
                code = codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
                label = np.unique(label * (len(codes.dictionary) + 1) + code, return_inverse=True)[1]
            return table.filter(pa.array(undominated(label, cost)))

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= max(CHUNK, 2 * settled):  # the skyline at least doubled since it was last made
                held = survivors().to_batches()
                n = settled = sum(b.num_rows for b in held)
        if n:
            yield from survivors().to_batches()

    out = df.mapInArrow(local, df.schema)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        out = out.repartition(tasks, *group, F.pmod(F.xxhash64(*costs), F.lit(tasks))).mapInArrow(local, df.schema)
    out = out.repartition(*group) if group else out.repartition(1)
    return out.mapInArrow(local, df.schema)
