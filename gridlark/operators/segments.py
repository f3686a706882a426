"""Kernels over many groups at once.

``segmented`` sorts rows inside partitions by group and hands a numpy kernel whole groups by the thousand, as columns with
offsets, so that nothing is paid for each image.  The rules that depend on an order inside a group (suppression, one-to-one
matching, clusters) are made of the steps below; each of them treats all groups of a chunk together, and goes on in rounds
until every group is settled.  A group is never split: a task holds one image's boxes, as its rules ask.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows handed to a kernel together (whole groups, so at least one), and pairs of boxes compared at a time.
CHUNK_ROWS = 60_000
CHUNK_PAIRS = 2_000_000
Columns = dict[str, np.ndarray]


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``start[0], start[0] + 1, ...`` (``size[0]`` numbers), then those of the next."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Places at which any of the columns has another value than the row before; the first row is one."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def numbered(starts: np.ndarray, n: int) -> np.ndarray:
    """Group of each of ``n`` rows, from 0."""
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))


def place_in(group: np.ndarray) -> np.ndarray:
    """How many rows of the same group stand before; equal groups stand together."""
    first = changes(group)
    return np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))


def segmented(df: DataFrame, keys: list[str], order: list[str | Column], kernel: Callable[[Columns, np.ndarray], dict], schema: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """``kernel(columns, starts)`` on whole groups of ``keys``, about ``rows`` rows at a time, in the given order; it returns columns by name."""
    names = df.columns
    kinds = [c.split() for c in schema.split(", ")]

    def done(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        out = kernel({n: table.column(n).to_numpy(zero_copy_only=False) for n in names}, starts)
        return pa.RecordBatch.from_arrays([pa.array(out[n], ARROW[k]) for n, k in kinds], [n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                table = pa.Table.from_batches(held).combine_chunks()
                starts = changes(*(table.column(k).to_numpy(zero_copy_only=False) for k in keys))
                if len(starts) > 1:  # the last group may go on
                    yield done(table.slice(0, starts[-1]), starts[:-1])
                    table = table.slice(starts[-1])
                held, n = table.to_batches(), table.num_rows
        if n:
            table = pa.Table.from_batches(held).combine_chunks()
            yield done(table, changes(*(table.column(k).to_numpy(zero_copy_only=False) for k in keys)))

    # by an expression of the key: Spark drops a repartition of a union that it takes for dealt by the key already, although a join
    # of one side may since have become a broadcast, whose rows are not dealt at all
    return df.repartition(F.hash(keys[0])).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64(), "smallint": pa.int16(), "float": pa.float32()}


def pair_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of row i of ``a`` and row i of ``b``."""
    side = np.minimum(a[:, 2:], b[:, 2:]) - np.maximum(a[:, :2], b[:, :2])
    common = np.clip(side, 0, None).prod(axis=1)
    area = [np.clip(m[:, 2:] - m[:, :2], 0, None).prod(axis=1) for m in (a, b)]
    union = area[0] + area[1] - common
    return np.divide(common, union, out=np.zeros_like(common), where=union > 0)


def touching(group_a: np.ndarray, a: np.ndarray, group_b: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of ``a``, row of ``b``) of one group whose spans in x meet, a bounded number at a time: every row sweeps
    over those of the other side that begin inside its span, from ``a`` including equal beginnings."""
    for (g1, one), (g2, two), turned in (((group_a, a), (group_b, b), False), ((group_b, b), (group_a, a), True)):
        by = np.lexsort((two[:, 0], g2))
        g, x = g2[by], two[by, 0]
        # places are ranks of (group, x): exact, whatever the numbers
        left = _rank(g, x, g1, one[:, 0], "right" if turned else "left")
        right = _rank(g, x, g1, one[:, 2], "right")
        size = np.maximum(right - left, 0)
        at = 0
        ends = np.cumsum(size)
        while at < len(size):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + CHUNK_PAIRS, side="right")))
            i, j = np.repeat(np.arange(at, to), size[at:to]), by[ranges(left[at:to], size[at:to])]
            yield (j, i) if turned else (i, j)
            at = to


def _rank(g: np.ndarray, x: np.ndarray, group: np.ndarray, value: np.ndarray, side: str) -> np.ndarray:
    """How many of the sorted (g, x) stand before each (group, value)."""
    both_g, both_x = np.concatenate([g, group]), np.concatenate([x, value])
    ours = np.concatenate([np.ones(len(g), np.int8), np.zeros(len(group), np.int8)])
    tie = ours if side == "left" else -ours
    order = np.lexsort((tie, both_x, both_g))
    count = np.cumsum(ours[order] == 1)
    out = np.empty(len(order), np.int64)
    out[order] = count
    return out[len(g) :]


def near_pairs(group_a: np.ndarray, a: np.ndarray, group_b: np.ndarray, b: np.ndarray, least: float, inclusive: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, iou) of the pairs of one group with at least (or more than) this IoU, in order of the rows."""
    if least < 0 or (least == 0 and inclusive):
        raise ValueError("pairs that do not overlap have no end")
    found = []
    for i, j in touching(group_a, a, group_b, b):
        iou = pair_iou(a[i], b[j])
        ok = iou >= least if inclusive else iou > least
        found.append((i[ok], j[ok], iou[ok]))
    i, j, iou = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    order = np.lexsort((j, i))
    return i[order], j[order], iou[order]


def suppressed(group: np.ndarray, box: np.ndarray, least: float, inclusive: bool) -> np.ndarray:
    """Which rows stay, best first inside their group: a row goes if a row that stays stands before it and overlaps it."""
    i, j, _ = near_pairs(group, box, group, box, least, inclusive)
    before = i < j
    return independent(len(box), i[before], j[before])


def independent(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Rows stay unless a row that stays excludes them; pairs (i, j), i < j: i excludes j."""
    stays, open_ = np.zeros(n, bool), np.ones(n, bool)
    while len(i):
        waits = np.zeros(n, bool)
        waits[j] = True
        sure = open_ & ~waits
        stays |= sure
        open_ &= ~sure
        gone = np.zeros(n, bool)
        gone[j[sure[i]]] = True
        open_ &= ~gone
        left = open_[i] & open_[j]
        i, j = i[left], j[left]
    return stays | open_


def greedy_edges(group: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Edges taken in their order, each side once in its group: an edge first at both its ends is taken, what meets it goes."""
    n = len(group)
    ends = [np.unique(np.stack([group, side]), axis=1, return_inverse=True)[1].reshape(-1) if n else group for side in (left, right)]
    taken, live = np.zeros(n, bool), np.arange(n)
    while len(live):
        first = np.ones(len(live), bool)
        for e in ends:
            least = np.full(int(e.max()) + 1, n)
            np.minimum.at(least, e[live], live)
            first &= least[e[live]] == live
        picked = live[first]
        taken[picked] = True
        for e in ends:
            used = np.zeros(int(e.max()) + 1, bool)
            used[e[picked]] = True
            live = live[~used[e[live]]]
    return taken


class Clusters:
    """Weighted means of boxes, all groups at once; sums are kept in the order in which members came."""

    def __init__(self, capacity: int):
        self.n, self.mass, self.weight, self.score = np.zeros(capacity, np.int64), np.zeros(capacity), np.zeros(capacity), np.zeros(capacity)
        self.coords, self.plain, self.box = np.zeros((capacity, 4)), np.zeros((capacity, 4)), np.zeros((capacity, 4))

    def add(self, at: np.ndarray, box: np.ndarray, score: np.ndarray, weight: np.ndarray) -> None:
        """One member to each of different clusters."""
        self.n[at] += 1
        self.mass[at] += score * weight
        self.weight[at] += weight
        self.score[at] += score * weight
        self.coords[at] += box * score[:, None] * weight[:, None]
        self.plain[at] += box
        self._update(at)

    def join(self, to: np.ndarray, other: np.ndarray) -> None:
        for x in (self.n, self.mass, self.weight, self.score, self.coords, self.plain):
            x[to] += x[other]
        self._update(to)

    def _update(self, at: np.ndarray) -> None:
        heavy = self.mass[at] > 0
        self.box[at] = np.where(heavy[:, None], self.coords[at] / np.where(heavy, self.mass[at], 1.0)[:, None], self.plain[at] / self.n[at][:, None])

    def mean_score(self, at: np.ndarray) -> np.ndarray:
        some = self.weight[at] != 0
        return np.where(some, np.clip(self.score[at] / np.where(some, self.weight[at], 1.0), 0.0, 1.0), 0.0)


def last_best(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """In each group (none is empty) the place of the greatest value, the later of equals."""
    top = np.maximum.reduceat(value, starts)
    equal = value == np.repeat(top, np.diff(np.append(starts, len(value))))
    return np.maximum.reduceat(np.where(equal, np.arange(len(value)), -1), starts)


def gathered(group: np.ndarray, box: np.ndarray, score: np.ndarray, weight: np.ndarray, least: float) -> tuple[Clusters, np.ndarray, np.ndarray]:
    """Each row, in order, joins the cluster of its group that it overlaps most (the later of equals) or begins one.

    Step k takes the k-th row of every group.  Returns the clusters, their groups and their places in order of making;
    cluster slots begin at a group's first row."""
    starts = changes(group)
    size = np.diff(np.append(starts, len(group)))
    made, c = np.zeros(len(starts), np.int64), Clusters(len(group))
    active = np.flatnonzero(size > 0)
    k = 0
    while len(active):
        row = starts[active] + k
        some = np.flatnonzero(made[active] > 0)
        goal = starts[active] + made[active]  # a new cluster
        fresh = np.ones(len(active), bool)
        if len(some):
            count = made[active[some]]
            slot = ranges(starts[active[some]], count)
            iou = pair_iou(c.box[slot], np.repeat(box[row[some]], count, axis=0))
            best = last_best(iou, np.cumsum(count) - count)
            ok = iou[best] >= least
            goal[some[ok]], fresh[some[ok]] = slot[best[ok]], False
        c.add(goal, box[row], score[row], weight[row])
        made[active[fresh]] += 1
        k += 1
        active = active[size[active] > k]
    slots = ranges(starts, made)
    return c, np.repeat(np.arange(len(starts)), made), slots


def settled(c: Clusters, group: np.ndarray, slots: np.ndarray, least: float) -> np.ndarray:
    """Merge the first overlapping pair of each group (least first, then second cluster) until there is none; returns the slots left."""
    live = np.ones(len(slots), bool)
    look = np.arange(len(slots))
    while len(look):
        i, j, _ = near_pairs(group[look], c.box[slots[look]], group[look], c.box[slots[look]], least)
        i, j = look[i], look[j]
        pair = np.flatnonzero(i < j)
        i, j = i[pair], j[pair]
        first = changes(group[i]) if len(i) else i  # rows are in order of groups, and i is sorted
        i, j = i[first], j[first]
        c.join(slots[i], slots[j])
        live[j] = False
        look = np.flatnonzero(live & np.isin(group, group[i]))
    return live
