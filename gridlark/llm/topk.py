"""Exact top-k by inner product with a bit-sliced index.

Every attribute of a block of rows is stored as bit slices: bitmap b of attribute d says which rows have bit b of the
quantised value set.  A query's score is the sum of its coefficients times the attributes; it is computed for all rows
of a block at once by adding slices with bitmap arithmetic (carry-save adders over 64 rows a word).  A negative
coefficient adds the complemented slices instead, so all sums are of non-negative numbers.  The top rows are then
selected from the most significant slice of the sum downward; the rows still tied when all slices are used are the
boundary, resolved exactly by the smaller id.

Query blocks meet index blocks in one sort: the rows of an index block and of a group of query blocks go to one place, the
index block first, so every (block, group) is a piece of work of its own and a task holds one index block and one query block.

Sums have as many slices as they need, so selection is exact for all components whose quantised value is under 2^62.

Edge cases: vectors that are null, empty, hold null or non-finite components or have a null id take no part, and neither
do those whose length is not the commonest of the whole table (of equally common ones the shortest), as they have no inner
product with the others; a larger component or a score beyond 64 bits is an error that says so; with fewer than k candidates
all are returned; equal rows tie by id; rows that repeat a query's id are not its candidates, and a repeated query row is
answered once per row (``query_row`` tells them apart); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, partition_id, staged

INDEX = "block long, ids binary, low binary, bits int, slices binary"
QUERIES = "query_block long, ids binary, coefficients binary"


LARGEST = float(1 << 62)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float = 256.0, query_filter: Column | None = None) -> DataFrame:
    """``id``, ``q`` (each component as floor(scale * x)) and ``asks`` of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite
    too_large = F.raise_error(F.lit(f"a component times {scale:g} is beyond 2^62"))
    q = F.transform(v, lambda x: F.when(F.abs(x * scale) < LARGEST, F.floor(x * scale)).otherwise(too_large.cast("bigint")))
    asks = F.coalesce(query_filter, F.lit(False)) if query_filter is not None else F.lit(False)
    rows = vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), q.alias("q"), asks.alias("asks"))
    width = vectors.where(usable).groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("q") == (width[0][0] if width else 0))


def _matrix(col: pa.Array) -> np.ndarray:
    flat = np.asarray(col.flatten(), dtype=np.int64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def build_index(rows: DataFrame, block_rows: int = 32768) -> DataFrame:
    """Bit slices of every row, one block a row of the table."""

    def slice_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = partition_id(), 0
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            batch = table.to_batches()[0]
            v, ids = _matrix(batch.column("q")), np.asarray(batch.column("id"), dtype=np.int64)
            low = v.min(axis=0)
            z = v.astype(np.uint64) - low.astype(np.uint64)
            bits = max(1, int(z.max()).bit_length())
            words = -(-len(ids) // 64)
            slices = np.zeros((v.shape[1], bits, words), "<u8")
            for b in range(bits):
                on = np.zeros((v.shape[1], words * 64), np.uint8)
                on[:, : len(ids)] = (z >> np.uint64(b)).T.astype(np.uint8) & 1
                slices[:, b] = np.packbits(on, axis=1, bitorder="little").view("<u8")
            return pa.RecordBatch.from_pydict(
                {"block": [(part << 32) + n], "ids": [ids.tobytes()], "low": [low.tobytes()], "bits": pa.array([bits], pa.int32()), "slices": pa.array([slices.tobytes()], pa.binary())}
            )

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(batch.num_rows - at, block_rows - sum(b.num_rows for b in held))
                held.append(batch.slice(at, take))
                at += take
                if sum(b.num_rows for b in held) == block_rows:
                    yield flush()
                    held, n = [], n + 1
        if held:
            yield flush()

    return rows.select("id", "q").mapInArrow(lean(slice_up), INDEX)


def query_blocks(rows: DataFrame, block_rows: int = 256) -> DataFrame:
    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = partition_id(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                b = batch.slice(at, block_rows)
                yield pa.RecordBatch.from_pydict({"query_block": [(part << 32) + n], "ids": [np.asarray(b.column("id"), dtype=np.int64).tobytes()], "coefficients": [_matrix(b.column("q")).tobytes()]})
                n += 1

    return rows.select("id", "q").mapInArrow(lean(group), QUERIES)


def weighted_sum(slices: np.ndarray, coefficients: np.ndarray) -> list[np.ndarray]:
    """Slices of the sum over attributes of |c| * (c < 0 ? ~z : z), least significant first; ``slices`` is [attribute, bit, word]."""
    bits = slices.shape[1]
    levels: dict[int, list[np.ndarray]] = {}
    sign = np.where(coefficients < 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    size = np.abs(coefficients)
    for j in range(int(size.max()).bit_length() if len(size) else 0):
        d = np.flatnonzero(size >> j & 1)
        if len(d):
            for b in range(bits):
                levels.setdefault(b + j, []).append(slices[d, b] ^ sign[d, None])
    out, t = [], 0
    while levels:
        have = levels.pop(t, [])
        x = np.concatenate(have) if have else np.zeros((0, slices.shape[2]), np.uint64)
        while len(x) > 1:
            m = len(x) // 3
            if m:
                a, b, c = x[0 : 3 * m : 3], x[1 : 3 * m : 3], x[2 : 3 * m : 3]
                ab = a ^ b
                carry, rest = (a & b) | (ab & c), [ab ^ c, x[3 * m :]]
            else:
                carry, rest = x[:1] & x[1:2], [x[:1] ^ x[1:2]]
            levels.setdefault(t + 1, []).append(carry)
            x = np.concatenate(rest)
        out.append(x[0] if len(x) else np.zeros(slices.shape[2], np.uint64))
        t += 1
    return out


def select_top(total: list[np.ndarray], valid: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest sums, from the most significant slice downward; boundary ties go to the smaller id."""
    sure, open_ = np.zeros_like(valid), valid.copy()
    for s in reversed(total):
        with_bit = open_ & s
        n = int(np.bitwise_count(sure | with_bit).sum())
        if n > k:
            open_ = with_bit
        else:
            sure, open_ = sure | with_bit, open_ & ~s
            if n == k:
                open_ = np.zeros_like(open_)
                break
    rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    edge = np.flatnonzero(np.unpackbits(open_.view(np.uint8), bitorder="little"))
    need = k - len(rows)
    if need > 0 and len(edge):
        rows = np.append(rows, edge[np.lexsort((edge, ids[edge]))[:need]])
    return rows


class Block:
    """One index block, ready to answer queries."""

    def __init__(self, ids: bytes, low: bytes, bits: int, slices: bytes):
        self.rows, self.low, self.bits = np.frombuffer(ids, np.int64), np.frombuffer(low, np.int64), bits
        words = -(-len(self.rows) // 64)
        self.slices = np.frombuffer(slices, "<u8").reshape(len(self.low), bits, words)
        self.order = np.argsort(self.rows, kind="stable")
        self.by_id = self.rows[self.order]
        self.everyone = np.zeros(words * 64, np.uint8)
        self.everyone[: len(self.rows)] = 1

    def search(self, own: int, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best rows for the coefficients of one query."""
        valid = self.everyone.copy()
        valid[self.order[np.searchsorted(self.by_id, own) : np.searchsorted(self.by_id, own, side="right")]] = 0
        total = weighted_sum(self.slices, c)
        found = select_top(total, np.packbits(valid, bitorder="little").view("<u8"), self.rows, k)
        each = [int(x) for x in c.tolist()]
        base = sum(x * y for x, y in zip(each, self.low.tolist(), strict=True)) + ((1 << self.bits) - 1) * sum(x for x in each if x < 0)
        bit = np.array([(s[found >> 6] >> (found & 63).astype(np.uint64)) & np.uint64(1) for s in total], np.uint64).reshape(len(total), len(found))
        scores = [base + sum(1 << b for b in np.flatnonzero(column).tolist()) for column in bit.T]
        if any(abs(x) >= 1 << 63 for x in scores):
            raise OverflowError("a score does not fit 64 bits")
        return self.rows[found], np.array(scores, np.int64)


GROUP = 64  # query blocks


def top_k(index: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, query_row, rank, id, score for every query row; ``index`` and ``queries`` are written tables."""
    group = F.shiftright("query_block", GROUP.bit_length() - 1)
    blocks = [r[0] for r in index.select("block").collect()]  # one number per 32,768 rows
    groups = [r[0] for r in queries.select(group).distinct().collect()]  # one per 16,384 queries of a partition
    asked = queries.select(F.explode(F.lit(blocks).cast("array<long>")).alias("block"), group.alias("group"), F.lit(1).alias("kind"), "query_block", "ids", F.col("coefficients").alias("numbers"), F.lit(None).cast("int").alias("bits"), F.lit(None).cast("binary").alias("slices"))
    offered = index.select("block", F.explode(F.lit(groups).cast("array<long>")).alias("group"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("query_block"), "ids", F.col("low").alias("numbers"), "bits", "slices")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for kind, query_block, ids, numbers, bits, slices in zip(*(batch.column(c) for c in ("kind", "query_block", "ids", "numbers", "bits", "slices")), strict=True):
                if kind.as_py() == 0:
                    block = Block(ids.as_py(), numbers.as_py(), bits.as_py(), slices.as_py())
                    continue
                own = np.frombuffer(ids.as_py(), np.int64)
                c = np.frombuffer(numbers.as_py(), np.int64).reshape(len(own), -1)
                got = [block.search(i, x, k) for i, x in zip(own.tolist(), c, strict=True)]
                n = [len(g[0]) for g in got]
                yield pa.RecordBatch.from_pydict(
                    {
                        "query_id": np.repeat(own, n),
                        "query_row": np.repeat((query_block.as_py() << 12) + np.arange(len(own)), n),
                        "id": np.concatenate([g[0] for g in got]),
                        "score": np.concatenate([g[1] for g in got]),
                    }
                )

    together = offered.unionByName(asked).repartition("block", "group").sortWithinPartitions("block", "group", "kind")
    found = together.mapInArrow(lean(search), "query_id long, query_row long, id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "query_row", "rank", "id", "score")


def search_vectors(vectors: DataFrame, query_filter: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0) -> DataFrame:
    """Rows for which ``query_filter`` holds, as queries against all other rows."""
    rows = quantised(vectors, id_col, vector_col, scale, query_filter)
    index = staged(build_index(rows), "slices")
    queries = staged(query_blocks(rows.where("asks")), "queries")
    return top_k(index, queries, k)
