"""Best-fit packing of documents into sequences of a fixed length.

A configuration linear program over the length histogram (at most ``capacity`` rows, whatever the input) is solved by
multiplicative weights: knapsack dynamic programming prices the configuration that is worth most under the weights,
it is used for a small part of the demand, and the weights of the lengths that it holds shrink.  The fractional
solution is rounded down; slots are filled with true lengths, and what is left goes to the tightest sequence with
room (best fit), longest first, or opens a new one.  All of it works on (length, count) pairs, so the plan's size
does not depend on the number of documents.  Spark then gives every piece its rank among the pieces of its length
and looks its place up in the plan.

Edge cases: a null or empty text is one end id; null ``doc_id`` and repeated rows are packed as they come; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import lean, partition_id, staged, text_chunks, texts_of

PIECES = "part int, doc_id long, piece int, start long, length long, ids_crc32 long, rank_in_part long"


def tokenized_pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids.  Only longer documents are cut, and then the first piece is the short one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = bpe.encoder(tokenizer), partition_id()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            text = batch.column("text")
            for at, to in text_chunks(text):
                ids, offsets = enc.encode(texts_of(text, at, to), end_id)
                n = np.diff(offsets)
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(to - at), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = n - (pieces - 1) * capacity
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                begin = offsets[doc] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                sorted_len = length[order]
                rank = np.empty(len(doc), np.int64)
                first = np.searchsorted(sorted_len, sorted_len)
                rank[order] = np.arange(len(doc)) - first + seen[sorted_len]
                seen += np.bincount(length, minlength=capacity + 1)
                cols = {
                    "part": pa.array(np.full(len(doc), part, np.int32)),
                    "doc_id": batch.column("doc_id").slice(at, to - at).take(pa.array(doc)),
                    "piece": piece.astype(np.int32),
                    "start": start,
                    "length": length,
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "rank_in_part": rank,
                }
                if with_ids:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(cols)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(cut), PIECES + ", ids array<int>" * with_ids)


def _classes(count: np.ndarray, capacity: int, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths grouped so that each group holds a like share of all tokens; upper ends and items of each group."""
    lengths = np.flatnonzero(count)
    mass = np.cumsum(lengths * count[lengths])
    group = np.minimum((mass - 1) * n_classes // mass[-1], n_classes - 1)
    ends = lengths[np.append(np.flatnonzero(np.diff(group)), len(lengths) - 1)]
    items = np.add.reduceat(count, np.concatenate([[0], ends[:-1] + 1]))[: len(ends)]
    return ends, items


def _price(size: np.ndarray, worth: np.ndarray, units: int) -> dict[int, int]:
    """Unbounded knapsack: the multiset of classes that is worth most and fits ``units``.  ``size`` ascends."""
    best, took = np.zeros(units + 1), np.full(units + 1, -1)
    upto = np.searchsorted(size, np.arange(units + 1), side="right")
    for c in range(1, units + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            value = worth[:k] + best[c - size[:k]]
            j = int(value.argmax())
            if value[j] > best[c]:
                best[c], took[c] = value[j], j
    out: dict[int, int] = defaultdict(int)
    c = units
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            out[int(took[c])] += 1
            c -= size[took[c]]
    return dict(out)


def solve_lp(count: np.ndarray, capacity: int, n_classes: int = 256, unit: int | None = None, step: float = 0.08, eta: float = 4.0) -> tuple[np.ndarray, list[tuple[dict[int, int], float]]]:
    """Fractional cover of the histogram by configurations.  Returns the upper ends of the length classes and (configuration, amount) pairs."""
    unit = unit or max(1, capacity // 512)
    ends, need = _classes(count, capacity, n_classes)
    size = -(-ends // unit)
    units = capacity // unit
    size = np.minimum(size, units)
    covered = np.zeros(len(ends))
    amounts: dict[tuple, float] = defaultdict(float)
    while covered.min() < 1:
        open_ = np.maximum(0.0, 1.0 - covered)
        worth = np.where(open_ > 0, np.exp(-eta * covered), 0.0) * ends
        config = _price(size, worth, units)
        if not config:
            break
        amount = min(need[k] / a * min(step, max(open_[k], 1e-9)) for k, a in config.items())
        amounts[tuple(sorted(config.items()))] += amount
        for k, a in config.items():
            covered[k] += a * amount / need[k]
        covered[covered > 1 - 1e-9] = 1.0
    return ends, [(dict(c), x) for c, x in amounts.items()]


def plan(count: np.ndarray, capacity: int = 2048, free_slots: int = 2, share: float = 0.9, **options) -> dict[str, np.ndarray]:
    """Where the r-th piece of each length goes: rows (length, first rank, sequence base, pieces a sequence, offset), sorted by length and rank.

    ``count[l]`` is the number of pieces of length l.
    """
    count = np.asarray(count, np.int64).copy()
    bins: list[list] = []  # [multiplicity, [(length, pieces)], room]
    if count[capacity]:
        bins.append([int(count[capacity]), [(capacity, 1)], 0])
        count[capacity] = 0
    if count.any():
        ends, configs = solve_lp(count, capacity, **options)
        low = np.concatenate([[0], ends[:-1]])
        pointer = ends.copy()  # the longest length of the class that still has pieces

        for config, amount in sorted(configs, key=lambda c: -c[1]):
            parts = [[int(share * amount + 1e-9), [], capacity]]
            slots = sorted((k for k, a in config.items() for _ in range(a)), reverse=True)
            for k in slots[: max(1, len(slots) - free_slots)]:
                parts = _fill_slot(parts, count, pointer, int(low[k]), k)
            bins += [p for p in parts if p[0] and p[1]]
        _best_fit(bins, count, capacity)
    return _lookup(bins)


def _fill_slot(parts: list[list], count: np.ndarray, pointer: np.ndarray, low: int, k: int) -> list[list]:
    """One piece of class ``k`` into each sequence; a part is split where the length changes."""
    out = []
    for n, held, room in parts:
        while n:
            while pointer[k] > low and count[pointer[k]] == 0:
                pointer[k] -= 1
            length = int(pointer[k])
            if length <= low or length > room:
                out.append([n, held, room])
                break
            m = min(n, int(count[length]))
            count[length] -= m
            out.append([m, [*held, (length, 1)], room - length])
            n -= m
    return out


def _best_fit(bins: list[list], count: np.ndarray, capacity: int) -> None:
    """What is left, longest first: each into the tightest sequence with room, or a new one."""
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = np.zeros(capacity + 1, bool)
    for i, b in enumerate(bins):
        if b[2]:
            by_room[b[2]].append(i)
            rooms[b[2]] = True
    for length in range(capacity, 0, -1):
        left = int(count[length])
        while left:
            fits = np.flatnonzero(rooms[length:])
            if not len(fits):
                bins.append([-(-left // (capacity // length)), [], capacity])
                by_room[capacity].append(len(bins) - 1)
                rooms[capacity] = True
                continue
            room = int(fits[0]) + length
            i = by_room[room].pop()
            rooms[room] = bool(by_room[room])
            n, held, _ = bins[i]
            fit = min(room // length, max(1, left // n))  # so many in each at once
            m = min(n, left // fit)
            if m < n:
                bins.append([n - m, list(held), room])
                by_room[room].append(len(bins) - 1)
                rooms[room] = True
            bins[i] = [m, [*held, (length, fit)], room - fit * length]
            left -= m * fit
            if bins[i][2]:
                by_room[bins[i][2]].append(i)
                rooms[bins[i][2]] = True
        count[length] = 0


def _lookup(bins: list[list]) -> dict[str, np.ndarray]:
    rows, used, base = [], defaultdict(int), 0
    for n, held, _ in bins:
        offset = 0
        for length, a in held:
            rows.append((length, used[length], base, a, offset))
            used[length] += n * a
            offset += length * a
        base += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"length": table[:, 0], "rank": table[:, 1], "base": table[:, 2], "each": table[:, 3], "offset": table[:, 4], "n_sequences": base}


def pack_pieces(pieces: DataFrame, capacity: int = 2048, **options) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to written pieces (``part``, ``length``, ``rank_in_part`` as from ``tokenized_pieces``)."""
    spark = pieces.sparkSession
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_base"))
    count = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        count[length] = n
    table = spark.sparkContext.broadcast(plan(count, capacity, **options))  # bounded by lengths and configurations
    names = [c for c in pieces.columns if c not in ("part", "rank_in_part")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        key = (t["length"] << 44) | t["rank"]
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            i = np.searchsorted(key, (length << 44) | rank, side="right") - 1
            at = rank - t["rank"][i]
            seq = t["base"][i] + at // t["each"][i]
            offset = t["offset"][i] + at % t["each"][i] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = pieces.select(*names).schema.add("sequence_id", "long").add("offset", "long")
    ranked = pieces.join(bases, ["part", "length"]).select(*names, (F.col("rank_base") + F.col("rank_in_part")).alias("rank"))
    return ranked.mapInArrow(lean(place), schema)


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Every document as pieces with their sequence and place in it."""
    return pack_pieces(staged(tokenized_pieces(docs, capacity, tokenizer, end_id, with_ids), "pieces"), capacity)
