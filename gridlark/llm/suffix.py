"""Exact substring dedup: distributed prefix doubling over positions that can repeat.

A byte is removed if it lies in a ``LENGTH``-byte string that also starts earlier (smaller doc_id, or earlier in the
same document).  Strings are told apart by 64- and 128-bit hashes; documents are whole UTF-8 texts.

First, positions that cannot repeat leave.  Inside a task, prefix hashes double from 1 to 32 and 36 bytes; each
``LENGTH``-byte string is represented by the position (anchor) of its least 36-byte prefix hash, so equal strings have
equal anchors, and a string whose anchor content occurs once is unique.  All neighbouring strings with one anchor are a
single row, with a hash of the whole stretch they cover; Spark sorts these rows, and equal stretches are settled, first
occurrence against the rest.

Then the loop, over the positions of the stretches that differ but share an anchor: Spark sorts the pairs (rank of the
prefix, rank of what follows it), positions whose pair is unique leave, the pair is the rank of a prefix twice as long, and
so on until the threshold (36, 72, 100 bytes), where all but the first position of a pair are repetitions.  A rank is the
hash of its content, so that the second of a pair is computed where the text is; a round is one sort of what is still open.

Edge cases: null texts are empty; texts under ``LENGTH`` bytes lose nothing; null doc_ids come first and rows with equal
doc_ids follow the order of their texts (both get a running number instead of their id); an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, partition_id, splitmix, staged, text_chunks, utf8_buffer
from .linededup import Substrings, _BASE, _BYTE

ANCHOR = 36


def _prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``ANCHOR`` bytes that start at each position, by doubling."""

    def power(n: int) -> np.uint64:
        return np.uint64(pow(_BASE, n, 1 << 64))

    one = _BYTE[data]
    two = one[:-1] * power(1) + one[1:]
    four = two[:-2] * power(2) + two[2:]
    eight = four[:-4] * power(4) + four[4:]
    sixteen = eight[:-8] * power(8) + eight[8:]
    thirty_two = sixteen[:-16] * power(16) + sixteen[16:]
    return splitmix(thirty_two[:-4] * power(4) + four[32:])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of string starts with one anchor: anchor's hash, anchor, first and last start."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none
    h = _prefix_hashes(data)
    wide = length - ANCHOR + 1
    v = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal hashes
    m, size = v, 1
    while 2 * size <= wide:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < wide:
        m = np.minimum(m[: len(m) - (wide - size)], m[wide - size :])
    at = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ok = np.zeros(len(at) + 1, np.int32)
    ends = offsets[1:] - length + 1
    full = ends > offsets[:-1]
    np.add.at(ok, offsets[:-1][full], 1)
    np.add.at(ok, ends[full], -1)
    s = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
    if not len(s):
        return none.astype(np.uint64), none, none, none
    a = at[s]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)]))
    last = np.append(first[1:], len(s)) - 1
    return h[a[first]], a[first], s[first], s[last]


def _earliest(keys: tuple[np.ndarray, ...], doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each row is the first of its key by (doc, at)."""
    order = np.lexsort((at, doc, *reversed(keys)))
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), bool)
    out[order] = new
    return out


def _stretches(docs: DataFrame, length: int) -> DataFrame:
    """prefix, stretch (ranks), doc, place (first start, offset of the anchor, further starts), sure (an earlier equal stretch is known)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in text_chunks(batch.column(1), 1 << 21):
                data, offsets = utf8_buffer(batch.column(1).slice(at, to - at))
                prefix, a, lo, hi = anchors(data, offsets, length)
                if not len(lo):
                    continue
                stretch = splitmix(Substrings(data).hash(lo, hi + length) + (a - lo).astype(np.uint64))
                row = np.searchsorted(offsets, lo, side="right") - 1
                doc = np.asarray(batch.column(0).slice(at, to - at))[row]
                start = lo - offsets[row]
                place = (start << 16) | ((a - lo) << 8) | (hi - lo)
                first = _earliest((prefix, stretch), doc, start)
                # a repetition inside the batch is settled: it needs no company, so its key is spread
                prefix = np.where(first, prefix, splitmix(prefix + doc.astype(np.uint64) * np.uint64(_BASE) + place.astype(np.uint64)))
                yield pa.RecordBatch.from_pydict({"prefix": prefix.view(np.int64), "stretch": stretch.view(np.int64), "doc": doc, "place": place, "sure": pa.array(~first)})

    return docs.select("doc", "text").mapInArrow(lean(rows), "prefix long, stretch long, doc long, place long, sure boolean")


def settled_stretches(docs: DataFrame, length: int) -> DataFrame:
    """doc, place, repeats: stretches with an earlier equal one (true) and those that may share strings with a differing one (false)."""
    rows = _stretches(docs, length).repartition("prefix")
    same = Window.partitionBy("prefix", "stretch").orderBy("doc", "place")
    numbered = rows.withColumn("nth", F.when(F.col("sure"), 0).otherwise(F.row_number().over(same)))
    family = numbered.withColumn("differing", F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(Window.partitionBy("prefix")))
    return family.where("nth <> 1 or differing > 1").select("doc", "place", (F.col("nth") != 1).alias("repeats"))


def _pairs(docs: DataFrame, open_: DataFrame, known: int, step: int, last: bool) -> DataFrame:
    """near, far (ranks of ``known`` bytes and of the ``step`` bytes after them), doc, at, sure for every position of the open places.

    ``sure`` rows repeat inside the batch and need no company: in the last round those that are not the first of their pair,
    before it all of a pair.  Only the first row of a batch's pair keeps its key, so copies do not crowd one task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in text_chunks(batch.column(1), 1 << 21):
                data, offsets = utf8_buffer(batch.column(1).slice(at, to - at))
                places = batch.column(2).slice(at, to - at)
                n = np.asarray(places.value_lengths())
                place = np.asarray(places.flatten())
                row = np.repeat(np.arange(to - at), n)
                count = (place & 255) + 1
                start = np.repeat((place >> 16) + offsets[row], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                row = np.repeat(row, count)
                sub = Substrings(data)
                near, far = sub.hash(start, start + known), sub.hash(start + known, start + known + step)
                doc, pos = np.asarray(batch.column(0).slice(at, to - at))[row], start - offsets[row]
                first = _earliest((near, far), doc, pos)
                sure = ~first
                if not last:  # the first of a repeated pair stays as well
                    key = splitmix(near * np.uint64(_BASE) + far)
                    sure |= np.isin(key, key[sure])
                spread = splitmix(near + doc.astype(np.uint64) * np.uint64(_BASE) + pos.astype(np.uint64))
                near = np.where(first, near, spread)
                yield pa.RecordBatch.from_pydict({"near": near.view(np.int64), "far": far.view(np.int64), "doc": doc, "at": pos.astype(np.int32), "sure": pa.array(sure)})

    per_doc = open_.groupBy("doc").agg(F.collect_list("place").alias("places")).withColumnRenamed("doc", "d")
    joined = docs.select("doc", "text").join(per_doc, F.col("doc") == F.col("d")).select("doc", "text", "places")
    return joined.mapInArrow(lean(rows), "near long, far long, doc long, at int, sure boolean").repartition("near", "far")


def repeated_positions(docs: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """doc, at: string starts in open stretches whose string starts earlier elsewhere, by prefix doubling."""
    pair, known = Window.partitionBy("near", "far"), ANCHOR
    while known < length:
        step = min(known, length - known)
        last = known + step == length
        ranked = _pairs(docs, open_, known, step, last)
        known += step
        if not last:
            alive = ranked.withColumn("n", F.count("*").over(pair)).where("n > 1 or sure")
            open_ = staged(alive.select("doc", F.shiftleft(F.col("at").cast("long"), 16).alias("place")), f"open-{known}")
    return ranked.withColumn("nth", F.row_number().over(pair.orderBy("doc", "at"))).where("nth > 1 or sure").select("doc", "at")


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """doc, spans: (first, last) string starts of every repetition, by document."""
    settled = staged(settled_stretches(docs, length), "stretches")
    whole = settled.where("repeats").select("doc", F.shiftright("place", 16).alias("lo"), (F.shiftright("place", 16) + F.col("place").bitwiseAND(255)).alias("hi"))
    single = repeated_positions(docs, settled.where("not repeats").select("doc", "place"), length)
    single = staged(single, "repeats")
    both = whole.unionByName(single.select("doc", F.col("at").alias("lo"), F.col("at").alias("hi")))
    return both.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, doc, text: ``doc`` orders the documents and is unique.  It is doc_id itself wherever that is unique and never null."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    repeats = rows.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if repeats.isEmpty():
        return rows.select("doc_id", F.col("doc_id").alias("doc"), "text")
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = partition_id(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(n, n + batch.num_rows))], names=["doc_id", "text", "part", "nth"])
            n += batch.num_rows

    order = [F.col("doc_id").asc_nulls_first(), F.col("text")]
    placed = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(count, "doc_id long, text string, part int, nth long"), "numbered")
    base, before = 0, []
    for part, n in sorted((r[0], r[1]) for r in placed.groupBy("part").count().collect()):  # one row a partition
        before.append((part, base))
        base += n
    starts = spark.createDataFrame(before, "part int, before long")
    return placed.join(F.broadcast(starts), "part").select("doc_id", (F.col("before") + F.col("nth")).alias("doc"), "text")


def dedup_substrings(docs: DataFrame, length: int = 100, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the remaining bytes where asked for, for every document."""
    docs = numbered(docs)
    spans = repeated_spans(docs, length).withColumnRenamed("doc", "d")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in text_chunks(batch.column(1), 1 << 20):
                data, offsets = utf8_buffer(batch.column(1).slice(at, to - at))
                found = batch.column(2).slice(at, to - at)
                n = np.asarray(found.value_lengths().fill_null(0))
                flat = found.flatten()
                row = np.repeat(np.arange(to - at), n)
                change = np.zeros(len(data) + 1, np.int64)
                if len(row):
                    np.add.at(change, np.asarray(flat.field("lo")) + offsets[row], 1)
                    np.add.at(change, np.asarray(flat.field("hi")) + offsets[row] + length, -1)
                gone = np.cumsum(change[:-1]) > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                edge = offsets[:-1][np.diff(offsets) > 0]
                begins[edge] = gone[edge]  # runs never cross documents
                n_removed, n_spans = (np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]) for x in (gone, begins))
                kept = data[~gone].tobytes()
                ends = np.cumsum(np.diff(offsets) - n_removed)
                parts = [kept[b:e] for b, e in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)]
                cols = {
                    "doc_id": batch.column(0).slice(at, to - at),
                    "n_bytes": np.diff(offsets),
                    "n_removed": n_removed,
                    "n_spans": n_spans,
                    "kept_sha256": [hashlib.sha256(p).hexdigest() for p in parts],
                }
                if with_text:
                    cols["kept"] = pa.array(parts, pa.binary())
                yield pa.RecordBatch.from_pydict(cols)

    joined = docs.join(spans, F.col("doc") == F.col("d"), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(lean(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
