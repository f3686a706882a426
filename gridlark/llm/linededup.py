"""Line dedup by a segment-partition edit join.

A line is dropped if the input has an earlier line (smaller doc_id, or earlier in the same document) that is equal to it
or near it: at most one edit of UTF-8 bytes apart for each ``bytes_per_edit`` bytes of the shorter one, and never more than
``threshold``.  With the usual 20 bytes and two edits, a line of 20 to 39 bytes can have one edit, a longer one two; under
20 bytes lines must be equal, since two edits make another word of a short one.  Blank lines always stay.

Lines are known by 64 bits of a 128-bit hash of their bytes.  The other 64 bits, kept beside them, tell if two different
lines of the input ever share a key; if so all begins again with another seed.

Distinct lines are split into ``threshold + 1`` segments; a line within the threshold shares one of them.  Each line is
an index row for each of its segments and probes, for every shorter or equal length in reach, the few substrings that
the position filter leaves (multi-match-aware selection).  Both meet on (length, segment number, substring hash); lines of
crowded hashes meet by their content (see ``near_lines``).  The pairs are verified by bit-parallel edit distance
inside the band of ``threshold`` diagonals.

Edge cases: null texts have no lines; null doc_ids sort first; repeated rows with the same doc_id and text share one
decision (the first row's lines and the others' are equally early, so they all stay or all go); of rows with one doc_id
and different texts the order is that of a hash of the text; very long lines are compared whole; an empty table gives no
rows; other columns pass through ``deduplicated`` unharmed, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import bytes_buffer, free_name, lean, named, splitmix, staged, text_chunks, utf8_buffer

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = splitmix(np.arange(1, 257, dtype=np.uint64))
BROADCAST_ROWS = 400_000
#: A segment hash is crowded beyond so many pairs of rows.
CROWDED = 64
ODD = ("odd0", "odd1", "odd2", "odd3")


def doc_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


class Substrings:
    """Hash of any byte range of a buffer in constant time: differences of prefix sums, shifted to a common origin."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers(_BASE, n), out=self.sums[1:])
        self.shift = _powers(_INVERSE, n + 1)

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return splitmix((self.sums[stop] - self.sums[start]) * self.shift[start] + (stop - start).astype(np.uint64))


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, line number, start and stop of every line of every row."""
    cut = np.flatnonzero(data == 10)
    doc_of = np.searchsorted(offsets, cut, side="right") - 1
    n_lines = np.bincount(doc_of, minlength=len(offsets) - 1) + 1
    doc = np.repeat(np.arange(len(offsets) - 1), n_lines)
    first = np.cumsum(n_lines) - n_lines
    number = np.arange(len(doc)) - first[doc]
    start, stop = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
    start[first], stop[first + n_lines - 1] = offsets[:-1], offsets[1:]
    inner = np.ones(len(doc), bool)
    inner[first] = False
    start[inner] = cut + 1
    inner[:] = True
    inner[first + n_lines - 1] = False
    stop[inner] = cut
    return doc, number, start, stop


def _whole_keys(data: np.ndarray, start: np.ndarray, stop: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of each line, and the other half of its hash."""
    raw, low = memoryview(data.tobytes()), (1 << 64) - 1
    both = [xxhash.xxh3_128_intdigest(raw[a:b], seed) for a, b in zip(start.tolist(), stop.tolist())]
    return np.array([x & low for x in both], np.uint64).view(np.int64), np.array([x >> 64 for x in both], np.uint64).view(np.int64)


def line_keys(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, doc_key, line_no, line_key (null for blank lines), line_check of every line."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            present = batch.filter(batch.column(2).is_valid())
            for at, to in text_chunks(present.column(2)):
                data, offsets = utf8_buffer(present.column(2).slice(at, to - at))
                doc, number, start, stop = _lines(data, offsets)
                dark = np.concatenate([[0], np.cumsum((data != 32) & (data != 9) & (data != 13))])
                blank = dark[start] == dark[stop]
                key, check = _whole_keys(data, start, stop, seed)
                row = pa.array(doc + at)
                yield pa.RecordBatch.from_arrays(
                    [present.column(0).take(row), present.column(1).take(row), pa.array(number.astype(np.int32)), pa.array(key, mask=blank), pa.array(check, mask=blank)], names=["doc_id", "doc_key", "line_no", "line_key", "line_check"]
                )

    return docs.select(F.col("doc_id").cast("long"), doc_key().alias("k"), F.col("text").cast("string")).mapInArrow(lean(split), "doc_id long, doc_key long, line_no int, line_key long, line_check long")


def probe_plan(threshold: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) of every probe: the substring starts at the segment's start plus the shift."""
    out = []
    for gap in range(threshold + 1):
        for i in range(threshold + 1):
            low, high = max(-i, gap - (threshold - i)), min(i, gap + (threshold - i))
            out += [(gap, i, s) for s in range(low, high + 1)]
    return out


def segment(length: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment ``i`` of lines of a length: sizes differ by one at most, longer ones last."""
    size = length // parts
    extra = length - size * parts
    return i * size + np.maximum(0, i - (parts - extra)), size + (i >= parts - extra)


def _near_candidates(batch: pa.RecordBatch, bytes_per_edit: int, seed: int) -> Iterator[tuple[Substrings, np.ndarray, np.ndarray, np.ndarray]]:
    """Substring hashes, keys, starts and lengths of the distinct long lines of a batch of texts, chunk by chunk."""
    for at, to in text_chunks(batch.column(0)):
        data, offsets = utf8_buffer(batch.column(0).slice(at, to - at))
        _, _, start, stop = _lines(data, offsets)
        ok = stop - start >= bytes_per_edit
        start, stop = start[ok], stop[ok]
        if len(start):
            sub = Substrings(data)
            key, one = np.unique(_whole_keys(data, start, stop, seed)[0], return_index=True)
            yield sub, key, start[one], (stop - start)[one]


def segment_keys(docs: DataFrame, threshold: int, bytes_per_edit: int, wanted: np.ndarray | None = None, seed: int = 0) -> DataFrame:
    """key, line_key, probe: what a line offers (its segments) and looks for (substrings), once for each distinct line of
    a batch.  ``wanted`` (sorted) leaves other keys out."""
    parts = threshold + 1
    plan = [(False, 0, i, 0) for i in range(parts)] + [(True, *x) for x in probe_plan(threshold)]
    known = docs.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sub, key, start, length in _near_candidates(batch, bytes_per_edit, seed):
                for probe, gap, i, shift in plan:
                    other = length - gap
                    p, size = segment(other, i, parts)
                    p = p + shift
                    ok = (other >= bytes_per_edit) & (p >= 0) & (p + size <= length)
                    h = sub.hash((start + p)[ok], (start + p + size)[ok])
                    h = splitmix(h + (other[ok] * parts + i).astype(np.uint64) * np.uint64(_BASE)).view(np.int64)
                    line = key[ok]
                    if known is not None:
                        among = known.value[np.minimum(np.searchsorted(known.value, h), len(known.value) - 1)] == h
                        h, line = h[among], line[among]
                    if len(h):
                        yield pa.RecordBatch.from_pydict({"key": h, "line_key": line, "probe": np.full(len(h), probe)})

    return docs.select(F.col("text").cast("string")).mapInArrow(lean(cut), "key long, line_key long, probe boolean")


def content_keys(lines: DataFrame, threshold: int) -> DataFrame:
    """key, line_key, n_bytes, odd0 .. odd3: what a line (line_key, line) holds, blind to places.

    An edit takes away or adds four byte pairs at most.  Byte pairs are dealt to ``4 * threshold + 1`` classes, so two
    lines within the threshold have the same pairs in one class at least: ``key``, a hash for each class.  The 256 bits
    of ``odd`` tell which of as many buckets hold an odd number of byte pairs; such lines differ in ``4 * threshold``."""
    classes = 4 * threshold + 1
    value = splitmix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))
    class_of = (splitmix(value + np.uint64(_BASE)) % np.uint64(classes)).astype(np.int16)
    salt = [np.uint64((c + 1) * _BASE & 0xFFFFFFFFFFFFFFFF) for c in range(classes)]
    bit = np.uint64(1) << (value & np.uint64(63))
    word_of = (value >> np.uint64(6)) & np.uint64(3)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in text_chunks(batch.column(1)):
                data, offsets = bytes_buffer(batch.column(1).slice(at, to - at))
                start, stop = offsets[:-1], offsets[1:]
                pair = data[:-1].astype(np.int64) * 256 + data[1:]
                worth, kind, last = value[pair], class_of[pair], np.maximum(stop - 1, start)
                odd = []
                for w in range(4):
                    total = np.zeros(len(data) + 1, np.uint64)
                    np.bitwise_xor.accumulate(np.where(word_of[pair] == w, bit[pair], np.uint64(0)), out=total[1 : len(pair) + 1])
                    odd.append(pa.array((total[last] ^ total[start]).view(np.int64)))
                for c in range(classes):
                    total = np.zeros(len(data) + 1, np.uint64)
                    np.cumsum(np.where(kind == c, worth, np.uint64(0)), out=total[1 : len(pair) + 1])
                    h = splitmix(total[last] - total[start] + salt[c])
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).slice(at, to - at), pa.array(stop - start, pa.int64()), *odd], names=["key", "line_key", "n_bytes", *ODD])

    return lines.select("line_key", F.col("line").cast("binary").alias("line")).mapInArrow(lean(cut), "key long, line_key long, n_bytes long, odd0 long, odd1 long, odd2 long, odd3 long")


def _like(left: str, right: str, threshold: int) -> Column:
    """Lines of like length that hold almost the same byte pairs."""
    apart = reduce(add, (F.bit_count(F.col(f"{left}.{c}").bitwiseXOR(F.col(f"{right}.{c}"))) for c in ODD))
    return (F.abs(F.col(f"{left}.n_bytes") - F.col(f"{right}.n_bytes")) <= threshold) & (apart <= 4 * threshold)


def _crowded_neighbours(lines: DataFrame, threshold: int, verified: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Verified pairs (a, b) of the lines (line_key, line, first), one with an earlier line at least for each line that has any.

    A line meets the earliest line of each of its content keys first.  In a group of near copies that settles almost all;
    only the others meet all earlier lines of their keys."""
    rows = staged(content_keys(lines, threshold).join(lines.select("line_key", "first"), "line_key"), "contents")
    oldest = rows.groupBy("key").agg(F.min(F.struct("first", "line_key", "n_bytes", *ODD)).alias("r"))
    ends = [F.col("l.line_key").alias("a"), F.col("r.line_key").alias("b")]
    to_oldest = rows.alias("l").join(oldest, "key").where((F.col("l.line_key") != F.col("r.line_key")) & _like("l", "r", threshold)).select(*ends)
    once = staged(verified(to_oldest.distinct()), "first-neighbours")
    open_ = rows.join(once.select(F.col("a").alias("line_key")).distinct(), "line_key", "left_anti").alias("l")
    earlier = (F.col("l.key") == F.col("r.key")) & (F.col("r.first") < F.col("l.first")) & _like("l", "r", threshold)
    return once.unionByName(verified(open_.join(rows.alias("r"), earlier).select(*ends).distinct()))


def _met(rows: DataFrame) -> DataFrame:
    """Pairs of lines of which one offers what the other looks for."""
    offer, probe = rows.where("not probe").select("key", F.col("line_key").alias("s")), rows.where("probe").select("key", F.col("line_key").alias("r"))
    return offer.join(probe, "key").where("s <> r").select(F.least("s", "r").alias("a"), F.greatest("s", "r").alias("b"))


def within(pairs: list[tuple[bytes, bytes]], k: int) -> np.ndarray:
    """Whether each pair is within ``k`` edits: bit-parallel columns of the 2k+1 diagonals around the main one, all pairs at once."""
    n = len(pairs)
    if not n:
        return np.zeros(0, bool)
    len1, len2 = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    if k == 0:
        return np.array([a == b for a, b in pairs])
    wide = int(max(len1.max(), len2.max())) + 2 * k + 2
    one, two = np.full((wide, n), -1, np.int16), np.full((wide, n), -2, np.int16)
    for j, (a, b) in enumerate(pairs):
        one[k : k + len(a), j] = np.frombuffer(a, np.uint8)
        two[: len(b), j] = np.frombuffer(b, np.uint8)
    u = np.uint64
    full, top, below = u(0xFFFFFFFFFFFFFFFF), u(63), u(1)
    vp, vn = np.full(n, (0xFFFFFFFFFFFFFFFF << (63 - k)) & 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(n, np.uint64)
    dist = np.full(n, k, np.int64)
    across = np.full(n, 62, np.int64)
    for i in range(int(len2.max())):
        match = np.zeros(n, np.uint64)
        for b in range(2 * k + 1):  # bit 63 - b stands for place i + k - b of the first string
            match |= (one[i + 2 * k - b] == two[i]).astype(np.uint64) << u(63 - b)
        d0 = (((match & vp) + vp) ^ vp) | match | vn
        hp, hn = vn | (full ^ (d0 | vp)), d0 & vp
        live, diagonal = i < len2, i < len1 - k
        dist += np.where(live & diagonal, 1 - (d0 >> top).astype(np.int64), 0)
        a = np.maximum(across, 0).astype(np.uint64)
        turn = live & ~diagonal
        dist += np.where(turn, (hp >> a & below).astype(np.int64) - (hn >> a & below).astype(np.int64), 0)
        across -= turn
        d1 = d0 >> below
        vp, vn = hn | (full ^ (d1 | hp)), d1 & hp
    ok = (dist <= k) & (np.abs(len1 - len2) <= k)
    for j in np.flatnonzero(np.minimum(len1, len2) <= 2 * k):  # shorter than the band: the plain table
        ok[j] = _distance(*pairs[j]) <= k
    return ok


def _distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near_lines(docs: DataFrame, first: DataFrame, threshold: int, bytes_per_edit: int, seed: int = 0) -> DataFrame:
    """Pairs (a, b) of line keys of distinct lines within their allowed edits: for every line that is near an earlier one
    (``first``: line_key, first), one such pair at least.

    Segment hashes are counted before any pair is made.  A hash that one line offers and one other looks for gives their
    pair; a hash of a few lines gives theirs by a join.  Lines that meet in a crowded hash (near copies by the thousand,
    whose edits lie elsewhere) meet again by what they hold instead (``content_keys``)."""
    rows = segment_keys(docs, threshold, bytes_per_edit, seed=seed)
    offered, asked = F.when(~F.col("probe"), F.col("line_key")), F.when(F.col("probe"), F.col("line_key"))
    found = rows.groupBy("key").agg(F.min(offered).alias("s"), F.max(offered).alias("s2"), F.min(asked).alias("r"), F.max(asked).alias("r2"), F.count(offered).alias("n_s"), F.count(asked).alias("n_r"))
    found = staged(found.where("s is not null and r is not null and (s <> r or s <> s2 or r <> r2)"), "shared-keys")
    alone = F.expr("s = s2 and r = r2")
    single = found.where(alone).select(F.least("s", "r").alias("a"), F.greatest("s", "r").alias("b"))
    multi = found.where(~alone).select("key", (F.col("n_s") * F.col("n_r") > CROWDED).alias("crowded"))
    n = multi.count()
    if n <= BROADCAST_ROWS:
        wanted = np.sort(np.array([r[0] for r in multi.select("key").collect()], np.int64))
        shared = segment_keys(docs, threshold, bytes_per_edit, wanted, seed) if n else rows.limit(0)
    else:
        shared = rows
    shared = staged(shared.join(multi, "key").distinct(), "shared-segments")
    crowd = shared.where("crowded").select("line_key").distinct()
    plain = single.unionByName(_met(shared.where("not crowded"))).distinct()
    plain = staged(plain, "plain-pairs")
    ends = plain.select(F.col("a").alias("line_key")).unionByName(plain.select(F.col("b").alias("line_key")))
    used = staged(ends.unionByName(crowd).distinct(), "line-keys")
    texts = staged(_texts_of(docs, used, bytes_per_edit, seed), "line-texts")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            order = sorted(range(len(x)), key=lambda i: len(x[i]))
            ok = np.zeros(len(x), bool)
            at = 0
            while at < len(order):  # pairs of like length together, in bounded memory
                to = min(at + max(1, (8 << 20) // (len(x[order[min(at + 2000, len(order) - 1)]]) + 64)), at + 2000, len(order))
                some = order[at:to]
                shorter = np.array([min(len(x[i]), len(y[i])) for i in some])
                edits = np.minimum(shorter // bytes_per_edit, threshold)
                for k in np.unique(edits):
                    rows = np.array(some)[edits == k]
                    ok[rows] = within([(x[i], y[i]) for i in rows], int(k))
                at = to
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))

    def verified(met: DataFrame) -> DataFrame:
        both = met.join(texts.select(F.col("line_key").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("line_key").alias("b"), F.col("line").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(lean(verify), "a long, b long")

    return verified(plain).unionByName(_crowded_neighbours(texts.join(crowd, "line_key").join(first, "line_key"), threshold, verified))


def _texts_of(docs: DataFrame, used: DataFrame, bytes_per_edit: int, seed: int) -> DataFrame:
    """The bytes of the lines with the given keys, once each.  A small set of keys goes to all tasks, a large one is joined."""

    def every(batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in text_chunks(batch.column(0)):
                data, offsets = utf8_buffer(batch.column(0).slice(at, to - at))
                _, _, start, stop = _lines(data, offsets)
                ok = stop - start >= bytes_per_edit
                start, stop = start[ok], stop[ok]
                if not len(start):
                    continue
                key, one = np.unique(_whole_keys(data, start, stop, seed)[0], return_index=True)
                if wanted is not None:
                    at_ = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                    ok = wanted[at_] == key
                    key, one = key[ok], one[ok]
                raw = data.tobytes()
                yield pa.RecordBatch.from_pydict({"line_key": pa.array(key, pa.int64()), "line": pa.array([raw[start[i] : stop[i]] for i in one], pa.binary())})

    text = docs.select(F.col("text").cast("string"))
    schema = "line_key long, line binary"
    n = used.count()
    if n == 0:
        return docs.sparkSession.createDataFrame([], schema)
    if n <= BROADCAST_ROWS:
        small = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in used.collect()], np.int64)))
        found = text.mapInArrow(lean(lambda it: every(it, small.value)), schema)
    else:
        found = text.mapInArrow(lean(lambda it: every(it, None)), schema).join(used, "line_key", "left_semi")
    return found.dropDuplicates(["line_key"])


def decisions(docs: DataFrame, threshold: int = 2, bytes_per_edit: int = 20) -> DataFrame:
    """doc_id, doc_key, n_lines, n_removed, removed_lines (numbers from 0) for every document that has a text."""
    place = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.col("doc_key").alias("k"), F.col("line_no").alias("l"))
    for seed in range(8):
        keys = staged(line_keys(docs, seed), "lines")
        once = keys.where("line_key is not null").groupBy("line_key")
        distinct = staged(once.agg(F.min(place).alias("first"), F.count("*").alias("n"), (F.min("line_check") != F.max("line_check")).alias("twins")), "distinct-lines")
        if distinct.where("twins").isEmpty():
            break
    else:
        raise RuntimeError("eight seeds gave two lines one key: the hash is at fault")
    pairs = staged(near_lines(docs, distinct.select("line_key", "first"), threshold, bytes_per_edit, seed), "near-lines")
    ends = pairs.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(pairs.select(F.col("b").alias("v"), F.col("a").alias("w")))
    earliest = ends.join(distinct.select(F.col("line_key").alias("w"), "first"), "w").groupBy("v").agg(F.min("first").alias("near_first"))
    known = distinct.join(earliest, F.col("line_key") == F.col("v"), "left").where("n > 1 or near_first < first")
    known = known.select(F.col("line_key").alias("x"), F.when(F.coalesce(F.col("near_first") < F.col("first"), F.lit(False)), F.lit(None)).otherwise(F.col("first")).alias("stays"))
    judged = keys.join(known, F.col("line_key") == F.col("x"), "left")
    gone = F.col("x").isNotNull() & ~F.coalesce((F.col("stays.d") == place["d"]) & (F.col("stays.k") == F.col("doc_key")) & (F.col("stays.l") == F.col("line_no")), F.lit(False))
    lines = judged.select("doc_id", "doc_key", "line_no", gone.alias("gone"))
    return lines.groupBy("doc_id", "doc_key").agg(
        F.countDistinct("line_no").alias("n_lines"), F.array_sort(F.collect_set(F.when(F.col("gone"), F.col("line_no")))).alias("removed_lines")
    ).select("doc_id", "doc_key", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines")


def deduplicated(docs: DataFrame, drop_emptied: bool = True, **options) -> DataFrame:
    """All columns of the documents, their dropped lines cut from the text; documents left without any line go too."""
    names = docs.columns
    key, gone = free_name("_key", names), free_name("_gone", names)
    cut = decisions(docs, **options).where("n_removed > 0").select(F.col("doc_key").alias(key), F.col("removed_lines").alias(gone)).dropDuplicates([key])
    cut = staged(cut, "line-cuts")
    at = names.index("text")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed = batch.column(len(names)).to_pylist()
            texts, keep = [], np.ones(batch.num_rows, bool)
            for i, t in enumerate(batch.column(at).to_pylist()):
                if removed[i]:
                    lost = set(removed[i])
                    left = [x for j, x in enumerate(t.split("\n")) if j not in lost]
                    t = "\n".join(left)
                    keep[i] = not drop_emptied or any(x.strip(" \t\r") for x in left)
                texts.append(t)
            cols = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=plain).filter(pa.array(keep))

    keyed = docs.withColumn(key, doc_key())
    plain = [f"c{i}" for i in range(len(names))]  # Python stages resolve names, so they get some without dots and backticks
    rows = keyed.join(cut, key, "left").select(*map(named, names), gone).toDF(*plain, "gone")
    schema = StructType([StructField(n, f.dataType, f.nullable) for n, f in zip(plain, docs.schema.fields)])
    return rows.mapInArrow(lean(rewrite), schema).toDF(*names)
