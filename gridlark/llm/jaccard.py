"""N-gram Jaccard join by MinHash banding.

Texts are sets of word 5-grams (a text of fewer words is one shorter gram).  Texts with equal sets are one class from
the start, so copies never meet in a join.  For one member of each class, MinHash values are grouped into bands; band
and row counts follow from the threshold and the target recall.  A value keeps one byte, so a band's bytes are its bucket
(bytes that agree by chance only add candidates).  Rows shuffle on bucket; large buckets meet in pairs of blocks.  A pair
is taken in the first band in which it agrees.  Pairs whose size, odd sketch or estimate (six standard errors, chance of a
wrong loss about 1e-9) rule the threshold out are left, the others are verified on their full n-gram sets.  Links are
counted where the sets of two blocks of near classes meet; they never become rows, so a large group of near copies costs
its comparisons but no rows for its pairs.

Result, one row a document: ``class_id`` (the smallest doc_id among all documents linked directly or through others) and
``n_links`` (other documents with a similarity of the threshold or more, copies counted).

Edge cases: texts without words (or null) are linked to nothing and are classes of their own; null doc_ids are carried
and give a null class_id only where a class has no other; repeated rows are copies of one another; an empty table gives
no rows; other columns are ignored.  Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, free_name, lean, splitmix, staged, text_chunks, texts_of
from .graph import components

#: Classes that meet in one task at most twice over, and pairs compared at a time.
BLOCK, PAIRS = 256, 1 << 14
_WORD = re.compile(r"\w+")


def choose_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band that reach ``recall`` at ``threshold`` with at most ``most`` values."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("recall out of reach")


class _Words(dict):
    """word -> 64-bit hash, kept by the worker; emptied when large."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _Words()


def gram_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    out = []
    for t in texts:
        w = _WORD.findall(t.lower())
        if not w:
            out.append(np.zeros(0, np.uint64))
            continue
        h = np.fromiter(map(_WORDS.__getitem__, w), np.uint64, len(w))
        k = min(n, len(h))
        m = len(h) - k + 1
        g = np.full(m, k, np.uint64)
        for j in range(k):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + m]
        out.append(np.unique(splitmix(g)))
    return out


def _minhash(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[set, function]: least 32-bit hash of each set."""
    out = np.empty((len(sets), len(a)), np.uint32)
    for i, s in enumerate(sets):
        low = np.full(len(a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(s), 512):
            v = s[at : at + 512][None, :] * a[:, None]
            v += b[:, None]
            low = np.minimum(low, (v >> np.uint64(32)).min(axis=1).astype(np.uint32))
        out[i] = low
    return out


def _odd_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """[set, word]: 512 bits of each set, which buckets hold an odd number of its grams."""
    bits = np.zeros((len(sets), 512), bool)
    for row, s in zip(bits, sets, strict=True):
        row[:] = np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(bits, axis=1)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text, by which it is found again), set_key, n_grams, MinHash signature (a byte a value) and odd sketch of every document."""
    rng = np.random.default_rng(20240917)
    a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in text_chunks(batch.column(2)):
                sets = gram_sets(texts_of(batch.column(2), at, to), n)
                keys = np.array([int(splitmix(np.array([splitmix(s).sum() + np.uint64(len(s))], np.uint64))[0]) if len(s) else 0 for s in sets], np.uint64)
                low = splitmix(_minhash(sets, a, b)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(at, to - at) for i in (0, 1)),
                        pa.array(keys.view(np.int64)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([r.tobytes() for r in low], pa.binary()),
                        pa.array([r.tobytes() for r in _odd_sketches(sets)], pa.binary()),
                    ],
                    names=["doc_id", "text_key", "set_key", "n_grams", "signature", "odd"],
                )

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(lean(sign), "doc_id long, text_key long, set_key long, n_grams long, signature binary, odd binary")


def placed(classes: DataFrame, bands: int, rows: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Classes that share a bucket with others: (v, home, signature, odd, n_grams, size), and their places in buckets (v, band, key, blocks).

    ``home`` names a block of about ``block`` classes that are near one another: those that meet the same least class.
    It only brings pairs together that need the same sets, and decides nothing."""
    each = classes.select(F.col("set_key").alias("v"), "signature", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    slim = each.select("v", "band", F.expr(f"substring(signature, band * {rows} + 1, {rows})").alias("key"))
    crowds = slim.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("v").alias("least")).where("n > 1")
    places = staged(slim.join(crowds, ["band", "key"]).select("v", "band", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"), "least"), "bucket-places")
    near = staged(places.groupBy("v").agg(F.min("least").alias("near")), "homes")
    homes = near.join(near.groupBy("near").agg(F.ceil(F.count("*") / block).alias("parts")), "near")
    homes = homes.select("v", F.xxhash64("near", F.pmod(F.xxhash64("v"), "parts")).alias("home"))
    verts = homes.join(classes.select(F.col("set_key").alias("v"), "signature", "odd", "n_grams", "size", "text_key"), "v")
    return staged(verts, "placed-classes"), places.drop("least")


def _runs(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Starts of the runs of equal keys in a sorted table, and its length."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        c = table.column(k).combine_chunks()
        new[1:] |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)))
    return np.append(np.flatnonzero(new), table.num_rows)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of whole groups, with the starts of the groups."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if kept and all(kept[-1].column(k)[-1] == batch.column(k)[-1] for k in keys):
            kept.append(batch)
            continue
        table = pa.Table.from_batches([*kept, batch])
        runs = _runs(table, keys)
        if len(runs) > 2:
            yield table.slice(0, runs[-2]), runs[:-1]
        kept = table.slice(runs[-2]).combine_chunks().to_batches()
    if kept:
        table = pa.Table.from_batches(kept)
        yield table, _runs(table, keys)


def _bytes_of(table: pa.Table, name: str, width: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind).reshape(table.num_rows, width)


def candidates(verts: DataFrame, places: DataFrame, bands: int, rows: int, threshold: float) -> DataFrame:
    """Pairs of classes that agree in a band, once each, and whose sizes, odd sketches and signatures allow the threshold.

    The members of a bucket meet in pairs of its blocks, so no task holds more than two blocks of it.  A pair is taken in
    the first band in which it agrees.  What comes out is one row for each two homes a task has met: lists ``a``, ``b``."""
    met = places.join(verts.select("v", "home", "signature", "odd", "n_grams"), "v")
    met = met.withColumn("own", F.pmod(F.xxhash64("v", "band"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "v", "home", "n_grams", "signature", "odd")
    keys = ["band", "key", "i", "j"]
    k = bands * rows
    # a byte agrees by chance once in 256 times, which only raises the estimate
    least = threshold - 6 * math.sqrt(threshold * (1 - threshold) / k)
    share = (1 - threshold) / (1 + threshold)  # the grams of one set alone, of both sizes together

    def pairs_of(table: pa.Table, runs: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        sig, odd = _bytes_of(table, "signature", k, np.uint8), _bytes_of(table, "odd", 8, np.uint64)
        n, band, own, v, home, i, j = (np.asarray(table.column(c)) for c in ("n_grams", "band", "own", "v", "home", "i", "j"))
        last = np.repeat(runs[1:], np.diff(runs))
        later = last - np.arange(len(last)) - 1
        ends = np.cumsum(later)
        at = 0
        while at < len(later):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + PAIRS, side="right")))
            x = np.repeat(np.arange(at, to), later[at:to])
            y = x + 1 + np.arange(len(x)) - np.repeat(ends[at:to] - later[at:to] - base, later[at:to])
            at = to
            take = (v[x] != v[y]) & ((i[x] == j[x]) | (own[x] != own[y])) & (np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y]))
            x, y = x[take], y[take]
            apart = np.bitwise_count(odd[x] ^ odd[y]).sum(axis=1, dtype=np.int64)
            take = apart <= share * (n[x] + n[y]) + 1e-6
            x, y = x[take], y[take]
            same = sig[x] == sig[y]
            first = same.reshape(len(x), bands, rows).all(axis=2).argmax(axis=1) == band[x]
            take = first & (same.mean(axis=1) >= least)
            x, y = x[take], y[take]
            swap = (home[x] > home[y]) | ((home[x] == home[y]) & (v[x] > v[y]))
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            yield home[x], home[y], v[x], v[y]

    def listed(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        p, q, a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((q, p))
        p, q, a, b = p[order], q[order], a[order], b[order]
        starts = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])]))
        cuts = pa.array(np.append(starts, len(p)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(p[starts]), pa.array(q[starts]), pa.ListArray.from_arrays(cuts, pa.array(a)), pa.ListArray.from_arrays(cuts, pa.array(b))], names=["p", "q", "a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for table, runs in whole_groups(batches, keys):
            for pairs in pairs_of(table, runs):
                found.append(pairs)
                size += len(pairs[0])
                if size >= 8 * PAIRS:
                    yield listed(found)
                    found, size = [], 0
        if size:
            yield listed(found)

    return met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(meet), "p long, q long, a array<long>, b array<long>")


def _sets_of(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """v, size, grams for the classes in ``members`` (v, size, _t: the key of one of its texts)."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(np.unique(np.asarray(batch.column(0)), return_index=True)[1]))  # copies have one set
            for at, to in text_chunks(batch.column(2)):
                sets = gram_sets(texts_of(batch.column(2), at, to), n)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, to - at) for i in (0, 1)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["v", "size", "grams"])

    texts = docs.select(F.xxhash64("text").alias("_t"), F.col("text").cast("string").alias("text")).join(members, "_t")
    return texts.select("v", "size", "text").mapInArrow(lean(grams), "v long, size long, grams binary").dropDuplicates(["v"])


def link_counts(docs: DataFrame, classes: DataFrame, n: int, threshold: float, bands: int, rows: int, block: int) -> DataFrame:
    """v, near, root: what the verified links of class v inside one pair of homes add to its count, and a class it is linked to there, directly or through others.

    Every pair is verified on its full sets, but pairs are never rows: the sets of two homes are brought to one place and
    its links are counted there."""
    verts, places = placed(classes, bands, rows, block)
    pairs = staged(candidates(verts, places, bands, rows, threshold), "candidates")
    used = staged(pairs.select("p", "q", F.explode(F.array_distinct(F.concat("a", "b"))).alias("v")).distinct(), "used-classes")
    members = staged(verts.join(used.select("v").distinct(), "v").select("v", "size", F.col("text_key").alias("_t")), "members")
    sets = staged(_sets_of(docs, broadcast_if_small(members, 16), n), "gram-sets")
    brought = used.join(sets, "v").select("p", "q", F.lit(0).alias("kind"), "v", "size", "grams", F.lit(None).cast("array<long>").alias("a"), F.lit(None).cast("array<long>").alias("b"))
    asked = pairs.select("p", "q", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("v"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("binary").alias("grams"), "a", "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[int, int] | None = None
        here: dict[int, tuple[int, np.ndarray]] = {}
        near: dict[int, int] = {}
        root: dict[int, int] = {}

        def top(v: int) -> int:
            while (r := root.setdefault(v, v)) != v:
                root[v] = root[r]
                v = r
            return v

        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"v": pa.array(list(near), pa.int64()), "near": pa.array(list(near.values()), pa.int64()), "root": pa.array([top(v) for v in near], pa.int64())})

        for batch in batches:
            for p, q, kind, v, size, grams, a, b in zip(*batch.columns, strict=True):
                if (key := (p.as_py(), q.as_py())) != now:
                    if near:
                        yield ended()
                    now, here, near, root = key, {}, {}, {}
                if kind.as_py() == 0:
                    here[v.as_py()] = (size.as_py(), np.frombuffer(grams.as_py(), np.uint64))
                    continue
                for x, y in zip(a.values.to_numpy().tolist(), b.values.to_numpy().tolist(), strict=True):
                    (m, s), (k, t) = here[x], here[y]
                    if len(s) > len(t):
                        s, t = t, s
                    at = t.searchsorted(s)
                    at[at == len(t)] = 0
                    common = int(np.count_nonzero(t[at] == s))
                    if common / (len(s) + len(t) - common) >= threshold:
                        near[x] = near.get(x, 0) + k
                        near[y] = near.get(y, 0) + m
                        i, j = top(x), top(y)
                        root[max(i, j)] = min(i, j)
        if near:
            yield ended()

    together = brought.unionByName(asked).repartition("p", "q").sortWithinPartitions("p", "q", "kind")
    return together.mapInArrow(lean(verify), "v long, near long, root long")


def join_documents(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_links (and text_key, has_words) for every document, one row an input row."""
    bands, rows = choose_bands(threshold, recall)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = staged(signatures(docs, n, bands, rows), "signatures")
    grouped = signed.where("n_grams > 0").groupBy("set_key").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("size"), F.min("text_key").alias("text_key"), F.max("n_grams").alias("n_grams"))
    # equal sets have equal signatures: any one will do
    one = signed.where("n_grams > 0").select("set_key", "text_key", "signature", "odd").dropDuplicates(["set_key", "text_key"])
    classes = staged(grouped.join(one, ["set_key", "text_key"]), "classes")
    links = staged(link_counts(docs, classes, n, threshold, bands, rows, block), "links")
    more = links.groupBy("v").agg(F.sum("near").alias("near"))
    label = components(links.where("v <> root").select(F.col("v").alias("a"), F.col("root").alias("b")))
    joined = classes.join(label, F.col("set_key") == F.col("vertex"), "left").select("set_key", "least_id", "size", F.coalesce("component", "set_key").alias("component"))
    class_ids = joined.groupBy("component").agg(F.min("least_id").alias("class_id"))
    known = staged(joined.join(class_ids, "component").join(more, F.col("set_key") == F.col("v"), "left").select("set_key", "class_id", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("n_links")), "class-ids")
    out = signed.join(known.withColumnRenamed("set_key", "k"), (F.col("n_grams") > 0) & (F.col("set_key") == F.col("k")), "left")
    return out.select("doc_id", F.when(F.col("n_grams") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "text_key", (F.col("n_grams") > 0).alias("has_words"))


def one_of_each_class(docs: DataFrame, **options) -> DataFrame:
    """All columns of one document of each class: the one whose doc_id is the class id (of several such rows, one)."""
    found = staged(join_documents(docs, **options), "classes-of-documents")
    if not found.groupBy("doc_id").count().where("count > 1").isEmpty():  # ids that repeat: one row for each text, and one text for each class
        docs = docs.dropDuplicates(["doc_id", "text"])
        least = found.where("doc_id <=> class_id").groupBy("class_id", "has_words").agg(F.min("text_key").alias("least_key"))
        found = found.join(least.withColumnsRenamed({"class_id": "c", "has_words": "hw"}), F.col("class_id").eqNullSafe(F.col("c")) & (F.col("has_words") == F.col("hw")), "left")
        gone = ~F.col("doc_id").eqNullSafe(F.col("class_id")) | (F.col("has_words") & (F.col("text_key") != F.col("least_key")))
    else:
        gone = ~F.col("doc_id").eqNullSafe(F.col("class_id"))
    key = free_name("_key", docs.columns)
    drop = staged(found.where(gone).select(F.xxhash64("doc_id", "text_key").alias(key)).distinct(), "near-copies")
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))))
    return keyed.join(drop, key, "left_anti").drop(key)
