"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

Texts are lower-cased words.  Document and item overlap if, laid side by side at some offset, a run of ``window`` words
(the whole item if it is shorter) has at most its share of ``max_subs`` substitutions: ``size * max_subs // window``.
Seeds find every such run: with at most k substitutions among ``size`` words, two of the k + 2 residue classes of
positions modulo k + 2 are free of them, and for each distance of two classes a mask looks at just these (for 13 words
and two substitutions ``##--##--##`` and ``#-#-#-#-#``).  Masks are short enough to be met whichever classes are free.
Seeds of all positions of the items are joined with seeds at all positions of the documents.  Each hit fixes item,
document and offset; there the words are compared one by one.  Items under ``min_item`` words take no part.

Edge cases: null or empty texts overlap nothing; null ids are carried along; repeated rows give one result row for
each distinct (doc_id, text) and item; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, free_name, staged


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def masks(size: int, subs: int) -> list[list[int]]:
    """Word positions to look at, from 0.  Whichever ``subs`` of ``size`` words are substituted, some mask fits in somewhere without meeting them."""
    if subs == 0:
        return [list(range(size))]
    m = subs + 2
    if size < 2 * m:  # one free class of subs + 1
        return [[p * (subs + 1) for p in range(size // (subs + 1))]]
    return [[p for p in range(size - m + 1) if p % m in (0, d)] for d in range(1, m // 2 + 1)]


def _seeds(rows: DataFrame, id_cols: list[str], mask: list[int]) -> DataFrame:
    """The words under ``mask`` at every position (from 0) of the hashed words, as one key."""
    last = F.size("w") - mask[-1] - 1
    name = F.lit(",".join(map(str, mask)))
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("pos"), F.xxhash64(name, *[F.get("w", i + p) for p in mask]).alias("key")))
    return rows.where(last >= 0).select(*id_cols, F.inline(each))


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 13, max_subs: int = 2, min_item: int = 5) -> DataFrame:
    """doc_id, doc_key, item_id, doc_start (word), n_words, n_matched for each document and item that overlap."""
    doc_key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    hashed = F.transform(words(F.col("text")), lambda x: F.xxhash64(x))
    items = staged(benchmark.select("item_id", F.xxhash64("item_id", F.coalesce("text", F.lit(""))).alias("item_key"), hashed.alias("w")).where(F.size("w") >= min_item).dropDuplicates(["item_key"]), "items")
    # each length under the window has masks of its own: fewer than ``window`` values
    sizes = [r[0] for r in items.select(F.least(F.lit(window), F.size("w")).alias("n")).distinct().orderBy("n").collect()] or [window]
    # hashed once: as a written column the words are not worked out again wherever an expression names them
    texts = staged(docs.select("doc_id", doc_key.alias("doc_key"), hashed.alias("w")), "words")
    seeds = [(items.where(F.least(F.lit(window), F.size("w")) == n), mask) for n in sizes for mask in masks(n, n * max_subs // window)]
    found = reduce(DataFrame.unionByName, [_seeds(texts, ["doc_key"], mask) for _, mask in {str(m): (0, m) for _, m in seeds}.values()])
    seeds = reduce(DataFrame.unionByName, [_seeds(rows, ["item_key"], mask) for rows, mask in seeds])
    seeds = staged(seeds.withColumnRenamed("pos", "item_pos"), "seeds")
    hits = found.join(broadcast_if_small(seeds, 24), "key").select("doc_key", "item_key", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    hits = staged(hits, "hits")

    # the words of the documents that were hit, beside those of the item
    with_words = F.size("w") * 8 + 32
    which = hits.join(broadcast_if_small(items, with_words), "item_key").select("doc_key", "item_key", "item_id", "shift", F.col("w").alias("item_w"))
    which = broadcast_if_small(staged(which, "items-hit"), F.size("item_w") * 8 + 32)
    near = texts.join(which, "doc_key")
    first, stop = F.greatest(F.lit(0), -F.col("shift")), F.least(F.size("item_w"), F.size("w") - F.col("shift"))
    aligned = near.where(stop > first).withColumn("first", first).withColumn(
        "same", F.transform(F.sequence(first, stop - 1), lambda j: F.when(F.get("item_w", j) == F.get("w", j + F.col("shift")), 1).otherwise(0))
    )
    size = F.least(F.lit(window), F.size("item_w"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("same") - size + 1), lambda s: F.aggregate(F.slice("same", s, size), F.lit(0), lambda a, x: a + x)))
    good = aligned.where(F.size("same") >= size).withColumn("best", best).where(F.col("best") >= size - F.floor(size * max_subs / window))
    matched = F.aggregate("same", F.lit(0), lambda a, x: a + x)
    top = F.max(F.struct(matched.alias("n_matched"), (-F.col("shift")).alias("s"), F.size("same").alias("n_words"), (F.col("shift") + F.col("first")).alias("doc_start")))
    return (
        good.groupBy("doc_id", "doc_key", "item_id", "item_key")
        .agg(top.alias("t"))
        .select("doc_id", "doc_key", "item_id", F.col("t.doc_start").cast("long").alias("doc_start"), F.col("t.n_words").cast("long").alias("n_words"), F.col("t.n_matched").cast("long").alias("n_matched"))
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, all columns, that overlap no benchmark item."""
    key = free_name("_key", docs.columns)
    bad = staged(overlaps(docs, benchmark, **options).select(F.col("doc_key").alias(key)).distinct(), "leaks")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    return keyed.join(broadcast_if_small(bad, 16), key, "left_anti").drop(key)
