"""Perceptual near-duplicates, components and leakage-safe partitions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import batched, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..sources.shared import forget, written
from .images import each_image, gray8


def dhash64(values: Column) -> Column:
    """Of 9 x 8 numbers, row by row: one bit for each of the 64 pairs of neighbours, set where the right one is larger, first pair in the highest bit."""

    def rises(i: Column) -> Column:
        left = i + F.floor(i / 8).cast("int")
        return F.when(F.get(values, left + 1) > F.get(values, left), F.lit(1)).otherwise(F.lit(0)).cast("long")

    powers = F.array(*[F.lit(1 << (63 - i) if i else -(1 << 63)).cast("long") for i in range(64)])
    bits = F.zip_with(F.transform(F.sequence(F.lit(0), F.lit(63)), rises), powers, lambda r, p: r * p)
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


@lru_cache(maxsize=256)
def _lanczos(n_in: int, n_out: int) -> np.ndarray:
    """Weights of a resize by a Lanczos window of three lobes, widened where the image shrinks."""
    scale = n_in / n_out
    x = (np.arange(n_in)[None, :] - (np.arange(n_out)[:, None] + 0.5) * scale + 0.5) / max(1.0, scale)
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resized(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Columns first, then rows, whole numbers of 0 to 255 after each pass; of one image or of a stack of equal size."""
    flat = gray.reshape(-1, gray.shape[-1]).astype(float)
    across = _levels(flat @ _lanczos(gray.shape[-1], width).T).reshape(*gray.shape[:-1], width)
    return _levels(_lanczos(gray.shape[-2], height) @ across)


def _levels(values: np.ndarray) -> np.ndarray:
    values += 0.5
    return np.clip(np.floor(values, out=values), 0, 255, out=values)


def _packed(bits: np.ndarray) -> np.ndarray:
    """The last two axes, 64 bits, as one number."""
    return np.packbits(bits.reshape(*bits.shape[:-2], 64), axis=-1).view(">i8")[..., 0].astype(np.int64)


def image_dhash(gray: np.ndarray) -> np.ndarray:
    v = resized(gray, 8, 9)
    return _packed(v[..., 1:] > v[..., :-1])


@lru_cache(maxsize=8)
def _waves(side: int, low: int) -> np.ndarray:
    k = np.arange(low)[:, None]
    return np.cos(np.pi * (2 * np.arange(side)[None, :] + 1) * k / (2 * side)) * np.where(k == 0, np.sqrt(1 / side), np.sqrt(2 / side))


def image_phash(gray: np.ndarray, side: int = 32, low: int = 8) -> np.ndarray:
    """The ``low`` x ``low`` slowest waves of the 32 x 32 image against their median, which leaves the constant one out."""
    waves = _waves(side, low)
    slow = waves @ resized(gray, side, side) @ waves.T
    rest = slow.reshape(*slow.shape[:-2], -1)[..., 1:]
    return _packed(slow > np.median(rest, axis=-1)[..., None, None])


def orientations(gray: np.ndarray) -> list[np.ndarray]:
    """The four quarter turns of an image (or of each of a stack) and of its mirror image."""
    return [np.rot90(g, k, axes=(-2, -1)) for g in (gray, gray[..., ::-1]) for k in range(4)]


#: Images that are hashed together, each in eight orientations of 32 KB.
STACK = 32


def image_hashes(images: DataFrame) -> DataFrame:
    """image_id, phashes, dhashes: 64-bit hashes of the 64 x 64 grey image in its eight orientations, the image as it is first."""

    def told(b: pa.RecordBatch) -> pa.RecordBatch:
        found = {"phashes": [], "dhashes": []}
        for some in batched(each_image(b), STACK):
            views = np.stack(orientations(np.stack([resized(gray8(x), 64, 64) for x in some])), axis=1)
            found["phashes"].append(image_phash(views).reshape(-1))
            found["dhashes"].append(image_dhash(views).reshape(-1))
        ends = pa.array(np.arange(0, 8 * b.num_rows + 1, 8, dtype=np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))) for x in found.values()]
        return pa.RecordBatch.from_arrays([b.column("image_id").cast(pa.int64()), *lists], ["image_id", *found])

    return images.select("image_id", "height", "width", "data").mapInArrow(lambda batches: map(told, batches), "image_id long, phashes array<long>, dhashes array<long>")


def by_shuffle(df: DataFrame) -> DataFrame:
    """Joins of ``df`` shuffle both sides: labels and links pack so well in their files that Spark would send them through the driver, in every round again."""
    return df.hint("merge")


def near_edges(hashes: DataFrame, distance: int, key: str, kinds: list[str], whole: int = 2) -> DataFrame:
    """a, b, kind, distance: links that connect what the rule connects: two rows are near if any hash of one and any of the other, of
    the same kind (an array column), are at most ``distance`` bits apart.

    Every distinct hash has an owner, its smallest key.  Rows are linked to the owners of their hashes, owners of near hashes to each
    other; each link is a near pair itself, and rows that share a hash make no pairs among them.  Of ``distance + whole`` segments
    of a hash ``whole`` must agree, so near hashes meet by an equi-join on each choice of that many segments.  Rows without hashes
    and null hashes make no link."""
    arrays = F.array(*[F.struct(F.lit(i).alias("kind"), F.array_distinct(k).alias("values")) for i, k in enumerate(kinds)])
    each = hashes.select(key, F.inline(arrays)).select(key, "kind", F.explode("values").alias("h")).where("h is not null")
    owned = written(each.groupBy("kind", "h").agg(F.min(key).alias("owner")), "owners")
    same = each.join(by_shuffle(owned), ["kind", "h"]).where(F.col(key) > F.col("owner")).select(F.col("owner").alias("a"), F.col(key).alias("b"), "kind", F.lit(0).alias("distance"))
    parts = distance + whole
    cuts = [64 * i // parts for i in range(parts + 1)]
    masks = [sum(((1 << cuts[i + 1]) - (1 << cuts[i])) for i in some) for some in combinations(range(parts), whole)]
    # one number to deal and sort by; rows that share it by chance are told apart by the kind and the bits themselves
    choices = F.array(*[F.xxhash64("kind", F.lit(i), F.col("h").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long"))) for i, m in enumerate(masks)])
    rows = owned.select("kind", "h", "owner", F.explode(choices).alias("meet"))
    left = rows.select("meet", "kind", F.col("h").alias("ha"), F.col("owner").alias("oa"))
    right = rows.select("meet", F.col("kind").alias("kb"), F.col("h").alias("hb"), F.col("owner").alias("ob"))
    apart = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))
    # the kind is compared as a difference: as an equality Spark would deal and sort by it too
    alike = (F.col("kind") - F.col("kb") == 0) & (F.col("ha") < F.col("hb")) & (F.col("oa") != F.col("ob")) & (apart <= distance)
    near = left.join(by_shuffle(right), "meet").where(alike)
    near = near.select(F.least("oa", "ob").alias("a"), F.greatest("oa", "ob").alias("b"), "kind", apart.alias("distance"))
    named = F.array(*map(F.lit, kinds))
    return same.unionByName(near).groupBy("a", "b", "kind").agg(F.min("distance").alias("distance")).withColumn("kind", F.get(named, F.col("kind")))


def hamming_pairs(hashes: DataFrame, distance: int, key: str, value: str) -> DataFrame:
    """Pairs at most ``distance`` bits apart: of ``distance + 1`` disjoint segments one must be equal, so candidates come from an equi-join."""
    parts = distance + 1
    cuts = [64 * i // parts for i in range(parts + 1)]
    segments = F.array(*[F.struct(F.lit(i).alias("segment"), F.shiftrightunsigned(F.shiftleft(F.col(value), 64 - hi), 64 - hi + lo).alias("bits")) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))])
    rows = hashes.select(F.col(key), F.col(value), F.inline(segments))
    a = rows.select("segment", "bits", F.col(key).alias("a"), F.col(value).alias("ha"))
    b = rows.select("segment", "bits", F.col(key).alias("b"), F.col(value).alias("hb"))
    near = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))
    return a.join(b, ["segment", "bits"]).where((F.col("a") < F.col("b")) & (near <= distance)).select("a", "b", near.alias("distance")).distinct()


def star_edges(df: DataFrame, key: str, group: str) -> DataFrame:
    """Links of every row to the smallest key of its group: as connecting as all pairs, but linear."""
    least = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(key).alias("a"), F.count("*").alias("n")).where("n > 1")
    return df.join(by_shuffle(least.select(F.col(group).alias("_g"), "a")), F.col(group) == F.col("_g")).where(F.col(key) != F.col("a")).select("a", F.col(key).alias("b"))


def components(vertices: DataFrame, edges: DataFrame, key: str, rounds: int = 50) -> DataFrame:
    """key, component (smallest key).  Least label of the neighbours, then of that label, until nothing changes; each round is written and the one before deleted."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("c")), "labels")
    for _ in range(rounds):
        near = both.join(by_shuffle(label.withColumnRenamed("v", "b")), "b").groupBy("a").agg(F.min("c").alias("m"))
        low = written(label.join(by_shuffle(near), F.col("v") == F.col("a")).select("v", F.col("c").alias("old"), F.least("c", "m").alias("c")), "labels")
        up = low.select(F.col("v").alias("v2"), F.col("c").alias("c2"))
        both_labels = written(low.join(by_shuffle(up), F.col("c") == F.col("v2"), "left").select("v", "old", F.least("c", F.coalesce("c2", "c")).alias("c")), "labels")
        forget(label)
        forget(low)
        label = both_labels.select("v", "c")
        if both_labels.where("c <> old").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return vertices.select(key).join(by_shuffle(label), F.col(key) == F.col("v"), "left").select(key, F.coalesce("c", key).alias("component"))


def component_id(members: DataFrame, component: str, sha: str) -> DataFrame:
    """SHA-256 of the sorted member hashes, joined by ``|``: hashed row by row as they come sorted, so that a component may have any size."""
    kind = members.schema[component].dataType

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, n, between, kind_of = None, hashlib.sha256(), 0, b"", None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], kind_of), pa.array([state.hexdigest()]), pa.array([n], pa.int64())], ["component", "component_sha", "size"])

        for batch in batches:
            kind_of = batch.column(0).type
            for c, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n and c != now:
                    yield row()
                    state, n, between = hashlib.sha256(), 0, b""
                now = c
                n += 1
                if text is not None:
                    state.update(between + text.encode())
                    between = b"|"
        if n:
            yield row()

    rows = members.select(F.col(component).alias("component"), F.col(sha).cast("string").alias("sha"))
    schema = StructType([StructField("component", kind), StructField("component_sha", StringType()), StructField("size", LongType())])
    # nulls last, as a list of hashes leaves them out but the size counts them
    hashed = rows.repartition("component").sortWithinPartitions("component", F.asc_nulls_last("sha")).mapInArrow(digest, schema)
    return hashed.withColumnRenamed("component", component)


def nearest_total(sizes: Iterable[int], target: int) -> tuple[int, list[int]]:
    """The total nearest to ``target`` (of equally near ones the larger) that some of ``sizes``, in their order, add up to, and
    the places of those: for each total the choice that reaches it first.

    A total is reached by the earliest size that makes it out of a total reached before, so one number a total, up to twice
    the target, tells all choices (8 bytes each).  Reading ends when the target itself is reached."""
    most = 2 * target
    first = np.full(most + 1, -1, np.int64)  # by which place a total was reached
    of: list[int] = []
    first[0] = 0
    top, whole = 0, True  # greatest total reached; all totals up to it are
    for place, size in enumerate(sizes):
        if first[target] >= 0:
            break
        of.append(size)
        if size <= 0 or size > most:
            continue
        if whole and size <= top + 1:
            first[top + 1 : min(top + size, most) + 1] = place
            top = min(top + size, most)
            continue
        high = min(top, most - size)
        fresh = np.flatnonzero((first[: high + 1] >= 0) & (first[size : high + size + 1] < 0)) + size
        # totals made by this very size do not serve it again: they were all read before any is set
        first[fresh] = place
        top = max(top, int(fresh.max(initial=0)))
        whole = whole and len(fresh) == 0 or bool((first[: top + 1] >= 0).all())
    reached = np.flatnonzero(first >= 0)
    total = int(reached[np.lexsort((-reached, np.abs(reached - target)))[0]])
    taken, left = [], total
    while left:
        place = int(first[left])
        taken.append(place)
        left -= of[place]
    return total, taken[::-1]


def partition_components(sizes: DataFrame, target: int, seed: int) -> DataFrame:
    """component_sha, size, role: whole components go to B so that their total is nearest to ``target``; of all choices the one
    that is reached first in the order of SHA-256 of ``seed:component_sha``.

    Components come to the driver one after the other, in that order, until the target is reached; it keeps 8 bytes for each
    total up to twice the target, and the sizes that it read."""
    ordered = written(sizes.select("component_sha", F.col("size").cast("long").alias("size"), F.sha2(F.concat_ws(":", F.lit(str(seed)), "component_sha"), 256).alias("_order")), "ordered-components")
    spark = sizes.sparkSession
    names: list[str] = []

    def one_by_one() -> Iterator[int]:
        for row in ordered.sort("_order").toLocalIterator():
            names.append(row["component_sha"])
            yield row["size"]

    _, places = nearest_total(one_by_one(), target)
    chosen = spark.createDataFrame([(names[k],) for k in places], "component_sha string").withColumn("_b", F.lit(True))  # at most 2 x target
    return ordered.join(chosen, "component_sha", "left").select("component_sha", "size", F.when(F.col("_b"), "B").otherwise("A").alias("role"))


def partition_audit(members: DataFrame) -> DataFrame:
    """role, members, components, hashes that another role also has, and components that are not whole: another role has members of them too."""
    cross = members.groupBy("sha").agg(F.count_distinct("role").alias("roles")).where("roles > 1").select("sha", F.lit(1).alias("leak"))
    split = members.groupBy("component").agg(F.count_distinct("role").alias("roles")).where("roles > 1").select("component", F.col("component").alias("broken"))
    marked = members.join(by_shuffle(cross), "sha", "left").join(by_shuffle(split), "component", "left")
    return marked.groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("component").alias("n_components"), F.count("leak").alias("n_leaks"), F.count_distinct("broken").alias("n_broken"))


def component_sizes(members: DataFrame) -> DataFrame:
    """size, n_components: how many components have how many members."""
    return members.groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_components"))


def compose_training_set(target: DataFrame, replay: DataFrame, views: list[str], repeats: int, extra_views: list[str], n_extra: int) -> DataFrame:
    """image_id, view, copy, role: targets under every view with repeats, an extra view by id, the first n extras, and a replay sample."""
    t = target.select("image_id")
    base = t.select("image_id", F.explode(F.array(*[F.lit(v) for v in views])).alias("view")).select("image_id", "view", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("copy"))
    rotating = t.select("image_id", F.get(F.array(*[F.lit(v) for v in extra_views]), ((F.col("image_id") - 1) % len(extra_views)).cast("int")).alias("view"), F.lit(0).alias("copy"))
    first = t.orderBy("image_id").limit(n_extra).select("image_id", F.lit("extra").alias("view"), F.lit(0).alias("copy"))
    main = base.unionByName(rotating).unionByName(first).withColumn("role", F.lit("target"))
    return main.unionByName(replay.select("image_id", F.lit("original").alias("view"), F.lit(0).alias("copy"), F.lit("replay").alias("role")))


def primary_scope(valid: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """Rows whose source key is unseen in training; their source key is the cluster."""
    seen = train.select(F.col(key).alias("_k")).distinct()
    return valid.join(seen, F.col(key) == F.col("_k"), "left_anti").withColumn("cluster", F.col(key))
