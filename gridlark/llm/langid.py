"""Language identification by Bayesian evidence fusion.

Four kinds of evidence about a text are combined as log probabilities:

* the text: byte trigrams, hashed to ``BUCKETS`` buckets, under one model a language (counts over all labelled rows, by
  grouped aggregation) and under ``und``, which holds every bucket alike; a long text counts as at most ``strength`` trigrams;
* the declared language (markup or metadata) and the address suffix: P(declared | language) and P(suffix | language),
  counted against what the texts alone say;
* the host: its mix of languages, smoothed towards that of its domain, which is smoothed towards that of all rows.

A row is accepted if its most probable language is not ``und`` and has at least ``min_confidence``.

Edge cases: null or empty texts and texts under three bytes have no text evidence and are ``und`` (rejected); null
declared languages, suffixes, hosts or domains add no evidence; without labelled rows everything is ``und``; ties go
to the language that comes first by name; repeated rows are judged alike; an empty table gives no rows; other columns
are kept out of the way, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import free_name, lean, staged, text_chunks, utf8_buffer

BUCKETS = 1 << 14
BLOCK = 1 << 10
HELD = 128  # languages counted at once in a task: 16 MB
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram and offsets by row; trigrams never cross rows."""
    b = _FOLD[data]
    if len(b) < 3:
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int32)  # the top 14 bits
    size = np.maximum(np.diff(offsets) - 2, 0)
    inside = np.ones(len(b), bool)
    ends = offsets[1:]
    for back in (1, 2):  # the last two places of each row begin no trigram
        at = ends - back
        inside[at[at >= offsets[:-1]]] = False
    return bucket[inside[:-2]], np.concatenate([[0], np.cumsum(size)])


def languages(docs: DataFrame, label: str) -> list[str]:
    """Every label, however rare."""
    return sorted(r[0] for r in docs.where(F.col(label).isNotNull()).select(F.col(label).cast("string")).distinct().collect())


def train(docs: DataFrame, label: str, text: str = "text", alpha: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Names and log P(bucket | language), with ``und`` last.  What reaches the driver is languages x buckets numbers."""
    names = languages(docs, label)
    index = {n: i for i, n in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            labels = np.array([index.get(x, -1) for x in batch.column(1).to_pylist()])
            for at, to in text_chunks(batch.column(0)):
                bucket, offsets = _trigrams(*utf8_buffer(batch.column(0).slice(at, to - at)))
                here, row = np.unique(labels[at:to], return_inverse=True)
                rows = np.repeat(row, np.diff(offsets))
                for g in range(0, len(here), HELD):
                    some = here[g : g + HELD]
                    ok = (rows >= g) & (rows < g + HELD)
                    counted = np.bincount((rows[ok] - g) * BUCKETS + bucket[ok], minlength=len(some) * BUCKETS).reshape(len(some), BUCKETS)
                    if len(sums) + len(some) > HELD:
                        yield _blocks(sums)
                        sums = {}
                    sums.update((k, sums.get(k, 0) + n) for k, n in zip(some.tolist(), counted, strict=True) if k >= 0)
        if sums:
            yield _blocks(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(data, np.int64)
        if sums:
            yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int64()), "counts": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    schema = "block long, counts binary"
    counts = docs.select(F.col(text).cast("string"), F.col(label).cast("string")).mapInArrow(lean(count), schema).repartition("block").mapInArrow(lean(add), schema)
    total = np.zeros(len(names) * BUCKETS, np.int64)
    for k, data in counts.collect():
        total[k * BLOCK : (k + 1) * BLOCK] = np.frombuffer(data, np.int64)
    total = total.reshape(len(names), BUCKETS) + alpha
    known = np.log(total / total.sum(axis=1, keepdims=True)) if names else np.zeros((0, BUCKETS))
    return names, np.vstack([known, np.full((1, BUCKETS), -np.log(BUCKETS))])


def _blocks(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    """The blocks that have counts; block numbers go through the languages in order."""
    each = BUCKETS // BLOCK
    parts = [(k * each + i, part) for k, v in sums.items() for i, part in enumerate(v.astype(np.int64).reshape(each, BLOCK)) if part.any()]
    return pa.RecordBatch.from_pydict({"block": pa.array([k for k, _ in parts], pa.int64()), "counts": pa.array([p.tobytes() for _, p in parts], pa.binary())})


def text_evidence(rows: DataFrame, model: tuple[list[str], np.ndarray], strength: int) -> DataFrame:
    """``rows`` (text last) with n_trigrams and ``evidence``, a log probability for each language and ``und``, in place of the text."""
    names, logp = model
    keep = rows.columns[:-1]
    table = np.ascontiguousarray(logp.T.astype(np.float32))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(len(keep))
            for at, to in text_chunks(text):
                bucket, offsets = _trigrams(*utf8_buffer(text.slice(at, to - at)))
                n = np.diff(offsets)
                out = np.zeros((to - at, table.shape[1]))
                full = np.flatnonzero(n)
                if len(full):
                    for j in range(table.shape[1]):
                        out[full, j] = np.add.reduceat(table[:, j][bucket].astype(np.float64), offsets[:-1][full])
                    out[full] *= (np.minimum(n, strength) / np.maximum(n, 1))[full, None]
                evidence = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1]).astype(np.int32)), pa.array(out.reshape(-1)))
                cols = [batch.column(i).slice(at, to - at) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n), evidence], names=[*keep, "n_trigrams", "evidence"])

    return rows.mapInArrow(lean(score), rows.select(*keep).schema.add("n_trigrams", "long").add("evidence", ArrayType(DoubleType())))


def _argmax(a: Column) -> Column:
    """Position (from 1) of the first largest value."""
    return F.array_position(a, F.array_max(a)).cast("int")


def _counts(n: int, best: Column) -> Column:
    return F.array(*[F.count_if(best == i + 1).cast("double") for i in range(n)])


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], key: str, text: str = "text", declared: Column | None = None, suffix: Column | None = None, host: Column | None = None, domain: Column | None = None, strength: int = 200, smoothing: float = 20.0, min_confidence: float = 0.5) -> DataFrame:
    """``key``, language, confidence, accepted, n_trigrams for every row."""
    names = model[0]
    size = len(names) + 1
    none = F.lit(None).cast("string")
    given = rows.select(
        F.col(key).alias("_key"),
        *[(none if c is None else c.cast("string")).alias(n) for n, c in (("_declared", declared), ("_suffix", suffix), ("_host", host), ("_domain", domain))],
        F.col(text).cast("string").alias("_text"),
    )
    scored = staged(text_evidence(given, model, strength).withColumn("_best", F.when(F.col("n_trigrams") > 0, _argmax(F.col("evidence"))).otherwise(size)), "text-evidence")
    uniform = F.array(*[F.lit(1.0 / size)] * size)
    seen = scored.agg(_counts(size, F.col("_best")).alias("n")).select(_mix(F.col("n"), uniform, smoothing).alias("overall"))
    overall = seen.first()[0]
    base = F.array(*[F.lit(float(x)) for x in overall])

    def likelihood(column: str, name: str) -> DataFrame:
        """log P(value | language) for each value, smoothed."""
        by = scored.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(name)).agg(_counts(size, F.col("_best")).alias("n"))
        total = scored.where(F.col(column).isNotNull()).agg(_counts(size, F.col("_best")).alias("n")).first()[0]
        share = F.zip_with("n", F.array(*[F.lit(float(t)) for t in total]), lambda a, b: F.log((a + 1.0) / (b + smoothing)))
        return by.select(name, share.alias(f"{name}_evidence"))

    zero = F.array(*[F.lit(0.0)] * size)
    out = scored
    for column, name, used in (("_declared", "_d", declared), ("_suffix", "_s", suffix)):
        if used is not None:
            out = out.join(likelihood(column, name), F.col(column) == F.col(name), "left").withColumn("evidence", F.zip_with("evidence", F.coalesce(f"{name}_evidence", zero), lambda a, b: a + b)).drop(name, f"{name}_evidence")
    prior = F.transform(base, lambda x: F.log(x))
    if host is not None:
        by_host = scored.where(F.col("_host").isNotNull()).groupBy(F.col("_host").alias("_h"), F.col("_domain").alias("_hd")).agg(_counts(size, F.col("_best")).alias("n"))
        by_domain = scored.where(F.col("_domain").isNotNull()).groupBy(F.col("_domain").alias("_dd")).agg(_counts(size, F.col("_best")).alias("m")).select("_dd", _mix(F.col("m"), base, smoothing).alias("up"))
        hosts = by_host.join(by_domain, F.col("_hd") == F.col("_dd"), "left").select("_h", F.col("_hd"), F.transform(_mix(F.col("n"), F.coalesce("up", base), smoothing), lambda x: F.log(x)).alias("host_prior"))
        out = out.join(hosts, (F.col("_host") == F.col("_h")) & F.col("_domain").eqNullSafe(F.col("_hd")), "left")
        prior = F.coalesce(F.col("host_prior"), prior)
    joint = out.withColumn("joint", F.zip_with("evidence", prior, lambda a, b: a + b))
    top = F.array_max("joint")
    confidence = 1.0 / F.aggregate(F.transform("joint", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    labels = F.array(*[F.lit(n) for n in [*names, UNKNOWN]])
    language = F.when(F.col("n_trigrams") > 0, F.get(labels, _argmax(F.col("joint")) - 1)).otherwise(F.lit(UNKNOWN))
    sure = F.when(F.col("n_trigrams") > 0, F.round(confidence, 6)).otherwise(F.lit(0.0))
    result = joint.select(F.col("_key").alias(key), language.alias("language"), sure.alias("confidence"), "n_trigrams")
    return result.withColumn("accepted", (F.col("language") != UNKNOWN) & (F.col("confidence") >= min_confidence))


def _mix(counts: Column, towards: Column, strength: float) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, towards, lambda n, p: (n + p * strength) / (total + strength))


def plain_text(html: Column) -> Column:
    """What a web page says, without scripts, styles and tags."""
    return F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")


def page_parts(url: Column, html: Column) -> dict[str, Column]:
    """Declared language, address suffix, host and domain of a web page."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host != "", host)
    return {
        "declared": F.when(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1) != "", F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))),
        "suffix": F.element_at(F.split(host, r"\."), -1),
        "host": host,
        "domain": F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1),
    }


def document_parts() -> dict[str, Column]:
    """For documents: the declared language is their ``lang``, the host their ``source`` and the domain its name without the number."""
    return {"declared": F.col("lang"), "host": F.col("source"), "domain": F.regexp_replace("source", r"[0-9]+$", "")}


def accepted_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, all columns."""
    row = free_name("_row", docs.columns)
    parts = [F.col("doc_id"), F.coalesce("text", F.lit("")), F.col("lang"), F.col("source")]
    keyed = docs.withColumn(row, F.xxhash64(*parts, *(c.isNull() for c in parts)))  # the hash passes over nulls, so their places are told apart
    judged = identify(keyed, train(docs, "lang"), row, **document_parts(), **options)
    rejected = judged.where(~F.col("accepted")).select(row).distinct()
    return keyed.join(rejected, row, "left_anti").drop(row)
