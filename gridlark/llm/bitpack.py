"""Token ids as binary shards: every id takes the minimum number of bits of its vocabulary.

Shard layout (little endian): header, then per document its id and the end of its ids, then the byte offset of each
block, then the blocks.  A block holds ``BLOCK`` ids (a multiple of 64, so each block begins on a 64-bit word) packed
``width`` bits each, lowest bits first.  Any id range is read by unpacking only the blocks that it touches.

``write_shards`` stores shards as rows of a Parquet table (``part``, ``seq``, ``first_id``, ``n_docs``, ``n_ids``,
``low_doc``, ``high_doc``, ``shard``): Spark's commit protocol then covers the files, and any store that Spark reaches will
do.  Documents are in ascending ``doc_id`` order over (part, seq).  ``read_documents`` reads all of them, ``lookup`` some,
from the shards whose range of ids holds them and of these only the blocks.

Edge cases: a null or empty text has only the end id; null ``doc_id`` sorts first and is kept as null; repeated ids and
rows are kept, each with its own ids (ties in order of a hash of the text, then the text, so that one id may fill many
partitions); an empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import lean, partition_id, text_chunks, texts_of

MAGIC = b"GLTK"
HEADER = struct.Struct("<4sHHQQQ")  # magic, version, width, documents, ids, ids a block
BLOCK = 1 << 16
SHARD_IDS = 1 << 21
SHARD_DOCS = 1 << 16
SHARD_SCHEMA = "part int, seq int, first_id long, n_docs long, n_ids long, low_doc long, high_doc long, shard binary"


def min_bits(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> np.ndarray:
    """``ids`` as 64-bit words, ``width`` bits each; padded with zeros to a multiple of 64 ids."""
    n = -len(ids) % 64
    cols = np.concatenate([ids.astype(np.uint64), np.zeros(n, np.uint64)]).reshape(-1, 64).T.copy()
    out = np.zeros((width, cols.shape[1]), np.uint64)
    for j in range(64):  # 64 ids fill exactly ``width`` words
        word, shift = divmod(j * width, 64)
        out[word] |= cols[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= cols[j] >> np.uint64(64 - shift)
    return out.T.reshape(-1)


def unpack(words: np.ndarray, width: int, n: int) -> np.ndarray:
    cols = words.reshape(-1, width).T.copy()
    out = np.zeros((64, cols.shape[1]), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[j] = cols[word] >> np.uint64(shift)
        if shift + width > 64:
            out[j] |= cols[word + 1] << np.uint64(64 - shift)
    return (out & np.uint64((1 << width) - 1)).T.reshape(-1)[:n].astype(np.uint32)


def build_shard(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    blocks = [pack(ids[k : k + BLOCK], width) for k in range(0, len(ids), BLOCK)]
    offsets = np.concatenate([[0], np.cumsum([b.nbytes for b in blocks])]).astype("<u8")
    present = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join(
        [
            HEADER.pack(MAGIC, 1, width, len(doc_ids), len(ids), BLOCK),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.asarray(ends, "<u8").tobytes(),
            offsets.tobytes(),
            present.tobytes(),
            *(b.astype("<u8").tobytes() for b in blocks),
        ]
    )


class Shard:
    """Random access to the bytes of one shard."""

    def __init__(self, data: bytes):
        magic, version, self.width, self.n_docs, self.n_ids, self.block = HEADER.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token shard")
        at = HEADER.size
        n_blocks = -(-self.n_ids // self.block)
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.ends = np.frombuffer(data, "<u8", self.n_docs, at).astype(np.int64)
        at += 8 * self.n_docs
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at).astype(np.int64)
        at += 8 * (n_blocks + 1)
        self.present = np.frombuffer(data, np.uint8, self.n_docs, at).astype(bool)
        self.data, self.base = data, at + self.n_docs

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start:stop`` of the shard, from the blocks that hold them."""
        stop = min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        out = []
        for k in range(start // self.block, (stop - 1) // self.block + 1):
            lo, hi = self.offsets[k], self.offsets[k + 1]
            words = np.frombuffer(self.data, "<u8", (hi - lo) // 8, self.base + lo)
            first = k * self.block
            out.append(unpack(words, self.width, min(self.block, self.n_ids - first))[max(start - first, 0) : stop - first])
        return np.concatenate(out)

    def doc(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2) -> None:
    """Encode every text, append ``end_id`` to each document and write shards under ``path``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq, first = bpe.encoder(tokenizer), partition_id(), 0, 0
        width = min_bits(max(enc.vocab_size, end_id + 1))
        doc_ids: list = []
        held: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            data = build_shard(doc_ids, np.concatenate(ends), np.concatenate(held), width)
            some = [d for d in doc_ids if d is not None]
            low, high = (pa.array([f(some) if some else None], pa.int64()) for f in (min, max))
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "first_id": [first], "n_docs": [len(doc_ids)], "n_ids": [n], "low_doc": low, "high_doc": high, "shard": pa.array([data], pa.binary())}
            )

        for batch in batches:
            text = batch.column("text")
            for at, to in text_chunks(text):
                ids, offsets = enc.encode(texts_of(text, at, to), end_id)
                doc_ids += batch.column("doc_id").slice(at, to - at).to_pylist()
                held.append(ids)
                ends.append(n + offsets[1:])
                n += len(ids)
                if n >= SHARD_IDS or len(doc_ids) >= SHARD_DOCS:
                    yield flush()
                    doc_ids, held, ends = [], [], []
                    seq, first, n = seq + 1, first + n, 0
        if doc_ids:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("text").asc_nulls_first()]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("tie"))
    rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(lean(encode), SHARD_SCHEMA).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def part_starts(shards: DataFrame) -> dict[int, int]:
    """Ids before each part: one number per written partition goes to the driver, none per document."""
    out, n = {}, 0
    for part, size in sorted((r[0], r[1]) for r in shards.groupBy("part").agg(F.sum("n_ids")).collect()):
        out[part] = n
        n += size
    return out


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents from the files: doc_id, start (ids before it), n_tokens, ids_crc32, and the ids where asked for."""
    shards = read_shards(spark, path)
    starts = part_starts(shards)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, data in zip(batch.column("part").to_pylist(), batch.column("first_id").to_pylist(), batch.column("shard"), strict=True):
                shard = Shard(data.as_buffer().to_pybytes())
                ids = shard.ids(0, shard.n_ids)
                begin = np.concatenate([[0], shard.ends[:-1]]).astype(np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), shard.ends.tolist(), strict=True)]
                cols = {
                    "doc_id": pa.array(shard.doc_ids.astype(np.int64), mask=~shard.present),
                    "start": starts[part] + first + begin,
                    "n_tokens": shard.ends - begin,
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
                if with_ids:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(np.append(begin, shard.n_ids).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(cols)

    return shards.select("part", "first_id", "shard").mapInArrow(lean(decode), schema)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, ids of the given documents (one row for each that holds the id), unpacked from their blocks alone."""
    wanted = np.unique(np.array(doc_ids, np.int64))
    low, high = (int(wanted[0]), int(wanted[-1])) if len(wanted) else (0, -1)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                shard = Shard(data.as_buffer().to_pybytes())
                rows = np.flatnonzero(shard.present & np.isin(shard.doc_ids, wanted)).tolist()
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(shard.doc_ids[rows].astype(np.int64)), "ids": pa.array([shard.doc(k).astype(np.int32) for k in rows], pa.list_(pa.int32()))})

    near = read_shards(spark, path).where((F.col("low_doc") <= high) & (F.col("high_doc") >= low)).select("shard")
    return near.mapInArrow(find, "doc_id long, ids array<int>")
