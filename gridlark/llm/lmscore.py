"""Masked pseudo-likelihood: a bidirectional window network scores documents.

All lower-cased words of the corpus are counted.  The vocabulary is the most frequent ones; its size grows with the corpus
(``side`` squared, see ``vocabulary_side``).  The network predicts a token from ``SIDE`` words on either side: embeddings by
relative place are summed, go through tanh, and a two-level softmax gives first the class of the token, then the token within
its class; a word outside the vocabulary is a class of its own.  Its biases start at the corpus frequencies.  Which word
it is comes from its spelling: P(byte | the two bytes before), counted over all occurrences of such words, so that real
rare words and noise are told apart and every string has a probability.

Training is data-parallel and covers every position of every document once: in each of ``rounds`` rounds, every task starts
from the shared weights, masks the positions whose turn it is (by hash), runs Adagrad in numpy on them, and the weights are
averaged over tasks by token count through a shuffle on weight blocks.  Scoring predicts every token of every document from
both sides; the sum of the log probabilities is the document's pseudo-log-likelihood.

Edge cases: null or empty texts have no tokens, score 0.0 and a null mean; words past the edges are a padding id; repeated
rows and ids are scored alike, row by row; very long texts are taken whole; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_buffer, lean, splitmix, staged, text_chunks, texts_of, utf8_buffer

SIDE, WIDTH = 2, 16
PAD = 0
BLOCK = 1024
#: Bytes in a spelling and after it: values, a mark of the end, and the context of the two before (folded to 6 bits each).
END, SYMBOLS, CONTEXTS = 256, 257, 1 << 12


class Model(NamedTuple):
    side: int  # classes of the vocabulary, and members of each
    ids: dict[str, int]
    counts: np.ndarray  # how often each id occurs; the last id stands for all other words
    spelling: np.ndarray  # log P(symbol | context)


def vocabulary_side(n_tokens: int) -> int:
    """32 to 255 (ids take two bytes): 64 for 134 million tokens, growing with the power 2/9, so the vocabulary with 4/9."""
    return int(min(255, max(32, round(n_tokens ** (2 / 9)))))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n: every lower-cased word of the corpus, as a written table.  Tasks count what they can hold before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for at, to in text_chunks(b.column(0)):
                for t in texts_of(b.column(0), at, to):
                    seen.update(t.lower().split())
                if len(seen) > 300_000:
                    yield pa.RecordBatch.from_pydict({"word": list(seen), "n": list(seen.values())})
                    seen.clear()
        if seen:
            yield pa.RecordBatch.from_pydict({"word": list(seen), "n": list(seen.values())})

    found = docs.select(F.col(text).cast("string")).mapInArrow(lean(count), "word string, n long")
    return staged(found.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def _symbols(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """context * SYMBOLS + symbol of every byte and end of the words, and the first place of each word."""
    data, offsets = utf8_buffer(words)
    n = np.diff(offsets)
    first = np.cumsum(n + 1) - (n + 1)
    sym = np.full(int((n + 1).sum()), END, np.int64)
    inside = np.arange(len(data)) + np.repeat(np.arange(len(n)), n)
    sym[inside] = data
    fold = np.concatenate([np.zeros(2, np.int64), (sym & 63) ^ (sym >> 6)])
    back = np.arange(len(sym)) - np.repeat(first, n + 1)
    context = np.where(back > 0, fold[1:-1] & 63, 0) | np.where(back > 1, fold[:-2] & 63, 0) << 6
    return context * SYMBOLS + sym, first


def spelling(words: DataFrame) -> np.ndarray:
    """log P(symbol | context) over the words (word, n), each as often as it occurs.  A table of fixed size a task, summed by a shuffle."""
    size = CONTEXTS * SYMBOLS
    rows = -(-size // BLOCK)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(rows * BLOCK)
        for b in batches:
            code, first = _symbols(b.column(0))
            weight = np.repeat(np.asarray(b.column(1), dtype=float), np.diff(np.append(first, len(code))))
            total += np.bincount(code, weight, minlength=len(total))
        full = total.reshape(rows, BLOCK)
        some = np.flatnonzero(full.any(axis=1))
        yield pa.RecordBatch.from_pydict({"block": some, "sums": pa.array([full[k].tobytes() for k in some], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(x)
        if sums:
            yield pa.RecordBatch.from_pydict({"block": list(sums), "sums": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    schema = "block long, sums binary"
    out = np.zeros(rows * BLOCK)
    for k, x in words.select("word", "n").mapInArrow(lean(count), schema).repartition("block").mapInArrow(add, schema).collect():  # CONTEXTS * SYMBOLS numbers at most
        out[k * BLOCK : (k + 1) * BLOCK] = np.frombuffer(x)
    table = out[:size].reshape(CONTEXTS, SYMBOLS)
    base = (table.sum(axis=0) + 0.1) / (table.sum() + 0.1 * SYMBOLS)
    table = (table + 4.0 * base) / (table.sum(axis=1, keepdims=True) + 4.0)
    return np.log(table).astype(np.float32).reshape(-1)


def gather(docs: DataFrame, text: str = "text") -> Model:
    """What is counted over the whole corpus before training."""
    words = word_counts(docs, text)
    total = words.agg(F.sum("n")).first()[0] or 0
    side = vocabulary_side(total)
    top = words.orderBy(F.desc("n"), "word").limit(side * side - 1).collect()  # bounded by the vocabulary
    # neighbours in frequency share a class
    ids = {r[0]: i + 1 for i, r in enumerate(top)}
    counts = np.full(side * side + 1, 0.5)
    for r in top:
        counts[ids[r[0]]] += r[1]
    counts[-1] += max(0, total - sum(r[1] for r in top))
    last = top[-1] if len(top) == side * side - 1 else None
    others = words.where((F.col("n") < last[1]) | ((F.col("n") == last[1]) & (F.col("word") > last[0]))) if last else words.limit(0)
    return Model(side, ids, counts, spelling(others))


class Speller(dict):
    """word -> number from ``first`` on, for words outside the vocabulary, kept while they are few."""

    KEPT = 300_000

    def __init__(self, ids: dict[str, int], first: int, table: np.ndarray):
        super().__init__(ids)
        self.ids, self.first, self.table = ids, first, table
        self.new: list[str] = []
        self.logp = np.zeros(0, np.float64)

    def __missing__(self, word: str) -> int:
        self[word] = n = self.first + len(self.logp) + len(self.new)
        self.new.append(word)
        return n

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of each text (``first`` for all words outside the vocabulary), and the log probability of their spellings."""
        if len(self.logp) > self.KEPT:
            self.clear()
            self.update(self.ids)
            self.logp = np.zeros(0, np.float64)
        found = []
        for t in texts:
            words = t.lower().split()
            found.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
        if self.new:
            code, first = _symbols(pa.array(self.new, pa.string()))
            self.logp = np.concatenate([self.logp, np.add.reduceat(self.table[code].astype(np.float64), first)])
            self.new = []
        spelled = np.array([self.logp[x[x >= self.first] - self.first].sum() for x in found])
        return [np.minimum(x, self.first).astype(np.uint16) for x in found], spelled


def token_ids(docs: DataFrame, model: Model, id_col: str, text: str = "text") -> DataFrame:
    """``id_col``, the token ids of each text (two bytes each) and the log probability of its rare words' spellings."""
    shared = docs.sparkSession.sparkContext.broadcast((model.ids, model.spelling))  # bounded by the vocabulary and the table of spellings
    first = model.side * model.side

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(shared.value[0], first, shared.value[1])
        for b in batches:
            for at, to in text_chunks(b.column(1)):
                ids, spelled = speller.encode(texts_of(b.column(1), at, to))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(spelled, pa.float64())], names=[id_col, "ids", "spelled"])

    rows = docs.select(id_col, F.col(text).cast("string"))
    return rows.mapInArrow(lean(encode), rows.select(id_col).schema.add("ids", "binary").add("spelled", "double"))


def shapes(side: int) -> dict[str, tuple[int, ...]]:
    """Weights for ``side`` classes of ``side`` tokens, and one class for all other words."""
    return {"embed": (2 * SIDE, side * side + 1, WIDTH), "hidden": (WIDTH,), "class_w": (WIDTH, side + 1), "class_b": (side + 1,), "token_w": (side, WIDTH, side), "token_b": (side, side)}


def side_of(w: dict[str, np.ndarray]) -> int:
    return len(w["token_b"])


def initial(counts: np.ndarray, side: int, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = counts[:-1].reshape(side, side)
    w = {k: np.zeros(s, np.float32) for k, s in shapes(side).items()}
    for k, spread in (("embed", 0.1), ("class_w", 0.05), ("token_w", 0.05)):
        w[k] = (rng.standard_normal(w[k].shape) * spread).astype(np.float32)
    classes = np.append(p.sum(axis=1), counts[-1])
    w["class_b"] = np.log(classes / classes.sum()).astype(np.float32)
    w["token_b"] = np.log(p / p.sum(axis=1, keepdims=True)).astype(np.float32)
    return w


def flatten(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.reshape(-1) for v in w.values()])


def unflatten(v: np.ndarray, side: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes(side).items():
        n = math.prod(s)
        out[k] = v[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def streams(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges, their ids with ``SIDE`` padding ids before and after each text, and the number of tokens of each."""
    for at, to in text_chunks(col):
        data, offsets = bytes_buffer(col.slice(at, to - at))
        n = np.diff(offsets) // 2
        out = np.full(int(n.sum()) + SIDE * (len(n) + 1), PAD, np.int64)
        out[_places(n)] = np.ascontiguousarray(data).view(np.uint16)
        yield at, to, out, n


def _hidden(w: dict[str, np.ndarray], context: list[np.ndarray]) -> np.ndarray:
    h = w["embed"][0][context[0]]
    for k in range(1, 2 * SIDE):
        h += w["embed"][k][context[k]]
    h += w["hidden"]
    return np.tanh(h, out=h)


def _context(ids: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return [ids[at + j] for j in range(-SIDE, SIDE + 1) if j]


def _reach(w: np.ndarray, b: np.ndarray) -> float:
    """How far from 0 any score can be, as hidden values are within 1."""
    return float((np.abs(w).sum(axis=-2) + np.abs(b)).max())


def _softmax(z: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """exp(z), less the row maximum where it could overflow, in place of z, and its row sums."""
    if reach > 60:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], z.dtype)


def _log_share(z: np.ndarray, column: np.ndarray, reach: float) -> np.ndarray:
    e, total = _softmax(z, reach)
    return np.log(np.maximum(e[np.arange(len(e)), column] / total, np.float32(1e-30)))


def _by_class(cls: np.ndarray, side: int) -> Iterator[tuple[int, np.ndarray]]:
    """Classes of the vocabulary that occur, and the rows of each."""
    order = np.argsort(cls.astype(np.uint16), kind="stable")
    bounds = np.searchsorted(cls[order], np.arange(side + 1))
    for c in np.flatnonzero(np.diff(bounds)):
        yield int(c), order[bounds[c] : bounds[c + 1]]


def log_probs(w: dict[str, np.ndarray], ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log probability of the token at each place, from both sides; for a word outside the vocabulary, that it is one."""
    h, side = _hidden(w, _context(ids, at)), side_of(w)
    cls, member = ids[at] // side, ids[at] % side
    out = _log_share(h @ w["class_w"] + w["class_b"], cls, _reach(w["class_w"], w["class_b"]))
    reach = _reach(w["token_w"], w["token_b"])
    for c, rows in _by_class(cls, side):
        out[rows] += _log_share(h[rows] @ w["token_w"][c] + w["token_b"][c], member[rows], reach)
    return out


class Trainer:
    """Adagrad on a copy of the shared weights."""

    def __init__(self, w: dict[str, np.ndarray], rate: float):
        self.w = {k: v.copy() for k, v in w.items()}
        self.g2 = {k: np.full(v.shape, 1e-3, np.float32) for k, v in w.items()}
        self.rate, self.n = rate, 0

    def _step(self, key: str, grad: np.ndarray, where: object = ...) -> None:
        self.g2[key][where] += grad * grad
        self.w[key][where] -= self.rate * grad / np.sqrt(self.g2[key][where])

    def learn(self, ids: np.ndarray, at: np.ndarray) -> None:
        n = len(at)
        if not n:
            return
        w, context = self.w, _context(ids, at)
        h = _hidden(w, context)
        side = side_of(w)
        cls, member = ids[at] // side, ids[at] % side
        d, total = _softmax(h @ w["class_w"] + w["class_b"], _reach(w["class_w"], w["class_b"]))
        d /= (total * n)[:, None]
        d[np.arange(n), cls] -= 1 / n
        reach = _reach(w["token_w"], w["token_b"])
        dh = d @ w["class_w"].T
        class_w, class_b = h.T @ d, d.sum(axis=0)
        for c, rows in _by_class(cls, side):
            own = h[rows]
            e, total = _softmax(own @ w["token_w"][c] + w["token_b"][c], reach)
            e /= (total * n)[:, None]
            e[np.arange(len(rows)), member[rows]] -= 1 / n
            dh[rows] += e @ w["token_w"][c].T
            self._step("token_w", own.T @ e, c)
            self._step("token_b", e.sum(axis=0), c)
        self._step("class_w", class_w)
        self._step("class_b", class_b)
        dz = (dh * (1 - h * h)).astype(np.float32)
        self._step("hidden", dz.sum(axis=0))
        for k in range(2 * SIDE):
            order = np.argsort(context[k].astype(np.uint16), kind="stable")
            seen = context[k][order]
            first = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]]))
            self._step("embed", np.add.reduceat(dz[order], first, axis=0), (k, seen[first]))
        self.n += n


def _places(n: np.ndarray) -> np.ndarray:
    """Places of tokens in a padded stream of texts with ``n`` tokens each."""
    return np.arange(n.sum()) + SIDE * (1 + np.repeat(np.arange(len(n)), n))


def _masked(n: np.ndarray, turn: int, rounds: int, seen: int) -> np.ndarray:
    """The places of a stream that are masked in round ``turn``: each place in one round."""
    place = _places(n)
    draw = splitmix(place.astype(np.uint64) + np.uint64(seen))
    return place[(draw >> np.uint64(32)) % np.uint64(rounds) == np.uint64(turn)]


def train(encoded: DataFrame, counts: np.ndarray, side: int, rounds: int = 2, rate: float = 0.1, batch: int = 8192) -> np.ndarray:
    """Weights, from the token ids of all documents.  What reaches the driver is one set of weights a round."""
    spark = encoded.sparkSession
    weights = flatten(initial(counts, side))
    size = -(-len(weights) // BLOCK)
    rows = encoded.select("ids")
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(weights)  # bounded by the vocabulary

        def local(batches: Iterator[pa.RecordBatch], turn: int = r, shared=shared) -> Iterator[pa.RecordBatch]:
            start = shared.value
            trainer, seen = Trainer(unflatten(start, side), rate), 0
            for b in batches:
                for _, _, stream, n in streams(b.column(0)):
                    chosen = _masked(n, turn, rounds, seen)
                    for k in range(0, len(chosen), batch):
                        trainer.learn(stream, chosen[k : k + batch])
                    seen += len(stream)
            if trainer.n:
                change = np.zeros(size * BLOCK, np.float64)
                change[: len(start)] = (flatten(trainer.w) - start) * float(trainer.n)
                yield pa.RecordBatch.from_pydict(
                    {"block": np.arange(size), "n": np.full(size, trainer.n), "change": pa.array([c.astype(np.float32).tobytes() for c in change.reshape(size, BLOCK)], pa.binary())}
                )

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            count: dict[int, int] = {}
            for b in batches:
                for k, n, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    total[k] = total.get(k, 0.0) + np.frombuffer(c, np.float32).astype(np.float64)
                    count[k] = count.get(k, 0) + n
            if total:
                yield pa.RecordBatch.from_pydict({"block": list(total), "n": [count[k] for k in total], "change": pa.array([(total[k] / count[k]).astype(np.float32).tobytes() for k in total], pa.binary())})

        schema = "block long, n long, change binary"
        mean = rows.mapInArrow(lean(local), schema).repartition("block").mapInArrow(average, schema)
        step = np.zeros(size * BLOCK, np.float32)
        for k, _, c in mean.collect():
            step[k * BLOCK : (k + 1) * BLOCK] = np.frombuffer(c, np.float32)
        weights = (weights + step[: len(weights)]).astype(np.float32)
    return weights


def score(encoded: DataFrame, weights: np.ndarray, side: int) -> DataFrame:
    """The first column of ``encoded``, n_tokens, log_likelihood (sum over all tokens) and its mean a token."""
    id_col = encoded.columns[0]
    shared = encoded.sparkSession.sparkContext.broadcast(weights)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = unflatten(shared.value, side)
        for b in batches:
            for at, to, stream, n in streams(b.column(1)):
                place = _places(n)
                lp = np.concatenate([log_probs(w, stream, place[k : k + 8192]) for k in range(0, len(place), 8192)] or [np.zeros(0)]).astype(np.float64)
                sums = np.diff(np.concatenate([[0.0], np.cumsum(lp)])[np.concatenate([[0], np.cumsum(n)])]) + np.asarray(b.column(2).slice(at, to - at))
                mean = pa.array(np.round(sums / np.maximum(n, 1), 6), mask=n == 0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), pa.array(n), pa.array(np.round(sums, 4)), mean], names=[id_col, "n_tokens", "log_likelihood", "mean_log_likelihood"])

    rows = encoded.select(id_col, "ids", "spelled")
    schema = rows.select(id_col).schema.add("n_tokens", "long").add("log_likelihood", "double").add("mean_log_likelihood", "double")
    return rows.mapInArrow(lean(run), schema)


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Scores of all documents by a network that is trained on them."""
    model = gather(docs, text)
    encoded = staged(token_ids(docs, model, id_col, text), "token-ids")
    return score(encoded, train(encoded, model.counts, model.side, **options), model.side)
