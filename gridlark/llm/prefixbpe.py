"""Exact BPE by dynamic programming over prefixes, and decoding.

Of all ways to cut a pretoken into tokens, BPE gives the one in which every two neighbours are *compatible*: encoding the
two together leaves them as they are.  So each prefix has one possible last token: the token that ends there and is
compatible with the last token of the prefix before it.  An automaton over the vocabulary names the longest token that
ends at every byte, and each token names its own longest suffix that is a token; the candidates are tried in this order,
the one that fits is stored, and the ids follow from the last prefix by back-pointers.  No merge is ever simulated.

Compatibility of (a, b): their boundary is crossed by a merge (x, y) of rank r only if x is the right edge of ``a`` and y the
left edge of ``b`` when merges of rank r run.  The edge of ``a`` is x from the rank that makes x until the rank that makes
the part of ``a`` that x ends; so walking down the right spine of ``a`` and the left spine of ``b`` by falling rank meets
all pairs of edges that are ever neighbours.  At one rank merges run from the left, hence x must still be free after
rank r, y only up to it.

All pretokens of a batch advance together, one byte a step, in numpy; pretokens met before are looked up.  Texts are cut
into pretokens as the tokenizer's own rule does; control strings (added tokens) are one id each.

Edge cases: a null text is the empty text and has no ids; null and repeated ``doc_id`` and repeated rows are kept, a row for
each; very long texts are encoded whole, in time linear in their length; other columns are ignored, whatever their names;
an empty table gives no rows.  There are no ties: the cut is unique.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import bytes_buffer, lean, text_chunks, texts_of

NEVER = np.iinfo(np.int32).max
_BULK = 1 << 16
CHUNK = 1 << 21


def byte_alphabet() -> dict[str, int]:
    """Character of the byte-level alphabet -> byte: printable Latin-1 characters stand for themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def read_spec(path: str) -> dict:
    """A tokenizer file, if it is of the kind that this module knows."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if model["type"] != "BPE" or not plain or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
        raise ValueError("only byte-level BPE without normalizer, prefix space, dropout or word marks has this form")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("added tokens must match exactly")
    return spec


class TokenBytes:
    """The bytes of every id, and texts from ids."""

    def __init__(self, spec: dict):
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        self.raw: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.raw[i] = bytes(map(alphabet.__getitem__, token))
        for token, i in self.added.items():  # a character outside the alphabet leaves the whole token as it is written
            self.raw[i] = bytes(map(alphabet.__getitem__, token)) if set(token) <= alphabet.keys() else token.encode()
        self.length = np.fromiter(map(len, self.raw), np.int64, self.size)
        self.data, self.at = np.frombuffer(b"".join(self.raw), np.uint8), np.cumsum(self.length) - self.length

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of consecutive ids; bytes that are no UTF-8 become U+FFFD."""
        size = self.length[ids]
        to = np.concatenate([[0], np.cumsum(size)])
        data = self.data[np.repeat(self.at[ids] - to[:-1], size) + np.arange(int(to[-1]))].tobytes()
        cuts = to[ends].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:])]


class Vocabulary(TokenBytes):
    """Tables of a byte-level BPE file: bytes, spines and ranks of tokens, the automaton of suffix matches (1 KB a node)."""

    def __init__(self, spec: dict):
        super().__init__(spec)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self._merges([m.split(" ") if isinstance(m, str) else m for m in model["merges"]], vocab)
        own = self._own(sorted(set(vocab.values()) - set(self.added.values())))
        self._automaton(own)

    def _merges(self, merges: list, vocab: dict[str, int]) -> None:
        """The table of pairs by key; ranks and parts of tokens are settled in ``_own``."""
        n = self.size
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        rank = np.arange(len(ids), dtype=np.int32)
        key, first = np.unique(ids[:, 0] * n + ids[:, 1], return_index=True)
        self.key, self.key_rank = key, rank[first]
        self.maybe = np.zeros(1 << 20, bool)  # most pairs are no merge
        self.maybe[self._slot(key)] = True
        self.merges, self.rank = ids, np.full(n, -1, np.int32)
        self.left, self.right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), NEVER, np.int32)
        key = a.astype(np.int64) * self.size + b
        some = np.flatnonzero(self.maybe[self._slot(key)])
        if len(some):
            at = np.minimum(np.searchsorted(self.key, key[some]), len(self.key) - 1)
            hit = self.key[at] == key[some]
            out[some[hit]] = self.key_rank[at[hit]]
        return out

    def _own(self, tokens: list[int]) -> np.ndarray:
        """Tokens that their own bytes encode to.  Shorter ones first: (a, b) makes such a token if both are, and no merge crosses them before."""
        own = np.zeros(self.size, bool)
        for i in tokens:
            if len(self.raw[i]) == 1:
                own[i] = True
        if own.sum() < 256:
            raise ValueError("every byte must be a token")
        size = self.length[self.merges[:, 2]]
        for n in np.unique(size):
            rows = np.flatnonzero((size == n) & own[self.merges[:, 0]] & own[self.merges[:, 1]])
            a, b, c = self.merges[rows].T
            rows = rows[self.first_crossing(a, b) == rows]  # rows of the first crossing are ranks
            a, b, c = self.merges[rows].T
            if (np.maximum(self.rank[a], self.rank[b]) >= rows).any():
                raise ValueError("a merge stands before those that make its parts")
            own[c], self.rank[c], self.left[c], self.right[c] = True, rows, a, b
        return own

    def first_crossing(self, a: np.ndarray, b: np.ndarray, any_will_do: bool = False) -> np.ndarray:
        """Least rank of a merge that crosses the boundary of own tokens ``a``, ``b`` (or of any that does); NEVER if they are compatible."""
        out = np.full(len(a), NEVER, np.int32)
        at, x, y = np.arange(len(a)), a.astype(np.int32), b.astype(np.int32)
        x_free, y_free = out.copy(), out.copy()  # ranks that use up x and y
        while len(at):
            r = self.pair_rank(x, y)
            met = (r < x_free) & (r <= y_free) & (r < NEVER)
            out[at[met]] = np.minimum(out[at[met]], r[met])
            rx, ry = self.rank[x], self.rank[y]
            go = np.flatnonzero((np.maximum(rx, ry) >= 0) & ~(met & any_will_do))
            at, x, y, x_free, y_free, rx, ry = (v[go] for v in (at, x, y, x_free, y_free, rx, ry))
            down = rx >= ry
            x_free, y_free = np.where(down, rx, x_free), np.where(down, y_free, ry)
            x, y = np.where(down, self.right[x], x), np.where(down, y, self.left[y])
        return out

    def _automaton(self, own: np.ndarray) -> None:
        """``step`` [node, byte] -> node, ``longest`` [node] -> token that ends there, ``shorter`` [token] -> its longest proper suffix that is one."""
        tokens = np.flatnonzero(own)
        size = self.length[tokens]
        data = np.frombuffer(b"".join(self.raw[i] for i in tokens), np.uint8)
        start = np.cumsum(size) - size
        node, levels, n_nodes = np.zeros(len(tokens), np.int64), [], 1
        for d in range(int(size.max())):
            rows = np.flatnonzero(size > d)
            key, back = np.unique(node[rows] * 256 + data[start[rows] + d], return_inverse=True)
            node[rows] = n_nodes + back
            levels.append((n_nodes, key))
            n_nodes += len(key)
        ends = np.full(n_nodes, -1, np.int32)
        ends[node] = tokens
        self.step = np.zeros((n_nodes, 256), np.int32)
        self.longest, fall = ends.copy(), np.zeros(n_nodes, np.int64)
        for first, key in levels:
            nodes, parent, byte = first + np.arange(len(key)), key >> 8, key & 255
            if first > 1:
                fall[nodes] = self.step[fall[parent], byte]
            self.step[parent, byte] = nodes
            none = ends[nodes] < 0
            self.longest[nodes[none]] = self.longest[fall[nodes[none]]]
            # children of this level's nodes are set when the next level comes; until then a node steps as its longest suffix does
            self.step[nodes] = self.step[fall[nodes]]
        self.shorter = np.full(self.size, -1, np.int32)
        self.shorter[tokens] = self.longest[fall[node]]
        self.shorter[tokens[size == 1]] = -1

    def cut(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pretokens (``size`` bytes each, one after the other in ``data``) and how many each has."""
        start = np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")
        begin, count = start[order], size[order]
        last = np.full(len(data), -1, np.int32)
        node = np.zeros(len(order), np.int32)
        for e in range(int(count[0]) if len(count) else 0):
            m = int(np.searchsorted(-count, -e, side="left"))  # pretokens of more than e bytes
            here = begin[:m] + e
            node[:m] = self.step[node[:m], data[here]]
            rows, token = np.arange(m), self.longest[node[:m]]
            while len(rows):
                before = here[rows] - self.length[token]
                whole = before < begin[rows]
                fits = whole.copy()
                more = np.flatnonzero(~whole)
                if len(more):
                    fits[more] = self.first_crossing(last[before[more]], token[more], any_will_do=True) == NEVER
                last[here[rows[fits]]] = token[fits]
                rows, token = rows[~fits], self.shorter[token[~fits]]
        used = np.zeros(len(data), bool)
        at, rows = begin + count - 1, np.arange(len(order))
        rows = rows[count > 0]
        while len(rows):  # back-pointers
            used[at[rows]] = True
            at[rows] -= self.length[last[at[rows]]]
            rows = rows[at[rows] >= begin[rows]]
        ends = np.concatenate([[0], np.cumsum(used)])
        return last[used].astype(np.uint32), ends[start + size] - ends[start]


class PrefixEncoder(bpe.WordEncoder):
    """The cache of words of ``bpe``, filled by the table of last tokens instead of the library's encoder."""

    def __init__(self, path: str, max_rows: int = 500_000, max_chars: int = 8_000_000):
        super().__init__(path, max_rows, max_chars)
        self.vocabulary = Vocabulary(read_spec(path))
        self.as_byte = np.zeros(0x200, np.uint8)
        for c, b in byte_alphabet().items():
            self.as_byte[ord(c)] = b
        self.rule = self.tokenizer.pre_tokenizer.pre_tokenize_str

    def _joins(self, piece: str) -> bool:
        """It may be joined to other pieces, and holds no control string."""
        return bpe.begins_pretoken(piece) and not (self.control and self.control.search(piece))

    def _pretokens(self, pieces: list[str]) -> tuple[list[str], np.ndarray]:
        """Pretokens in the byte-level alphabet, and of which piece each is part.  An added token is a pretoken of its own, marked by None."""
        if self._joins(pieces[0]):  # then all do, see _fill
            ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
            found = self.rule("".join(pieces))
            begins = np.fromiter((at[0] for _, at in found), np.int64, len(found))
            return [t for t, _ in found], np.searchsorted(ends, begins, side="right")
        tokens, owner = [], []
        for k, piece in enumerate(pieces):
            at = 0
            for m in self.control.finditer(piece) if self.control else ():
                tokens += [t for t, _ in self.rule(piece[at : m.start()])] if at < m.start() else []
                owner += [k] * (len(tokens) - len(owner))
                tokens.append(None)
                owner.append(k)
                at = m.end()
                self.met.append(m.group())
            tokens += [t for t, _ in self.rule(piece[at:])] if at < len(piece) else []
            owner += [k] * (len(tokens) - len(owner))
        return tokens, np.array(owner, np.int64)

    def _bulk(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self.met: list[str] = []
        tokens, owner = self._pretokens(pieces)
        size = np.fromiter((0 if t is None else len(t) for t in tokens), np.int64, len(tokens))
        data = self.as_byte[np.frombuffer("".join(t for t in tokens if t is not None).encode("utf-16-le"), np.uint16)]
        ids, count = self.vocabulary.cut(data, size)
        if self.met:
            at = np.flatnonzero(size == 0)
            place = np.concatenate([[0], np.cumsum(count)])[at]
            ids = np.insert(ids, place, np.array([self.vocabulary.added[t] for t in self.met], np.uint32))
            count[at] = 1
        return ids, np.bincount(owner, weights=count, minlength=len(pieces)).astype(np.int64)

    def _fill(self) -> None:
        """Ids of the new pieces, many at once, so that a step of the table serves many pretokens."""
        n, new = len(self.pieces), self.pieces.new
        self.start, self.length = bpe._grown(self.start, n), bpe._grown(self.length, n)
        plain = [k for k, p in enumerate(new) if self._joins(p)]
        odd = sorted(set(range(len(new))).difference(plain))
        for group in (plain, odd):
            for k in range(0, len(group), _BULK):
                some = group[k : k + _BULK]
                ids, size = self._bulk([new[i] for i in some])
                self.flat = bpe._grown(self.flat, self.n_ids + len(ids))
                self.flat[self.n_ids : self.n_ids + len(ids)] = ids
                rows = n - len(new) + np.array(some)
                self.length[rows] = size
                self.start[rows] = self.n_ids + np.cumsum(size) - size
                self.n_ids += len(ids)


_ENCODERS: dict[str, PrefixEncoder] = {}


def encoder(path: str | None = None) -> PrefixEncoder:
    """The worker's encoder of a tokenizer file; its cache lives as long as the worker."""
    path = path or bpe.default_path()
    if path not in _ENCODERS:
        _ENCODERS[path] = PrefixEncoder(path)
    return _ENCODERS[path]


_DECODERS: dict[str, TokenBytes] = {}


def decoder(path: str | None = None) -> TokenBytes:
    path = path or bpe.default_path()
    if path not in _DECODERS:
        _DECODERS[path] = TokenBytes(read_spec(path))
    return _DECODERS[path]


def _id_lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    data, cuts = ids.astype("<u4").tobytes(), (4 * ends).tolist()
    return pa.array([data[a:b] for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())


def encode_documents(docs: DataFrame, tokenizer: str | None = None, decoded: bool = False) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) of every text; with ``decoded`` also the text of these ids, by the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            doc_id, text = batch.column(0), batch.column(1)
            for at, to in text_chunks(text, CHUNK):
                ids, ends = enc.encode(texts_of(text, at, to))
                cols = [doc_id.slice(at, to - at), _id_lists(ids, ends)]
                if decoded:
                    cols.append(pa.array(enc.vocabulary.texts(ids, ends), pa.string()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "text"][: len(cols)])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, ids binary" + ", text string" * decoded)


def decode_documents(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids, text of the ids; null ids have the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = decoder(tokenizer)
        for batch in batches:
            for at, to in text_chunks(batch.column(1), CHUNK):
                doc_id, col = batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at)
                data, ends = bytes_buffer(col.fill_null(b""))
                texts = tokens.texts(np.frombuffer(data.tobytes(), "<u4"), ends // 4)
                yield pa.RecordBatch.from_arrays([doc_id, col, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, ids binary, text string")
