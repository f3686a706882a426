"""Byte-level BPE with a cache of words.

A byte-level BPE tokenizer splits a text into pretokens and never merges across them.  A space that stands before a
non-space always begins a pretoken, and so does ASCII punctuation after a Latin letter, so a text can be cut there and
each piece encoded alone.  Natural text repeats its words, and words with different punctuation repeat their stems, so
pieces are encoded once per worker and looked up afterwards.  The ids are those of ``Tokenizer.encode``; texts that hold
a control string (an added token such as ``<|endoftext|>``) are left to it whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Latin letters before a cut, or else whatever stands before the next space that begins a word.
_PIECE = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]++(?=[!-/:-@\[-`{-~]| \S|$)|[\s\S][^ ]*(?: (?!\S)[^ ]*)*")


class _Numbered(dict):
    """text -> number from 0; texts met for the first time are numbered on and noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.chars = self.new_chars = 0

    def __missing__(self, text: str) -> int:
        self[text] = n = len(self)
        self.new.append(text)
        self.new_chars += len(text)
        return n

    def settle(self, keep: bool) -> None:
        """The new texts stay or are forgotten."""
        if keep:
            self.chars += self.new_chars
        else:
            for text in self.new:
                del self[text]
        self.new, self.new_chars = [], 0


def begins_pretoken(piece: str) -> bool:
    """Whatever stands before it, it begins a pretoken, so that such pieces can be joined and cut again: one space, before a non-space."""
    return piece[:1] == " " and piece.count(" ") == 1 and piece[1:2].strip() != ""


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


class WordEncoder:
    """At most ``max_rows`` pieces and ``max_chars`` characters of them are kept; others are encoded anew in each call."""

    def __init__(self, path: str, max_rows: int = 500_000, max_chars: int = 8_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.spaced = np.zeros(self.vocab_size, bool)  # ids that begin with a space
        for token, i in self.tokenizer.get_vocab().items():
            self.spaced[i] = token.startswith("Ġ")
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.control = re.compile("|".join(map(re.escape, added))) if added else None
        self.max_rows, self.max_chars = max_rows, max_chars
        self.pieces = _Numbered()
        self.start, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.n_ids = np.zeros(4096, np.uint32), 0

    def _bulk(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces and how many each has."""
        if all(map(begins_pretoken, pieces)):  # one text, cut again at the ids that begin with a space
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(self.spaced[ids])
            if len(at) == len(pieces) and at[0] == 0:
                return ids, np.diff(np.append(at, len(ids)))
        each = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        size = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter((i for x in each for i in x), np.uint32, int(size.sum())), size

    def _fill(self) -> None:
        """Ids of the new pieces."""
        n, new = len(self.pieces), self.pieces.new
        self.start, self.length = _grown(self.start, n), _grown(self.length, n)
        plain = [k for k, p in enumerate(new) if begins_pretoken(p)]
        odd = sorted(set(range(len(new))).difference(plain))
        for group in (plain, odd):
            for k in range(0, len(group), 2048):
                some = group[k : k + 2048]
                ids, size = self._bulk([new[i] for i in some])
                self.flat = _grown(self.flat, self.n_ids + len(ids))
                self.flat[self.n_ids : self.n_ids + len(ids)] = ids
                rows = n - len(new) + np.array(some)
                self.length[rows] = size
                self.start[rows] = self.n_ids + np.cumsum(size) - size
                self.n_ids += len(ids)

    def encode(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` in order (each text followed by ``end_id``, if given) and ``len(texts) + 1`` offsets."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        rows: list[np.ndarray] = []
        known_ids, look = self.n_ids, self.pieces.__getitem__
        for t in texts:
            pieces = [t] if self.control and self.control.search(t) else _PIECE.findall(t)
            rows.append(np.fromiter(map(look, pieces), np.int64, len(pieces)))
        self._fill()
        at = np.concatenate(rows)
        length = self.length[at]
        ends = np.concatenate([[0], np.cumsum(length)])
        offsets = ends[np.concatenate([[0], np.cumsum([len(r) for r in rows])])]
        ids = self.flat[np.repeat(self.start[at] - ends[:-1], length) + np.arange(int(ends[-1]))]
        keep = len(self.pieces) <= self.max_rows and self.pieces.chars + self.pieces.new_chars <= self.max_chars
        self.pieces.settle(keep)
        if not keep:
            self.n_ids = known_ids
        if end_id is not None:
            ids = np.insert(ids, offsets[1:], np.uint32(end_id))
            offsets = offsets + np.arange(len(texts) + 1)
        return ids, offsets


_ENCODERS: dict[str, WordEncoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str | None = None) -> WordEncoder:
    """The worker's encoder of a tokenizer file; its cache lives as long as the worker."""
    path = path or default_path()
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
