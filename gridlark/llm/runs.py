"""Periodic runs of words, by Lyndon roots from the grouping phase of a suffix sorter.

A run is a stretch of words with smallest period q, at least ``max(min_length, 2 q)`` long, that no neighbouring word extends
with the same period.  Every run holds a Lyndon root: under one of the two orders of words (ascending, descending; the end
of the text below all words), the longest Lyndon word that begins at some place of the run is q long.

The grouping phase (Baier's first phase) gives these lengths directly, without the sorted suffixes.  Suffixes begin in
groups by first word.  The highest group that is left is closed: its word, the group's context, is the longest Lyndon
word at each of its members.  Each open suffix before a member (the nearest to the left) is followed by that context, once
or several times in a row; the context is appended to its own, and it moves, with those of the same group and count, to a
new group right above its old one.  A linked list of open places gives the nearest ones; a segment of the suffix order
holds each group.  Here the phase runs on all texts of a chunk at once: a step closes one group in every text, in numpy.

Each candidate (place, root length) is extended to both sides by longest common extensions (binary search on prefix hashes);
runs are then compared word by word, and a collision of hashes sends its candidates to plain comparison.  A word that
occurs once in its text lies in no run, so such words cut the text and the phase sees the stretches between them.

Edge cases: null and empty texts and texts without words have no runs and the empty collapsed text; null and repeated
``doc_id`` and repeated rows are kept, a row for each; very long texts are taken whole (about 100 bytes a word in memory,
steps as many as groups); other columns are ignored, whatever their names; an empty table gives no rows.  Runs of one
place and several periods are all kept, in order of start, then period.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, splitmix, text_chunks

WORD = re.compile(rb"[^ \t-\r]+")
CHUNK = 1 << 24
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
Edit = Callable[["int | None", list[bytes]], list[bytes]]


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``start[0], start[0] + 1, ...`` (``size[0]`` numbers), then those of the next."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


def lyndon_lengths(letters: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place of the strings ``letters[starts[k]:starts[k + 1]]``."""
    n, size = len(letters), np.diff(starts)
    of = np.repeat(np.arange(len(size)), size)
    key = of * (int(letters.max(initial=0)) + 1) + letters
    order = np.argsort(key, kind="stable")
    slot = np.empty(n, np.int64)
    slot[order] = np.arange(n)
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    group_end = np.zeros(n + 1, np.int64)  # by the group's first slot
    group_end[first] = np.append(first[1:], n)
    group = np.empty(n, np.int64)  # of a place: its first slot
    group[order] = np.repeat(first, group_end[first] - first)
    left, right = np.arange(-1, n), np.arange(1, n + 2)  # open neighbours; n is none
    left[starts[:-1][size > 0]] = n
    right[starts[1:][size > 0] - 1] = n
    context, moved = np.ones(n + 1, np.int64), np.zeros(n, bool)
    low, top = starts[:-1][size > 0].astype(np.int64), starts[1:][size > 0].astype(np.int64)
    while len(low):
        begin = group[order[top - 1]]
        members = np.sort(order[ranges(begin, top - begin)])
        before = left[members]
        head = np.ones(len(members), bool)
        head[1:] = before[1:] != members[:-1]  # neighbours in the list follow each other directly
        head = np.flatnonzero(head)
        tail = np.append(head[1:], len(members)) - 1
        times = tail - head + 1
        prior, after = before[head], right[members[tail]]
        right[prior] = after
        left[after] = prior
        real = prior < n
        prior, times, grown = prior[real], times[real], context[members[head[real]]]
        context[prior] += times * grown
        if len(prior):
            old = group[prior]
            by = np.lexsort((times, old))
            prior, times, old = prior[by], times[by], old[by]
            opens = np.flatnonzero(np.diff(old, prepend=-1))  # of each old group
            count = np.diff(np.append(opens, len(old)))
            end = group_end[old[opens]]
            stay = end - count
            to = ranges(stay, count)
            moved[prior] = True
            there, came = order[to], slot[prior]
            there, vacant = there[~moved[there]], came[came < np.repeat(stay, count)]
            moved[prior] = False
            order[vacant], slot[there] = there, vacant
            order[to], slot[prior] = prior, to
            group_end[old[opens]] = stay
            new = np.ones(len(old), bool)
            new[1:] = (old[1:] != old[:-1]) | (times[1:] != times[:-1])
            new = np.flatnonzero(new)
            last = np.append(new[1:], len(old)) - 1
            group_end[to[new]] = to[last] + 1
            group[prior] = np.repeat(to[new], last - new + 1)
        going = begin > low
        low, top = low[going], begin[going]
    return context[:n]


class _Extensions:
    """Longest common extensions inside the strings, by prefix hashes; equal hashes may lie, different ones do not."""

    def __init__(self, letters: np.ndarray, starts: np.ndarray):
        n, size = len(letters), np.diff(starts)
        self.letters = letters
        self.first, self.end = np.repeat(starts[:-1], size), np.repeat(starts[1:], size)
        self.power = np.ones(n + 1, np.uint64)
        self.power[1:] = np.uint64(0x9E3779B97F4A7C15)
        np.multiply.accumulate(self.power, out=self.power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(splitmix(letters.astype(np.uint64) + np.uint64(1)) * self.power[:-1], out=self.sums[1:])

    def same(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[i + size] - self.sums[i]) * self.power[j - i] == self.sums[j + size] - self.sums[j]

    def both(self, i: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far the words before and from ``i`` equal those ``p`` further on."""
        out = []
        for most, shift in ((i - self.first[i], -1), (self.end[i] - i - p, 0)):
            lo, hi = np.zeros_like(most), most + 1  # lo fits, hi does not
            while (go := np.flatnonzero(hi - lo > 1)).size:
                mid = (lo[go] + hi[go]) >> 1
                at = i[go] + shift * mid
                fits = self.same(at, at + p[go], mid)
                lo[go], hi[go] = np.where(fits, mid, lo[go]), np.where(fits, hi[go], mid)
            out.append(lo)
        return out[0], out[1]

    def plainly(self, i: int, p: int) -> tuple[int, int]:
        a, (lo, hi) = self.letters, (int(self.first[i]), int(self.end[i]))
        back = a[lo:i][::-1] != a[lo + p : i + p][::-1]
        on = a[i : hi - p] != a[i + p : hi]
        return (int(back.argmax()) if back.any() else len(back)), (int(on.argmax()) if on.any() else len(on))


def find_runs(letters: np.ndarray, starts: np.ndarray, min_length: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length, period of all runs of the strings, in order of start, then period."""
    if not len(letters):
        return (np.zeros(0, np.int64),) * 3
    ext, top = _Extensions(letters, starts), int(letters.max())
    found = []
    for order in (letters, top - letters):
        p = lyndon_lengths(order, starts)
        i = np.arange(len(letters))
        on, back = i + p < ext.end, i > ext.first
        on[on] = letters[i[on]] == letters[(i + p)[on]]
        back[back] = letters[i[back] - 1] == letters[(i + p)[back] - 1]
        i = np.flatnonzero(on | back)
        found.append(np.stack([i, p[i]]))
    i, p = np.unique(np.concatenate(found, axis=1), axis=1)
    b, f = ext.both(i, p)
    long = b + f + p >= np.maximum(min_length, 2 * p)
    i, p, b, f = i[long], p[long], b[long], f[long]
    rows, back = np.unique(np.stack([i - b, p, b + f]), axis=1, return_inverse=True)
    start, period, same = rows
    at = ranges(start, same)
    wrong = np.flatnonzero(letters[at] != letters[at + np.repeat(period, same)])
    bad = np.zeros(len(start), bool)
    bad[np.searchsorted(np.cumsum(same), wrong, side="right")] = True
    if bad.any():
        b, f = b.copy(), f.copy()
        for k in np.flatnonzero(bad[back.reshape(-1)]):
            b[k], f[k] = ext.plainly(int(i[k]), int(p[k]))
        long = b + f + p >= np.maximum(min_length, 2 * p)
        start, period, same = np.unique(np.stack([i - b, p, b + f])[:, long], axis=1)
    return start, same + period, period


def _runs_of(words: list[list[bytes]], min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for lists of words, starts counted over all of them; and which words no run repeats."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    n = int(n_words.sum())
    letters = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, n)
    of = np.repeat(np.arange(len(words)), n_words)
    _, back, often = np.unique(of * (len(numbers) + 1) + letters, return_inverse=True, return_counts=True)
    again = often[back] > 1  # others are in no run and cut the text
    begins = np.flatnonzero(again & (np.diff(np.where(again, of, -1), prepend=-2) != 0))
    ends = np.flatnonzero(again & (np.diff(np.where(again, of, -1), append=-2) != 0)) + 1
    fit = ends - begins >= min_length
    begins, ends = begins[fit], ends[fit]
    places = ranges(begins, ends - begins)
    start, length, period = find_runs(letters[places], np.concatenate([[0], np.cumsum(ends - begins)]), min_length)
    start = places[start]
    change = np.bincount(start + period, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return start, length, period, np.cumsum(change)[:n] == 0


def periodic_runs(docs: DataFrame, min_length: int = 12, edit: Edit | None = None) -> DataFrame:
    """doc_id, n_words, runs (start: number of the first word, length, period), collapsed (the text without words that a run
    repeats, one space between words).  ``edit`` may replace a document's words before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in text_chunks(batch.column(1), CHUNK):
                doc_id = batch.column(0).slice(at, to - at)
                text = batch.column(1).cast(pa.large_binary()).slice(at, to - at)
                words = [WORD.findall(t or b"") for t in text.to_pylist()]
                if edit is not None:
                    words = list(map(edit, doc_id.to_pylist(), words))
                start, length, period, kept = _runs_of(words, min_length)
                ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
                cuts = np.searchsorted(start, ends).astype(np.int32)
                of = np.searchsorted(ends, start, side="right") - 1
                rows = pa.StructArray.from_arrays([pa.array(start - ends[of]), pa.array(length), pa.array(period)], ["start", "length", "period"])
                whole = np.logical_and.reduceat(np.append(kept, True), ends[:-1]) | (np.diff(ends) == 0) if len(words) else []
                flat = kept.tolist() if len(start) else []
                left = [b" ".join(w if all_kept else compress(w, flat[a:b])) for w, all_kept, a, b in zip(words, whole, ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(cuts), rows), pa.array(left, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), SCHEMA)
