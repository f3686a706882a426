"""Phrase collocations by multikey quicksort of suffix pointers.

A suffix is a place in a text with the words that follow it inside its piece.  Suffixes are dealt to partitions by their
leading words, over the whole corpus, so that all places of a phrase meet; there, pointers to them are sorted by multikey
three-way quicksort, down to the greatest depth.  The size of an equal partition at depth d is the count of the phrase of
its d words; a partition with fewer than ``least`` places is abandoned, whatever its kind, since no phrase in it can have more.

Rounds.  Words are counted first.  Round 1 deals suffixes of frequent words and sorts them to depth 2.  Round L deals
suffixes that begin with a frequent phrase of L words and stop before the first infrequent pair: those that begin with a
phrase of at most ``hot`` places go to the partition of these L words and are sorted to full depth; the others, so that no
partition holds a hot phrase, are cut after L + 1 words, dealt by all of them, and come again in round L + 1.  Every task
first adds up equal suffixes, so a phrase repeated everywhere is one row for each task.  Rounds end when nothing is hot.

Words are 64-bit hashes of language and word.  The word table proves that no two words of the corpus share one; if some did,
all would begin again with another seed.  What tasks need to know about frequent phrases is a Bloom filter of at most
16 MB, however many there are; what it lets through in error is counted exactly and found to be infrequent.

Scores: of all cuts of a phrase in two, the least ``floor(1000 a n / (l r))`` in 38-digit decimals, ties to the earliest cut.
A phrase is dropped if a longer candidate around it has ``100 f(longer) >= percent a``.

Edge cases: a null text is the empty text; a null ``lang`` is ``und``; ``doc_id`` is not needed, repeated rows count again;
very long texts and words are taken whole; equal scores are ordered by count, then by the phrase in UTF-8 byte order; other
columns are ignored, whatever their names; an empty table has no phrases.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, lean, splitmix, staged, text_chunks

BREAKS = b".,;:!?\n\x0b\x0c\r"
TOKEN = re.compile(rb"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r]+")
CHUNK = 1 << 25
#: Words a task remembers before it begins its list anew; 21 bits are a word's number in the key of a suffix.
KNOWN = 1 << 20
_BITS = 21
MAX_FILTER = 1 << 27
#: Suffixes of one partition.
PART_ROWS = 3_000_000


class _Numbers(dict):
    """token -> number from 1; breaks are 0."""

    def __init__(self, of: _Words, lang: bytes):
        super().__init__()
        self.of, self.lang = of, lang

    def __missing__(self, token: bytes) -> int:
        if token[0] in BREAKS:
            n = 0
        else:
            self.of.listed.append((self.lang, token))
            n = len(self.of.listed)
        self[token] = n
        return n


class _Words:
    """Words of a task by number, with the languages they stand in."""

    def __init__(self, seed: int):
        self.seed = seed
        self.clear()

    def clear(self) -> None:
        self.by_lang: dict[bytes, _Numbers] = {}
        self.listed: list[tuple[bytes, bytes]] = []
        self.hashes = np.zeros(1, np.uint64)

    def numbers(self, langs: list[bytes], texts: list[bytes]) -> np.ndarray:
        """Numbers of all words of the texts, 0 between pieces."""
        if len(self.listed) > KNOWN:
            self.clear()
        out = []
        for lang, text in zip(langs, texts):
            if lang not in self.by_lang:
                self.by_lang[lang] = _Numbers(self, lang)
            out.append(np.array([*map(self.by_lang[lang].__getitem__, TOKEN.findall(text.lower())), 0], np.int64))
        new = self.listed[len(self.hashes) - 1 :]
        ids = [xxhash.xxh3_64_intdigest(b"%d:%s%s" % (len(lang), lang, word), self.seed) or 1 for lang, word in new]
        self.hashes = np.concatenate([self.hashes, np.array(ids, np.uint64)])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], words: _Words) -> Iterator[np.ndarray]:
    for batch in batches:
        lang, text = batch.column(0).cast(pa.binary()), batch.column(1).cast(pa.large_binary())
        for at, to in text_chunks(text, CHUNK):
            langs = ["und" if x is None else x for x in lang.slice(at, to - at).to_pylist()]
            yield words.numbers([x if isinstance(x, bytes) else x.encode() for x in langs], [t or b"" for t in text.slice(at, to - at).to_pylist()])


def count_words(docs: DataFrame, seed: int = 0) -> DataFrame:
    """id, lang, word, f; and ``twins``: more than one word has this id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, count = _Words(seed), np.zeros(1, np.int64)

        def rows() -> pa.RecordBatch:
            lang, word = zip(*words.listed) if words.listed else ((), ())
            cols = [pa.array(words.hashes[1:].view(np.int64)), pa.array(lang, pa.binary()).cast(pa.string()), pa.array(word, pa.binary()).cast(pa.string()), pa.array(count[1 : len(words.listed) + 1])]
            return pa.RecordBatch.from_arrays(cols, ["id", "lang", "word", "f"])

        for numbers in _chunks(batches, words):
            here = np.bincount(numbers, minlength=len(words.listed) + 1)
            here[: len(count)] += count
            count = here
            if len(words.listed) > KNOWN:
                yield rows()
                words.clear()
                count = np.zeros(1, np.int64)
        yield rows()

    return merged_words(docs.select("lang", "text").mapInArrow(lean(run), "id long, lang string, word string, f long"))


def merged_words(each: DataFrame) -> DataFrame:
    """The counts of all tasks added up."""
    name = F.struct("lang", "word")
    merged = each.groupBy("id").agg(F.min(name).alias("name"), F.max(name).alias("other"), F.sum("f").alias("f"))
    return merged.select("id", "name.lang", "name.word", "f", (F.col("name") != F.col("other")).alias("twins"))


def _mixed(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a phrase and one word more."""
    return splitmix(key * np.uint64(0x9E3779B97F4A7C15) + word)


def _keys(ids: np.ndarray, depth: int) -> np.ndarray:
    """Keys of the phrases of the first ``depth`` columns."""
    key = ids[:, 0]
    for d in range(1, depth):
        key = _mixed(key, ids[:, d])
    return key


class Filter:
    """A Bloom filter of two bits a key: keys that were put in always pass."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, keys: DataFrame) -> Filter:
        """From a written table with a column ``key``: the bits are set by Spark and at most 16 MB reach the driver."""
        n = 1 << 15
        while n < MAX_FILTER and n < 16 * keys.count():
            n *= 2
        spots = keys.select(F.explode(F.array(F.col("key").bitwiseAND(n - 1), F.shiftrightunsigned("key", 32).bitwiseAND(n - 1))).alias("spot"))
        blocks = spots.groupBy((F.col("spot") / (1 << 15)).cast("int").alias("block")).agg(F.expr("bitmap_construct_agg(spot % 32768)").alias("bits"))
        bits = np.zeros(n >> 3, np.uint8)
        for row in blocks.collect():
            bits[row.block << 12 : (row.block + 1) << 12] = np.frombuffer(row.bits, np.uint8)
        return cls(bits)

    def passes(self, key: np.ndarray) -> np.ndarray:
        most = np.uint64(8 * len(self.bits) - 1)
        out = np.ones(len(key), bool)
        for spot in (key & most, (key >> np.uint64(32)) & most):
            out &= (self.bits[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0
        return out


def _suffixes(ids: np.ndarray, frequent: list[Filter], hot: list[Filter], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """place, length and key to deal by of the suffixes of round L = len(frequent)."""
    n, rounds = len(ids), len(frequent)
    padded = np.concatenate([ids, np.zeros(longest, np.uint64)])
    word = padded != 0
    word[word] = frequent[0].passes(padded[word])
    joint = word[:-1] & word[1:]  # this word and the next may be said together
    if rounds > 1:
        joint[joint] = frequent[1].passes(_mixed(padded[:-1][joint], padded[1:][joint]))
    place = np.flatnonzero(joint[:n])
    key = padded[place]
    for depth in range(2, rounds + 1):
        reach = joint[place + depth - 2]
        place, key = place[reach], key[reach]
        key = _mixed(key, padded[place + depth - 1])
        known = frequent[depth - 1].passes(key)
        if depth < rounds:
            known &= hot[depth - 2].passes(key)
        place, key = place[known], key[known]
    reach = joint[place + rounds - 1]
    place, key = place[reach], key[reach]
    length, on = np.full(len(place), rounds + 1), np.ones(len(place), bool)
    for depth in range(rounds + 1, longest):
        on &= joint[place + depth - 1]
        length += on
    crowded = hot[rounds - 2].passes(key) if rounds > 1 else np.ones(len(place), bool)
    length[crowded] = rounds + 1
    key = np.where(crowded, _mixed(key, padded[place + rounds]), key)
    return place, length, key


def _summed(numbers: np.ndarray, place: np.ndarray, length: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """First of each kind of equal suffixes, in order of their words' numbers, and how many they are."""
    padded = np.concatenate([numbers, np.zeros(longest, np.int64)])
    packed = []
    for first in range(0, longest, 3):
        key = np.zeros(len(place), np.int64)
        for d in range(first, min(first + 3, longest)):
            key = (key << _BITS) | np.where(d < length, padded[place + d], 0)
        packed.append(key)
    order = np.lexsort(packed[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in packed:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def _blob(ids: np.ndarray, weight: np.ndarray) -> bytes:
    return np.int64(len(ids)).tobytes() + np.ascontiguousarray(ids.T).tobytes() + weight.astype(np.int64).tobytes()


def _unblob(data: bytes, longest: int) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    return np.frombuffer(data, np.uint64, n * longest, 8).reshape(longest, n), np.frombuffer(data, np.int64, n, 8 + 8 * n * longest)


def quicksort_counts(ids: np.ndarray, weight: np.ndarray, known: int, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(phrases, counts) of at least ``least`` for each depth over ``known``: multikey three-way quicksort of pointers to the
    rows of ``ids`` (0 after the last word).  All partitions are split at the same time, each by a pivot of its own."""
    deepest = ids.shape[1]
    out = [(np.zeros((0, d), np.uint64), np.zeros(0, np.int64)) for d in range(known + 1, deepest + 1)]
    spread = (_keys(ids, known) >> np.uint64(48)).astype(np.uint16)  # the routes that ended in this task
    pointer = np.argsort(spread, kind="stable")
    part_start = np.flatnonzero(np.diff(spread[pointer].astype(np.int64), prepend=-1))
    depth = np.zeros(len(part_start), np.int64)
    r = np.random.default_rng(0)
    while len(pointer):
        size = np.diff(np.append(part_start, len(pointer)))
        part = np.repeat(np.arange(len(size)), size)
        word = ids[pointer, depth[part]]
        draw = np.sort(word[part_start[:, None] + (r.random((len(size), 3)) * size[:, None]).astype(np.int64)], axis=1)[:, 1]
        pivot = draw[part]
        side = part * 3 + (word >= pivot) + (word > pivot)
        total = np.bincount(side, minlength=3 * len(size))
        heavy = np.bincount(side, weights=weight[pointer], minlength=3 * len(size)) >= least
        equal = np.arange(3 * len(size)) % 3 == 1
        went = np.repeat(depth, 3) + equal
        ended = equal & (np.repeat(draw, 3) == 0)  # no word here: nothing to sort below
        order = np.argsort(side, kind="stable")
        pointer = pointer[order]
        opens = np.cumsum(total) - total
        counted = np.flatnonzero(heavy & equal & ~ended & (went > known))
        sums = np.concatenate([[0], np.cumsum(weight[pointer])]) if len(counted) else None
        for d in range(known + 1, deepest + 1):
            at = counted[went[counted] == d]
            if len(at):
                f = sums[opens[at] + total[at]] - sums[opens[at]]
                out[d - known - 1] = tuple(np.concatenate(x) for x in zip(out[d - known - 1], (ids[pointer[opens[at]], :d], f)))
        goes = heavy & ~ended & (went < deepest) & (total > 0)
        pointer = pointer[np.repeat(goes, total)]
        part_start, depth = np.cumsum(total[goes]) - total[goes], went[goes]
    return out


def _round(docs: DataFrame, seed: int, frequent: list, hot: list, least: int, longest: int, n_parts: int) -> DataFrame:
    """gram (ids), key, f of frequent phrases of more than ``len(frequent)`` words, as far as this round settles them."""
    rounds, routes = len(frequent), 16 * n_parts
    deepest = rounds + 1 if rounds == 1 else longest

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known, crowded = _Words(seed), [f.value for f in frequent], [f.value for f in hot]
        for numbers in _chunks(batches, words):
            ids = words.hashes[numbers]
            place, length, key = _suffixes(ids, known, crowded, deepest)
            first, weight = _summed(numbers, place, length, deepest)
            place, length, key = place[first], length[first], key[first]
            route = (key % np.uint64(routes)).astype(np.int64)
            order = np.argsort(route, kind="stable")
            cuts = np.searchsorted(route[order], np.arange(routes + 1))
            padded = np.concatenate([ids, np.zeros(deepest, np.uint64)])
            for k in np.flatnonzero(np.diff(cuts)):
                at = order[cuts[k] : cuts[k + 1]]
                rows = np.where(np.arange(deepest) < length[at][:, None], padded[place[at][:, None] + np.arange(deepest)], np.uint64(0))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_blob(rows, weight[at])], pa.binary())], ["route", "suffixes"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_unblob(x, deepest) for batch in batches for x in batch.column(1).to_pylist()]
        if not held:
            return
        ids, weight = np.concatenate([x for x, _ in held], axis=1).T, np.concatenate([w for _, w in held])
        del held
        for grams, f in quicksort_counts(np.ascontiguousarray(ids), weight, rounds, least):
            n, depth = grams.shape
            flat = pa.array(grams.reshape(-1).view(np.int64))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * depth, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([listed, pa.array(_keys(grams, depth).view(np.int64) if n else [], pa.int64()), pa.array(f)], ["gram", "key", "f"])

    dealt = docs.select("lang", "text").mapInArrow(lean(deal), "route int, suffixes binary").repartition(n_parts, "route")
    return dealt.mapInArrow(lean(count), "gram array<long>, key long, f long")


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, hot: int = 1 << 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (id, lang, word, f) and phrases (gram, f) with at least ``least`` occurrences, and languages (lang, n: all words)."""
    context = docs.sparkSession.sparkContext
    for seed in range(8):
        words = staged(count_words(docs, seed), "words")
        if words.where("twins").isEmpty():
            break
    else:
        raise RuntimeError("eight seeds gave two words one hash: the hash is at fault")
    langs = staged(words.groupBy("lang").agg(F.sum("f").alias("n")), "languages")
    n_words = langs.agg(F.sum("n")).first()[0] or 0
    words = staged(words.where(F.col("f") >= least).drop("twins"), "frequent-words")
    level = words.select(F.array("id").alias("gram"), F.col("id").alias("key"), "f")
    found = [level.drop("key")]
    filters: list = []
    crowded: list = []
    n_parts = max(1, -(-n_words // PART_ROWS))
    while len(filters) + 1 < longest and not level.isEmpty():
        filters.append(context.broadcast(Filter.of(level)))
        if len(filters) > 1:
            crowded.append(context.broadcast(Filter.of(level.where(F.col("f") > hot))))
        grams = staged(_round(docs, seed, filters, crowded, least, longest, n_parts), "phrases")
        found.append(grams.drop("key"))
        level = grams.where(F.size("gram") == len(filters) + 1)
        if len(filters) > 1:  # only what is below a hot phrase is still open
            if crowded[-1].value.bits.any():
                continue
            break
    phrases = found[0]
    for more in found[1:]:
        phrases = phrases.unionByName(more)
    for b in filters + crowded:
        b.unpersist()
    return words, phrases, langs


def _whole(*factors: Column) -> Column:
    """An exact product."""
    out = F.lit(1).cast("decimal(38,0)")
    for x in factors:
        out = (out * x.cast("decimal(20,0)")).cast("decimal(38,0)")
    return out


def mine_phrases(docs: DataFrame, least: int = 100, longest: int = 5, percent: int = 100, hot: int = 1 << 20) -> DataFrame:
    """lang, phrase, a, l, r, n, score of all phrases of 2 to ``longest`` words with ``least`` occurrences that no longer candidate covers."""
    words, phrases, langs = frequent_phrases(docs, least, longest, hot)
    named = staged(_spelled(phrases.where(F.size("gram") > 1), words), "candidates")
    cut = named.select("gram", "f", F.explode(F.sequence(F.lit(1), F.size("gram") - 1)).alias("k"))
    cut = cut.select("gram", "f", "k", F.slice("gram", F.lit(1), F.col("k")).alias("head"), F.slice("gram", F.col("k") + 1, F.size("gram") - F.col("k")).alias("rest"))
    parts = cut.join(phrases.select(F.col("gram").alias("head"), F.col("f").alias("l")), "head").join(phrases.select(F.col("gram").alias("rest"), F.col("f").alias("r")), "rest")
    tongues = broadcast_if_small(langs, F.octet_length("lang") + 16)
    scored = parts.join(named.select("gram", "lang", "phrase"), "gram").join(tongues, "lang")
    scored = scored.withColumn("top", _whole(F.lit(1000), F.col("f"), F.col("n"))).withColumn("low", _whole(F.col("l"), F.col("r"))).withColumn("score", F.expr("top div low"))
    best = scored.groupBy("gram", "lang", "phrase", F.col("f").alias("a"), "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    wide = named.where(F.size("gram") > 2).select("gram", "f", F.explode(F.sequence(F.lit(2), F.size("gram") - 1)).alias("size"))
    wide = wide.select("gram", "f", "size", F.explode(F.sequence(F.lit(1), F.size("gram") - F.col("size") + 1)).alias("at"))
    inside = wide.groupBy(F.slice("gram", F.col("at"), F.col("size")).alias("gram")).agg(F.max("f").alias("around"))
    kept = best.join(inside, "gram", "left").where(F.col("around").isNull() | (_whole(F.lit(100), F.col("around")) < _whole(F.lit(percent), F.col("a"))))
    return kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def _spelled(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """gram, f, lang, phrase."""
    each = phrases.select("gram", "f", F.posexplode("gram").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
    whole = each.groupBy("gram", "f", "lang").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("said"))
    return whole.select("gram", "f", "lang", F.array_join(F.transform("said", lambda x: x["word"]), " ").alias("phrase"))


def top_phrases(mined: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each language, with ``rank``; only ``k`` rows of a partition reach a language's task."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return mined.withColumn("rank", place).where(F.col("rank") <= k)
