"""Phrase mining: the quicksort, all rounds and the query against plain counting."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("gridlark.llm")

from gridlark.llm import phrases  # noqa: E402
from gridlark.llm.queries import op13_phrase_quicksort  # noqa: E402


def counted(docs, longest):
    n, f = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang, text = "und" if lang is None else lang, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", text):
            words = re.findall("[^\\x20\\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    return n, f


def mined(docs, least, longest, percent):
    n, f = counted(docs, longest)
    found = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    around = collections.Counter()
    for (lang, p), v in found.items():
        for size in range(2, len(p)):
            for at in range(len(p) - size + 1):
                key = lang, p[at : at + size]
                around[key] = max(around[key], v)
    out = []
    for (lang, p), a in found.items():
        if around[lang, p] and 100 * around[lang, p] >= percent * a:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    return sorted(out)


@pytest.mark.parametrize("seed", range(20))
def test_quicksort_counts(seed):
    r = np.random.default_rng(seed)
    m, known = int(r.integers(1, 500)), int(r.integers(1, 4))
    ids = r.integers(1, 4, (m, 5)).astype(np.uint64) << np.uint64(61)
    length, weight = r.integers(known + 1, 6, m), r.integers(1, 5, m)
    ids[np.arange(5) >= length[:, None]] = 0
    for d, (grams, f) in zip(range(known + 1, 6), phrases.quicksort_counts(ids, weight, known, 9)):
        want = collections.Counter()
        for row, w, n in zip(ids.tolist(), weight.tolist(), length.tolist()):
            want[tuple(row[:d])] += w if n >= d else 0
        assert dict(zip(map(tuple, grams.tolist()), f.tolist())) == {k: v for k, v in want.items() if v >= 9}


def corpus(seed):
    r = random.Random(seed)
    words = ["the", "of", "a", "b", "\u00e9", "\u00c9", "X", "x,", "y.", "lo\tmi", "z!", "\n", "of the", "a a a a", "one two three four five"]
    docs = [(r.choice([None, "en", "de"]), " ".join(r.choice(words) for _ in range(r.randint(0, 200)))) for _ in range(60)]
    return docs + [("en", None), (None, ""), ("", " \t")] + [("en", "Six seven eight nine ten eleven")] * 40 + [("fr", "long " * 20_000)]


@pytest.mark.parametrize("hot, percent, longest", [(1 << 20, 100, 5), (30, 100, 5), (6, 60, 5), (6, 100, 4), (6, 100, 2)])
def test_all_phrases_whatever_is_hot(spark, hot, percent, longest):
    docs = corpus(hot)
    table = spark.createDataFrame([(i, lang, text, "g", 1) for i, (lang, text) in enumerate(docs)], "doc_id long, lang string, text string, gram string, `a.f` int").repartition(5)
    got = [tuple(r) for r in phrases.mine_phrases(table, 5, longest, percent, hot).collect()]
    assert sorted(got) == mined(docs, 5, longest, percent) and len(got) > 50


def test_top_ranks_ties_by_bytes(spark):
    rows = [("en", p, a, 1, 1, 1, s) for p, a, s in [("z z", 5, 9), ("\u00e9 a", 5, 9), ("b b", 6, 9), ("a a", 1, 10), ("c c", 1, 1)]]
    out = phrases.top_phrases(spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, n long, score long"), 4)
    assert [(r.rank, r.phrase) for r in out.orderBy("rank").collect()] == [(1, "a a"), (2, "b b"), (3, "z z"), (4, "\u00e9 a")]


def test_exact_beyond_64_bits(spark):
    big = spark.range(1).select(F.lit(10**16).alias("a"), F.lit(10**17).alias("n"), F.lit(10**16 + 1).alias("l"))
    row = big.select(phrases._whole(F.lit(1000), F.col("a"), F.col("n")).alias("top"), phrases._whole(F.col("l"), F.col("l")).alias("low")).selectExpr("top div low AS q", "top").first()
    assert row.top == 10**36 and row.q == 10**36 // (10**16 + 1) ** 2


def test_hashes_that_two_words_share_are_seen(spark):
    docs = spark.createDataFrame([(1, "en", "a b a"), (2, "en", None)], "doc_id long, lang string, text string")
    assert sorted(map(tuple, phrases.count_words(docs).select("lang", "word", "f", "twins").collect())) == [("en", "a", 2, False), ("en", "b", 1, False)]
    each = spark.createDataFrame([(7, "en", "a", 2), (7, "en", "a", 3), (8, "en", "b", 1), (8, "en", "c", 1), (9, "en", "d", 1), (9, "de", "d", 1)], "id long, lang string, word string, f long")
    assert {r.id: (r.f, r.twins) for r in phrases.merged_words(each).collect()} == {7: (5, False), 8: (2, True), 9: (2, True)}


def test_filter_lets_every_key_through(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    f = phrases.Filter.of(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert f.passes(keys.view(np.uint64)).all()
    assert f.passes(np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64)).mean() < 0.1


def test_empty_table_and_query(spark, tmp_path):
    assert phrases.mine_phrases(spark.createDataFrame([], "doc_id long, lang string, text string")).count() == 0
    d = "/root/testdata/sf0.001"
    docs = [(r.lang, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = mined(docs, 100, 5, 100)
    out = op13_phrase_quicksort(spark, d).collect()
    assert len(out) == len(want) > 10
    assert sorted((r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in out) == want
    for lang in {r.lang for r in out}:
        mine = [r for r in out if r.lang == lang]
        order = sorted(mine, key=lambda r: (-r.score, -r.a, r.phrase.encode()))
        assert [r.rank for r in order] == list(range(1, len(mine) + 1))
