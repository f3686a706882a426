"""Runs of words: Lyndon lengths and runs against their definitions, colliding hashes, tables, the query by plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("gridlark.llm")

from gridlark.llm import runs  # noqa: E402
from gridlark.llm.queries import op11_lyndon_runs  # noqa: E402


def lyndon_by_definition(s):
    out = []
    for i in range(len(s)):
        words = [s[i:j] for j in range(i + 1, len(s) + 1)]
        out.append(max(len(w) for w in words if all(w < w[k:] for k in range(1, len(w)))))
    return out


def runs_by_definition(s, least):
    out, n = [], len(s)
    for q in range(1, n // 2 + 1):
        a = 0
        while a < n - q:
            e = a
            while e + q < n and s[e] == s[e + q]:
                e += 1
            size = e - a + q
            if e > a and size >= max(least, 2 * q) and not any(s[a : a + size - d] == s[a + d : a + size] for d in range(1, q)):
                out.append((a, size, q))
            a = e + 1 if e > a else a + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_strings(r):
    kinds = r.choice([1, 2, 3, 5])
    strings = []
    for _ in range(r.randint(1, 5)):
        s = [r.randrange(kinds) for _ in range(r.randint(0, 24))]
        if r.random() < 0.5 and s:
            s = s[: r.randint(0, len(s))] + (s[: r.randint(1, len(s))] * 4)[: r.randint(0, 30)]
        strings.append(s)
    return strings


def placed(strings):
    return np.array([c for s in strings for c in s], np.int64), np.cumsum([0, *map(len, strings)])


def listed(found):
    return [tuple(int(v) for v in row) for row in zip(*found)]


def by_definition(strings, least):
    return [(a + o, size, q) for s, o in zip(strings, placed(strings)[1]) for a, size, q in runs_by_definition(s, least)]


@pytest.mark.parametrize("seed", range(150))
def test_lyndon_lengths_and_runs(seed):
    r = random.Random(seed)
    strings = some_strings(r)
    letters, starts = placed(strings)
    for order, sign in ((letters, 1), (9 - letters, -1)):
        assert runs.lyndon_lengths(order, starts).tolist() == [x for s in strings for x in lyndon_by_definition([c * sign for c in s])]
    least = r.choice([2, 5, 12])
    assert listed(runs.find_runs(letters, starts, least)) == by_definition(strings, least)


@pytest.mark.parametrize("seed", range(20))
def test_colliding_hashes_change_nothing(seed, monkeypatch):
    r = random.Random(seed)
    strings = some_strings(r)
    right = runs._Extensions.same
    liar = np.random.default_rng(seed)
    monkeypatch.setattr(runs._Extensions, "same", lambda self, i, j, n: right(self, i, j, n) | (liar.random(len(i)) < 0.3))
    assert listed(runs.find_runs(*placed(strings), 2)) == by_definition(strings, 2)


def test_equal_words_and_words_of_two_letters():
    n = 3000
    assert listed(runs.find_runs(np.zeros(n, np.int64), np.array([0, n]))) == [(0, n, 1)]
    morse = np.array([bin(i).count("1") % 2 for i in range(4096)])  # overlap-free: no run is longer than two periods
    start, length, period = runs.find_runs(morse, np.array([0, 4096]), 2)
    assert len(start) > 1000 and (length == 2 * period).all()


def plain(doc_id, text):
    """The row of the query, from its contract."""
    words = re.findall("[^\\x20\\x09-\\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = runs_by_definition(words, 12)
    gone = {i for a, size, q in found for i in range(a + q, a + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
        sha("".join(f"{a},{size},{q}\n" for a, size, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    short = [x for x in docs if len(x[1] or "") < 6000]
    got = {r.doc_id: tuple(r) for r in op11_lyndon_runs(spark, d).collect()}
    assert len(got) == len(docs) and len(short) > 150
    assert [got[i] for i, _ in short] == [plain(i, t) for i, t in short]
    assert sum(v[1] > 0 for v in got.values()) > 10


def test_table_edge_cases(spark, tmp_path):
    again = "a b c " * 9
    rows = [(1, again + "x"), (1, again + "x"), (2, None), (3, ""), (4, " \n\t"), (None, again), (6, "tick " * 30_000), (7, "\u00e9\u00a0\u65e5 \x0b \x1c y"), (8, again.replace(" ", "\n"))]
    docs = spark.createDataFrame([(t, i, "r", "n") for i, t in rows], "text string, doc_id long, runs string, `n.words` string")
    got = {(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in runs.periodic_runs(docs).collect()}
    want = {(1, 28, ((0, 27, 3),), "a b c x"), (2, 0, (), ""), (3, 0, (), ""), (4, 0, (), ""), (None, 27, ((0, 27, 3),), "a b c"), (6, 30_000, ((0, 30_000, 1),), "tick"), (7, 3, (), "\u00e9\u00a0\u65e5 \x1c y"), (8, 27, ((0, 27, 3),), "a b c")}
    assert got == want and runs.periodic_runs(docs).count() == len(rows)
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = [tuple(r) for r in op11_lyndon_runs(spark, str(tmp_path)).collect()]
    assert sorted((r for r in out if r[0] not in (None, 6))) == sorted(plain(i, t) for i, t in rows if i not in (None, 6))
    assert [r[1:6] for r in out if r[0] is None] == [(1, 0, 27, 3, 9000)]  # a null id changes no words
