"""Each operator on small tables: brute force, round trips, nulls, empty texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("gridlark.llm")

from gridlark.llm import bitpack, bpe, chat, decontam, jaccard, langid, linededup, lmscore, packing, suffix, topk  # noqa: E402
from gridlark.llm.common import new_path  # noqa: E402

WORDS = [a + b for a in "ka lo mi ru te so na vi".split() for b in "den ras tol mun pik".split()]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, rank string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(1, 60)
    near = base.split()
    near[30] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, prose(2, 3000)), (7, "x"), (7, "x"), (None, prose(3, 40)), (9, base + "\n" + prose(4, 30) + "\n" + prose(5, 20)), (10, "   \n\n"), (11, prose(4, 30))]
    return spark.createDataFrame([(i, t, "xx" if i != 5 else None, "s" if i != 6 else None, 0, "a", "b", "c") for i, t in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def raw(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.mark.parametrize("width", [1, 3, 7, 13, 16, 17, 31])
def test_pack_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000).astype(np.uint32)
    shard = bitpack.Shard(bitpack.build_shard([5, None], np.array([400, 1000]), ids, width))
    assert (shard.ids(0, 1000) == ids).all() and (shard.ids(63, 130) == ids[63:130]).all() and (shard.doc(1) == ids[400:]).all()


def fresh():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


ODD = ["", " lead", "a  b", "tab\t x\n\n y ", "it's <|endoftext|> ok", "a <|endoftext|> b", "<|endoftext|>", " <|endoftext|>x", prose(1, 200), "café   x", "word,next.one: 'tis x'll (é) ½ a1,b", "trail  ", "\n \n", "x\u00a0y, z\u3000 w"]


@pytest.mark.parametrize("rows, chars", [(50, 10**6), (10**6, 300), (10**6, 10**6)])
def test_words_encode_like_the_library(rows, chars):
    e, tok = bpe.WordEncoder(bpe.default_path(), max_rows=rows, max_chars=chars), fresh()
    r = random.Random(9)
    parts = ["a", "Bé", " ", "  ", "\n", "'s", "'", "<|endoftext|>", "<|endo", "$", "1", "²", "中", "_", "-", ".", "İ", "🙂", "\u00a0"]
    texts = ODD + ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(300)]
    for _ in range(2):
        ids, at = e.encode(texts, 9)
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids + [9]


def with_odd(spark, docs):
    return docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))


def test_shards(spark, docs):
    docs = with_odd(spark, docs)
    path = new_path(spark, "t")
    bitpack.write_shards(docs, path)
    got = bitpack.read_documents(spark, path, with_ids=True).orderBy("start").collect()
    tok = fresh()
    want = [(i, tok.encode(t, add_special_tokens=False).ids + [2]) for i, t in sorted(raw(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]
    assert [(r.doc_id, r.ids, r.n_tokens) for r in got] == [(i, x, len(x)) for i, x in want]
    assert [r.start for r in got] == list(np.cumsum([0] + [len(x) for _, x in want])[:-1])
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got]
    some = sorted((r.doc_id, r.ids) for r in bitpack.lookup(spark, path, [7, 2, 105, 999]).collect())
    assert some == sorted((i, x) for i, x in want if i in (7, 2, 105)) and len(some) == 4
    assert bitpack.lookup(spark, path, []).count() == 0
    none = new_path(spark, "t")
    bitpack.write_shards(empty(spark), none)
    assert bitpack.read_documents(spark, none).count() == 0


def test_packing(spark, docs):
    """All columns of the contract against the library's own tokens, cut here."""
    docs = with_odd(spark, docs)
    got = packing.pack_documents(docs, capacity=256, with_ids=True).collect()
    tok, want = fresh(), []
    for i, t in raw(docs):
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        head = len(ids) - (-(-len(ids) // 256) - 1) * 256
        cuts = [0, *range(head, len(ids) + 1, 256)]
        want += [(i or -1, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(itertools.pairwise(cuts))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == list(np.cumsum([0] + [n for _, n in s])[:-1]) and sum(n for _, n in s) <= 256
    assert len(seqs) <= -(-sum(r.length for r in got) // 256) + 1
    assert packing.pack_documents(empty(spark)).count() == 0


def test_packing_plan_near_the_bound():
    count = np.random.default_rng(0).integers(0, 60, 513)
    count[0] = 0
    lower = -(-int((np.arange(513) * count).sum()) // 512)
    assert packing.plan(count, 512)["n_sequences"] <= lower * 1.01 + 1


def test_top_k(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 12)).round(2)
    v[7] = v[8]
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)] + [(900, None, 0), (901, [1.0, None] + [0.0] * 10, 0), (902, [float("nan")] * 12, 0), (903, [1.0], 0), (None, [0.1] * 12, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score long")
    q = np.floor(256 * v).astype(int)
    got = {}
    for r in topk.search_vectors(df, F.col("vec_id") % 20 == 0, k=5).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.id))
    for i in range(0, 300, 20):
        s = q @ q[i]
        assert got[i] == [(int(s[j]), int(j)) for j in sorted((j for j in range(300) if j != i), key=lambda j: (-s[j], j))[:5]]
    assert topk.search_vectors(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_large_components_and_other_lengths(spark):
    """Components far apart, and queries whose commonest length is not that of the table."""
    rng = np.random.default_rng(2)
    v = rng.integers(-20, 20, (80, 3)).astype(float)
    v[5, 0], v[9, 1], v[41, 2] = 2.0**41, -(2.0**42), 3.0**26
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(1000 + 20 * i, [1.0, 2.0]) for i in range(10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = [[int(x * 256) for x in r] for r in v.tolist()]
    got = {}
    for r in topk.search_vectors(df, F.col("vec_id").isin(0, 20, 60, 1000, 1020, 1040, 1060), k=4).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.id))
    want = {}
    for i in (0, 20, 60):
        s = [sum(a * b for a, b in zip(x, q[i], strict=True)) for x in q]
        want[i] = [(s[j], j) for j in sorted((j for j in range(80) if j != i), key=lambda j: (-s[j], j))[:4]]
    assert got == want
    with pytest.raises(Exception, match="beyond 2\\^62"):
        topk.search_vectors(spark.createDataFrame([(0, [1e60]), (1, [1.0])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()


def test_chat_trees(spark):
    rows = [("t", 1, None, "system", "a & <|im_end|>\n", 1.0), ("t", 2, 1, "user", None, 0.0), ("t", 3, 1, "user", "best", 1.0), ("t", 4, 3, "assistant", "<|im_start|>x&lt;|", 1.0), ("t", 4, 3, "assistant", "zz", 1.0)]
    rows += [("c", 1, 2, "user", "loop", 0.0), ("c", 2, 1, "user", "loop", 0.0), ("c", 3, 1, "user", "leaf under a loop", 0.0), (None, 1, None, None, "alone", None), ("t", None, 1, "user", "no node", 0.0)]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    out = {r.tree: r for r in chat.format_trees(nodes, keep=None).withColumn("turns", chat.parsed_turns(F.col("formatted"))).withColumn("said", chat.loss_texts(F.col("formatted"), F.col("loss_spans"))).where("branch_rank = 1").collect()}
    assert [tuple(x) for x in out["t"].turns] == [("system", "a & <|im_end|>\n"), ("user", "best"), ("assistant", "<|im_start|>x&lt;|")]
    assert out["t"].said == ["<|im_start|>x&lt;|"] and "c" not in out and [tuple(x) for x in out[None].turns] == [("", "alone")]
    assert chat.format_trees(nodes.limit(0)).count() == 0


def test_decontamination(spark, docs):
    item = prose(7, 30)
    words = item.split()
    words[12] = "other"
    leaks = [(21, "intro " + item + " outro", ""), (22, prose(8, 50) + " " + " ".join(words), ""), (23, prose(9, 80), ""), (24, None, ""), (25, "", ""), (26, "A short, item of-six words!", "")]
    df = spark.createDataFrame(leaks, "doc_id long, text string, w string")
    bench = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "", 0), (4, "a short item of six words", 0), (4, "a short item of six words", 0)], "item_id long, text string, doc_key int")
    assert sorted((r.doc_id, r.item_id) for r in decontam.overlaps(df, bench).collect()) == [(21, 1), (22, 1), (26, 4)]
    assert sorted(r.doc_id for r in decontam.decontaminated(df, bench).collect()) == [23, 24, 25]
    assert decontam.overlaps(df.limit(0), bench).count() == 0 and decontam.overlaps(df, bench.limit(0)).count() == 0


@pytest.mark.parametrize("size", range(1, 20))
def test_decontamination_masks_leave_nothing_out(size):
    for subs in range(min(size, 4)):
        for gone in itertools.combinations(range(size), subs):
            assert any(all(at + p not in gone for p in m) for m in decontam.masks(size, subs) for at in range(size - m[-1]))


def test_decontamination_is_the_overlap_rule(spark):
    """Items of all lengths and passages with substitutions at all alignments, against the rule itself."""
    r = random.Random(3)
    items = {n: prose(100 + n, n).split() for n in [*range(5, 17), 30]}
    rows = []
    for n, w in items.items():
        for lead in range(4):
            rows.append(prose(r.random(), 20 + lead).split() + w + prose(r.random(), 9).split())
            for subs in (1, 2, 3):
                x = list(w)
                for at in r.sample(range(n), subs):
                    x[at] = "other"
                rows.append(prose(r.random(), 20 + lead).split() + x + prose(r.random(), 9).split())
    for lead in range(4):  # each 5th word replaced
        rows.append(prose(r.random(), 20 + lead).split() + ["other" if i % 5 == 4 else x for i, x in enumerate(items[30])])

    def overlap(d, w):
        size = min(13, len(w))
        for shift in range(-len(w), len(d)):
            same = [d[j + shift] == w[j] for j in range(max(0, -shift), min(len(w), len(d) - shift))]
            if any(sum(same[s : s + size]) >= size - size * 2 // 13 for s in range(len(same) - size + 1)):
                return True
        return False

    want = {(i, n) for i, d in enumerate(rows) for n, w in items.items() if overlap(d, w)}
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(rows)], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontam.overlaps(df, bench).collect()} == want and len(want) > 100


def test_language(spark):
    r = random.Random(4)
    syl = {"aa": ["ba", "be", "bo"], "bb": ["xi", "xu", "zy"]}
    rows = [(i, " ".join("".join(r.choice(syl[k]) for _ in range(3)) for _ in range(40)), k, f"h{i % 3}") for i, k in enumerate(["aa", "bb"] * 100)]
    junk = "".join(chr(33 + r.randrange(90)) for _ in range(3000))
    rows += [(500, None, None, None), (501, "", "aa", "h1"), (502, junk, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x for x in langid.identify(df, langid.train(df, "lang"), "doc_id", **langid.document_parts()).collect()}
    assert all(got[i].language == k and got[i].accepted for i, _, k, _ in rows[:200])
    assert not any(got[i].accepted for i in (500, 501, 502))
    assert langid.identify(df.limit(0), langid.train(df.limit(0), "lang"), "doc_id", **langid.document_parts()).count() == 0
    parts = spark.createDataFrame([("http://m.site.example.de/x", '<html class="a" lang="de">')], "u string, h string").select(*[c.alias(n) for n, c in langid.page_parts(F.col("u"), F.col("h")).items()]).first()
    assert parts.asDict() == {"declared": "de", "suffix": "de", "host": "m.site.example.de", "domain": "example.de"}


def test_language_models_of_all_labels(spark):
    """More labels than 200, each with less than a thousandth of the rows, beside one large language."""
    r = random.Random(5)
    syl = {f"l{k:03}": ["".join(r.choice("bcdfghjklmnpqrstvwxyz") for _ in range(3)) for _ in range(3)] for k in range(220)} | {"big": ["oa", "ea", "ui"]}
    rows = [(k, "".join(r.choice(" a") + r.choice(syl[k]) for _ in range(60))) for k in [*syl, *["big"] * 1100]]
    df = spark.createDataFrame([(i, t, k, None) for i, (k, t) in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(3)
    model = langid.train(df, "lang")
    assert model[0] == sorted(syl)
    texts = {k: [t for x, t in rows if x == k] for k in syl}
    for i, k in enumerate(model[0]):
        bucket, _ = langid._trigrams(*langid.utf8_buffer(pa.array(texts[k])))
        n = np.bincount(bucket, minlength=langid.BUCKETS) + 0.5
        assert np.allclose(model[1][i], np.log(n / n.sum()))
    got = {x.doc_id: x for x in langid.identify(df, model, "doc_id", **langid.document_parts()).collect()}
    assert len(got) == len(rows) and all(got[i].language == k and got[i].accepted for i, (k, _) in enumerate(rows))


def grams(t, n=5):
    import re

    w = re.findall(r"\w+", t.lower())
    return {tuple(w[i : i + min(n, len(w))]) for i in range(max(0, len(w) - min(n, len(w)) + 1))} if w else set()


def test_jaccard(spark, docs):
    got = sorted((r.doc_id or -1, -1 if r.class_id is None else r.class_id, r.n_links) for r in jaccard.join_documents(docs).collect())
    rows = raw(docs)
    sets = [grams(t) for _, t in rows]
    links = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(rows))]
    cls = list(range(len(rows)))
    for _ in rows:
        cls = [min([cls[i], *(cls[j] for j in links[i])]) for i in range(len(rows))]
    least = {c: min([rows[i][0] for i in range(len(rows)) if cls[i] == c and rows[i][0] is not None], default=None) for c in cls}
    assert got == sorted((rows[i][0] or -1, least[cls[i]] if least[cls[i]] is not None else -1, len(links[i])) for i in range(len(rows)))
    kept = [r.doc_id for r in jaccard.one_of_each_class(docs).collect()]
    assert sorted(k for k in kept if k) == [1, 4, 5, 6, 7, 9, 10, 11]
    assert jaccard.join_documents(empty(spark)).count() == 0


def test_line_dedup(spark, docs):
    line = prose(11, 12)
    rows = [(1, line + "\nshort"), (2, line.replace("ka", "kb", 1) + "\nshort\n\nnew"), (3, None), (4, ""), (5, "z" + line[1:-1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, line_key int")
    got = {r.doc_id: r.removed_lines for r in linededup.decisions(df).collect()}
    assert got == {1: [], 2: [0, 1], 4: [], 5: [0]}
    kept = {r.doc_id: r.text for r in linededup.deduplicated(df).collect()}
    assert kept == {1: line + "\nshort", 2: "\nnew", 3: None, 4: ""}
    whole = {r.doc_id: r.text for r in linededup.deduplicated(df, drop_emptied=False).collect()}
    assert whole == kept | {5: ""}
    assert linededup.decisions(df.limit(0)).count() == 0 and linededup.decisions(docs).count() == 10


def near_lines(x, y):
    a, b = x.encode(), y.encode()
    return abs(len(a) - len(b)) <= 2 and linededup._distance(a, b) <= min(2, min(len(a), len(b)) // 20)


@pytest.mark.parametrize("crowded", [-1, 64])
def test_near_lines_of_crowded_hashes(spark, monkeypatch, crowded):
    """Versions of one line by the dozen: pairs within two edits only, and each line that has an earlier neighbour with one, whatever counts as crowded."""
    monkeypatch.setattr(linededup, "CROWDED", crowded)
    r = random.Random(6)
    line, rows = prose(12, 25), []
    for i in range(60):
        t = list(line if i % 2 else rows[r.randrange(len(rows))] if rows else line)
        for _ in range(r.randrange(1, 4 if i % 2 else 8)):
            at = r.randrange(len(t))
            t[at : at + r.randrange(2)] = r.choice(["q", "", "é"])
        rows.append("".join(t))
    rows += [prose(i, 7)[:42] for i in range(20)] + ["a" * n for n in (18, 19, 20, 21, 23, 38, 39, 40, 41, 43)]
    for n in (19, 20, 25, 39, 40):  # short lines: fewer edits
        base = prose(40 + n, 9)[:n]
        rows += [base, "q" + base[1:], "q" + base[1:-1] + "q", base + "q", base[1:-1]]
    lines = sorted(set(rows))
    key = {x: int(linededup._whole_keys(np.frombuffer(x.encode(), np.uint8), np.array([0]), np.array([len(x.encode())]), 3)[0][0]) for x in lines}
    true = {(key[x], key[y]) for x in key for y in key if x != y and near_lines(x, y)}
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "doc_id long, text string").repartition(3)
    order = {key[x]: rows.index(x) for x in lines}
    first = spark.createDataFrame([(k, i) for k, i in order.items()], "line_key long, first long")
    got = [tuple(p) for p in linededup.near_lines(df, first, 2, 20, 3).collect()]
    assert len(true) > 20 and set(got) <= true
    late = {x for pair in true for x, y in (pair, pair[::-1]) if order[y] < order[x]}
    assert late == {x for pair in got for x, y in (pair, pair[::-1]) if order[y] < order[x]}


def test_lines_of_one_polynomial_hash_are_two_lines(spark):
    """The Thue-Morse word and its complement: every polynomial modulo 2^64 gives them one hash, and they differ in all bytes."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    sub = [linededup.Substrings(np.frombuffer(x.encode(), np.uint8)).hash(np.array([0]), np.array([2048]))[0] for x in (one, two)]
    assert sub[0] == sub[1]
    df = spark.createDataFrame([(1, one), (2, two), (3, one), (4, two[:-1] + "c")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in linededup.decisions(df).collect()} == {1: 0, 2: 0, 3: 1, 4: 1}
    assert {r.doc_id for r in linededup.deduplicated(df).collect()} == {1, 2}


def test_keys_that_two_lines_share_begin_anew(spark, monkeypatch):
    seeds, right = [], linededup.line_keys

    def keys(docs, seed):
        seeds.append(seed)
        out = right(docs, seed)
        return out.withColumn("line_key", F.when(F.col("line_key").isNotNull(), F.lit(7).cast("long"))) if seed < 2 else out

    monkeypatch.setattr(linededup, "line_keys", keys)
    df = spark.createDataFrame([(1, "one\ntwo"), (2, "two")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in linededup.decisions(df).collect()} == {1: 0, 2: 1} and seeds == [0, 1, 2]


@pytest.mark.parametrize("block", [16, 256])
def test_jaccard_of_a_large_group_of_versions(spark, block):
    """Versions of one text at similarities around the threshold: exact links."""
    r = random.Random(8)
    base, rows = prose(13, 120).split(), []
    for i in range(120):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        rows.append((i, " ".join(w)))
    sets = [grams(t) for _, t in rows]
    want = {i: sum(1 for j in range(120) if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in range(120)}
    got = {x.doc_id: x.n_links for x in jaccard.join_documents(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    assert got == want and 0 < sum(want.values()) < 120 * 119


def slow_substrings(rows, length=100):
    seen, want = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(b[s : s + length])
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want.append((i or -1, len(b), sum(gone), sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(want)


def substrings(df, length=100):
    return sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.dedup_substrings(df, length).collect())


def test_substrings(spark, docs):
    assert substrings(docs) == slow_substrings(raw(docs)) and suffix.dedup_substrings(empty(spark)).count() == 0


@pytest.mark.parametrize("length", [60, 72, 100, 150])
def test_substrings_of_spliced_texts(spark, length):
    """Texts made of pieces of one another, cut around the threshold, runs of one byte, and copies, over several partitions."""
    r = random.Random(length)
    base, rows = [prose(60 + i, 60) for i in range(6)] + ["a" * 400, "ab" * 200, "é" * 150], []
    for i in range(60):
        parts = []
        for _ in range(r.randrange(1, 4)):
            b = r.choice(base)
            at = r.randrange(max(1, len(b) - length))
            parts.append(b[at : at + length + r.randrange(-25, 26)])
            parts.append(prose(r.random(), r.randrange(1, 6)))
        rows.append((i, " ".join(parts)))
    rows += [(70, rows[0][1]), (71, rows[1][1] + rows[2][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got, want = substrings(df, length), slow_substrings(rows, length)
    assert got == want and 20 < sum(1 for x in want if x[2])


def test_lm_scores(spark, docs):
    r = random.Random(2)
    pair = {w: r.sample(WORDS, 2) for w in WORDS}

    def chain(n):
        out = [r.choice(WORDS)]
        while len(out) < n:
            out.append(r.choice(pair[out[-1]]))
        return " ".join(out)

    df = spark.createDataFrame([(i, chain(150)) for i in range(300)], "doc_id long, text string")
    model = lmscore.gather(df)
    weights = lmscore.train(lmscore.token_ids(df, model, "doc_id"), model.counts, model.side)
    noise = " ".join("".join(chr(97 + r.randrange(26)) for _ in range(6)) for _ in range(200))
    held = [(1, chain(200)), (2, " ".join(r.choice(WORDS) for _ in range(200))), (3, None), (4, ""), (5, noise)]
    got = {x.doc_id: x for x in lmscore.score(lmscore.token_ids(spark.createDataFrame(held, "doc_id long, text string"), model, "doc_id"), weights, model.side).collect()}
    unigram = np.log(1 / len(WORDS))
    assert got[1].mean_log_likelihood > got[2].mean_log_likelihood + 0.2 and got[1].mean_log_likelihood > unigram + 0.2
    assert got[5].mean_log_likelihood < got[2].mean_log_likelihood - 5
    assert (got[3].n_tokens, got[3].log_likelihood, got[3].mean_log_likelihood) == (0, 0.0, None) and got[4].n_tokens == 0
    assert lmscore.score_corpus(docs).count() == docs.count()
    assert lmscore.score_corpus(empty(spark)).count() == 0


def test_lm_counts_and_spellings(spark):
    """All words are counted; words outside the vocabulary have the probability of their spelling, which sums to one."""
    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(r.choice([9, 4000]))}" for _ in range(300)) + " É \u00a0x" for _ in range(60)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = {}
    for t in texts:
        for w in (t or "").lower().split():
            want[w] = want.get(w, 0) + 1
    assert {x.word: x.n for x in lmscore.word_counts(df).collect()} == want
    model = lmscore.gather(df)
    top = sorted(want, key=lambda w: (-want[w], w.encode()))[: model.side**2 - 1]
    assert model.side == 32 and set(model.ids) == set(top) and len(want) > len(top)
    rare = {w: n for w, n in want.items() if w not in model.ids}
    assert model.counts[-1] == 0.5 + sum(rare.values())
    table = np.zeros((lmscore.CONTEXTS, lmscore.SYMBOLS))
    fold = lambda x: ((x & 63) ^ (x >> 6)) & 63
    for w, n in rare.items():
        a = b = 0
        for x in [*w.encode(), lmscore.END]:
            table[a << 6 | b, x] += n
            a, b = b, fold(x)
    base = (table.sum(axis=0) + 0.1) / (table.sum() + 0.1 * lmscore.SYMBOLS)
    log = np.log((table + 4 * base) / (table.sum(axis=1, keepdims=True) + 4))
    assert np.allclose(model.spelling, log.reshape(-1), atol=1e-4) and np.allclose(np.exp(log).sum(axis=1), 1)
    for x in lmscore.token_ids(df, model, "doc_id").collect():
        words = (texts[x.doc_id] or "").lower().split()
        total = 0.0
        for w in words:
            a = b = 0
            for s in [*w.encode(), lmscore.END] if w in rare else []:
                total += log[a << 6 | b, s]
                a, b = b, fold(s)
        assert np.frombuffer(x.ids, np.uint16).tolist() == [model.ids.get(w, model.side**2) for w in words] and abs(x.spelled - total) < 1e-3


def test_lm_masks_every_place_once():
    n = np.array([5, 0, 70, 1])
    seen = [p for turn in range(3) for p in lmscore._masked(n, turn, 3, 17).tolist()]
    assert sorted(seen) == lmscore._places(n).tolist()


def branches_of(nodes):
    """Root-to-leaf paths of one tree as lists of node numbers, by walking up from every node without replies."""
    parent = {n: p if p in nodes else None for n, (p, *_) in nodes.items()}
    replied = {p for n, (p, *_) in nodes.items() if p is not None}
    out = []
    for leaf in nodes:
        if leaf in replied:
            continue
        path, seen = [leaf], {leaf}
        while parent[path[-1]] is not None and parent[path[-1]] not in seen:
            path.append(parent[path[-1]])
            seen.add(path[-1])
        if parent[path[-1]] is None:  # not led into a cycle
            out.append(path[::-1])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_chat_branches_are_brute_force(spark, seed):
    r, trees = random.Random(seed), {}
    for t in range(12):
        nodes = {}
        for n in range(r.randint(1, 25)):
            far = r.random() < 0.1
            p = None if n == 0 or r.random() < 0.05 else 900 + n if far else n - 1 if t % 3 == 0 else r.randrange(n)
            nodes[n] = (p, r.choice(["user", "assistant", "sys\ntem&#10;", None]), r.choice(["", None, "<|im_end|>\n", "&lt;| é𝄞", "a\nb"]), r.choice([0.0, 0.5, 1.0, None]))
        if t % 4 == 1 and len(nodes) > 2:
            nodes[0] = (2, *nodes[0][1:])  # perhaps a cycle
        trees[t] = nodes
    rows = [(t, n, *x) for t, nodes in trees.items() for n, x in nodes.items()]
    out = chat.format_trees(spark.createDataFrame(rows * 2, "tree long, node long, parent long, role string, text string, score double"), keep=None)
    got = {(x.tree, x.branch_rank): x for x in out.withColumn("turns", chat.parsed_turns(F.col("formatted"))).withColumn("said", chat.loss_texts(F.col("formatted"), F.col("loss_spans"))).collect()}
    want = {}
    for t, nodes in trees.items():
        paths = branches_of(nodes)
        mean = {p[-1]: sum(nodes[n][3] or 0.0 for n in p) / len(p) for p in paths}
        for rank, p in enumerate(sorted(paths, key=lambda p: (-mean[p[-1]], -len(p), p[-1])), 1):
            want[t, rank] = (p[-1], [(nodes[n][1] or "", nodes[n][2] or "") for n in p])
    assert {k: (x.leaf, [tuple(y) for y in x.turns]) for k, x in got.items()} == want
    assert all(x.said == [text for role, text in want[k][1] if role == "assistant"] for k, x in got.items())
