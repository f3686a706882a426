"""Prefix BPE against the tokenizers library: ids, decoded texts, edge cases of tables."""

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("gridlark.llm")

from gridlark.llm import bpe, prefixbpe  # noqa: E402
from gridlark.llm.queries import op12_prefix_bpe  # noqa: E402

PARTS = [" ", "  ", "\n", "'s", "'", "1", "23", "\u00e9", "\u00df", "\u65e5", "a", "the", "ing", "<|endoftext|>", "<|", "!?", "\u2009", "\u3000", "\U0001f600", "_", "\t", "Ab", "\u0300", "\u0661", "\u2163", "\x1c", "\u00a0"]
FIXED = ["", " ", "a  b", "tab\t x\n\n y ", "<|endoftext|>", " x<|endoftext|><|endoftext|> y", "\u65e5\u672c" * 300, "a" * 4000, "ab" * 2000, "ab " * 20_000, "x\t", " \u00a0z"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def encoder():
    return prefixbpe.PrefixEncoder(bpe.default_path())


def mixed(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_ids_and_texts_are_the_librarys(encoder, library):
    texts = FIXED + mixed(1, 3000)
    ids, ends = encoder.encode(texts)
    for text, k, decoded in zip(texts, range(len(texts)), encoder.vocabulary.texts(ids, ends)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[ends[k] : ends[k + 1]].tolist() == want
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_ids_that_are_no_text_decode_as_the_library_does(encoder, library):
    r = np.random.default_rng(2)
    lists = [r.integers(0, encoder.vocab_size, r.integers(0, 30)).tolist() for _ in range(300)]
    ids = np.array([i for x in lists for i in x], np.uint32)
    ends = np.cumsum([0, *map(len, lists)])
    assert prefixbpe.decoder().texts(ids, ends) == [library.decode(x, skip_special_tokens=False) for x in lists]


def test_pairs_of_tokens_are_compatible_if_the_library_keeps_them(encoder, library):
    v, r = encoder.vocabulary, np.random.default_rng(3)
    whole = [i for i in range(v.size) if v.raw[i].isalpha() and v.raw[i].isascii()]  # one pretoken together
    a, b = r.choice(whole, (2, 4000))
    got = v.first_crossing(a, b) == prefixbpe.NEVER
    want = [library.encode((v.raw[x] + v.raw[y]).decode(), add_special_tokens=False).ids == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert got.tolist() == want and 0 < sum(want) < len(want)
    assert (got == (v.first_crossing(a, b, any_will_do=True) == prefixbpe.NEVER)).all()


@pytest.mark.parametrize("rows, chars", [(20, 10**6), (10**6, 100)])
def test_forgotten_pieces_are_encoded_anew(library, rows, chars):
    small = prefixbpe.PrefixEncoder(bpe.default_path(), rows, chars)
    for seed in range(4):
        texts = mixed(seed, 20)
        ids, ends = small.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_table_edge_cases(spark, library):
    rows = [(1, "x y"), (1, "x y"), (2, None), (3, ""), (None, "tis <|endoftext|>"), (5, "long " * 50_000)]
    docs = spark.createDataFrame([(i, t, "i", "t") for i, t in rows], "doc_id long, text string, ids string, `a.b` string")
    out = prefixbpe.decode_documents(prefixbpe.encode_documents(docs)).collect()
    assert sorted(map(str, out)) == sorted(map(str, prefixbpe.encode_documents(docs, decoded=True).collect()))
    got = sorted((r.doc_id or 0, r.text, np.frombuffer(r.ids, "<u4").tolist()) for r in out)
    assert got == sorted((i or 0, t or "", library.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    none = prefixbpe.decode_documents(prefixbpe.encode_documents(docs.limit(0)))
    assert none.count() == 0 and none.columns == ["doc_id", "ids", "text"]
    assert prefixbpe.decode_documents(spark.createDataFrame([(1, None)], "doc_id long, ids binary")).first().text == ""


def test_query(spark, library):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op12_prefix_bpe(spark, d).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode()))
    assert len(got) == len(docs)
