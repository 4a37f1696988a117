"""Byte-level BPE: against tiktoken with the same ranks, exact appends and edits, decoding, edge cases."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.llm import prefix_bpe as B

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def own():
    return B.encoder(PATH, PATTERN)


@pytest.fixture(scope="module")
def library(own):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.vocabulary.ranks, special_tokens={})


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


ODD = ["", " ", "a  b", " a ", "it's we'll 'tis 'r 're", "x\n\n y\t\t", "naïve çà 漢字かな 🙂🙃", "<|endoftext|>", "　x\x85y\x1cz", " " * 5000 + "x", "ab1!" * 400, "a" * 3001, "\0\x01\x7f", "ʼn٣½Ⅻ", "е́ йй", "=" * 999 + " ==" * 50]


def test_texts_are_encoded_as_the_library_does(own, library):
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()] + ODD
    for text in texts:
        assert ids(own.ids(text)) == library.encode_ordinary(text)
        assert own.vocabulary.decode(own.ids(text)) == text.encode()


def test_pieces_of_the_pattern_are_the_library_s(own, library):
    """Each code point of the first four planes beside a letter, a digit and itself."""
    chars = [chr(c) for c in range(0x40000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(chars), 4096):
        text = "".join(f"a{c}{c}1 {c}'s\n" for c in chars[i : i + 4096])
        assert ids(own.ids(text)) == library.encode_ordinary(text)
    own.clear()
    odd = "".join(map(chr, own.table))[:50]
    text = f"ab{odd} cd{odd}1 'r{odd}e"
    kept = B.Text(own, text)
    kept.edit(3, 9, "x")
    assert ids(kept.ids()) == library.encode_ordinary(text[:3] + "x" + text[9:])


def random_bytes(rng, n):
    kind = rng.randrange(3)
    if kind == 0:
        return bytes(rng.choice(b"ab ") for _ in range(n))
    if kind == 1:
        return bytes(rng.randrange(256) for _ in range(n))
    return "".join(rng.choice(["the", "in", "ation", "e", "ü", "漢", "я", " ", "0"]) for _ in range(n)).encode()[:n]


def test_each_prefix_has_its_last_token(own):
    """Against merging each prefix anew by the defining rule."""
    rng = random.Random(1)
    for _ in range(150):
        data = random_bytes(rng, rng.randint(1, 30))
        table = B.Prefixes(own.vocabulary, data)
        assert list(table.last) == [own.vocabulary.merged(data[: i + 1])[-1] for i in range(len(data))]


def test_single_pieces_of_any_bytes(own, library):
    rng = random.Random(2)
    for n in [1, 2, 7, 40, 200, 1500]:
        for _ in range(40):
            data = random_bytes(rng, n)
            assert list(B.Prefixes(own.vocabulary, data).tokens()) == library._core_bpe.encode_single_piece(data)


def test_a_vocabulary_with_tokens_that_merging_never_makes():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"abcd": 300, b"xyz": 301}
    v = B.Vocabulary(ranks)
    import tiktoken

    library = tiktoken.Encoding("odd", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    own = B.Encoder(v, r"\S+|\s+")
    for text in ["xyz", "xyzz", "abcd", "abc xyz abcabcd", "bcabc"]:
        assert ids(own.ids(text)) == library.encode_ordinary(text)
    with pytest.raises(ValueError):
        B.Vocabulary({b"a": 0})


def test_appends_and_edits_of_bytes(own):
    rng = random.Random(3)
    for _ in range(200):
        data = random_bytes(rng, rng.randint(0, 300))
        table = B.Prefixes(own.vocabulary, data)
        for _ in range(4):
            a, b = sorted((rng.randint(0, len(data)), rng.randint(0, len(data))))
            b = min(b, a + rng.randint(0, 5))
            new = random_bytes(rng, rng.randint(0, 6))
            table.replace(a, b, new)
            data = data[:a] + new + data[b:]
            tail = random_bytes(rng, rng.randint(0, 9))
            table.append(tail)
            data += tail
            assert bytes(table.data) == data and table.last == B.Prefixes(own.vocabulary, data).last
    long = random_bytes(random.Random(4), 20_000)
    table = B.Prefixes(own.vocabulary, long)
    assert table.replace(10_000, 10_001, b"q") < 2000  # near the edit only
    assert table.last == B.Prefixes(own.vocabulary, long[:10_000] + b"q" + long[10_001:]).last


def test_appends_and_edits_of_texts(own):
    rng = random.Random(5)
    bits = ["'", "s", "re", " ", "  ", "\n", "word", "12", "é", "漢", "...", "x" * 70, "-" * 80]
    some = lambda n: "".join(rng.choice(bits) for _ in range(rng.randint(0, n)))
    for _ in range(150):
        text = some(40)
        kept = B.Text(own, text)
        for _ in range(6):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.randint(0, 8))
            new = some(3)
            kept.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert kept.text == text and kept.ids() == own.ids(text)
            new = some(3)
            kept.append(new)
            text += new
            assert kept.ids() == own.ids(text)
    kept = B.Text(own, "some words here " * 500)
    assert kept.edit(4000, 4003, "odd") < 10


def test_rows(spark, own):
    rows = [(1, None), (2, ""), (None, "abc"), (3, "word " * 30_000), (3, "word " * 30_000), (4, "z" * 20_000), (5, "it's 漢字")]
    docs = spark.createDataFrame(rows, "`doc id` long, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit("clash")).withColumn("key_", F.lit("clash"))
    got = B.encode(docs, key="doc id").collect()
    want = [(k, len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), x) for k, t in rows for x in [own.ids(t or "")]]
    by = lambda r: (r[0] is not None, r[0], r[2])
    assert sorted(((*r[:4], bytes(r[4])) for r in got), key=by) == sorted(want, key=by)
    assert B.encode(docs.limit(0), key="doc id", with_ids=False).collect() == []
