import base64
import os
import random

import pytest

from siltstone.llm import tokenize

pytestmark = pytest.mark.skipif(not os.path.exists(tokenize.VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def encoder():
    with open(tokenize.VOCABULARY, "rb") as f:
        return tokenize.BytePairEncoder(f.read())


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(tokenize.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokenize.PATTERN, mergeable_ranks=ranks, special_tokens={})


def naive(encoder, piece):
    """Merge the pair of least rank until none is left."""
    seq = [piece[i : i + 1] for i in range(len(piece))]
    while len(seq) > 1:
        pairs = [(encoder.rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(seq, seq[1:]))]
        r, i = min(pairs)
        if r == 1 << 60:
            break
        seq[i : i + 2] = [seq[i] + seq[i + 1]]
    return [encoder.rank[t] for t in seq]


def test_pieces_follow_naive_merging(encoder):
    r = random.Random(2)
    for alphabet in (b"ab", b"aei nrst", bytes(range(256)), b"0123 .,"):
        for _ in range(400):
            p = bytes(r.choice(alphabet) for _ in range(r.randint(1, 14)))
            assert encoder.encode_piece(p) == naive(encoder, p)


def test_pairs_fit_iff_they_encode_to_themselves(encoder):
    r = random.Random(4)
    tokens = [t for t in encoder.bytes if len(encoder.bytes[t]) < 7]
    for _ in range(3000):
        a, b = r.choice(tokens), r.choice(tokens)
        assert encoder.fits(a, b) == (naive(encoder, encoder.bytes[a] + encoder.bytes[b]) == [a, b])


def test_every_token_is_its_own_encoding(encoder):
    for t, b in encoder.bytes.items():
        assert encoder.encode_piece(b) == [t]


def test_texts(encoder, reference):
    r = random.Random(1)
    letters = "abc deéäß漢字 \n\t  0123.,!?'strUI​\U0001f600<|endoftext|>"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(2000)]
    texts += ["a" * 20_000, "\n" * 5000, " " * 4001 + "x", "=-" * 4000, " ", "  "]
    for t in texts:
        ids = encoder.encode(t)
        assert ids == reference.encode_ordinary(t)
        assert b"".join(encoder.bytes[i] for i in ids).decode() == t


def test_remembered_pieces_are_bounded(encoder, monkeypatch):
    monkeypatch.setattr(tokenize, "REMEMBERED", 10)
    for i in range(100):
        encoder.encode(f"word{i}")
    assert len(encoder.pieces) <= 10


def test_corpus(spark, data, reference):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " ", "x"), (4, "Order. Order.", "x"), (4, "Order. Order.", "x")], "doc_id long, text string, ids string")
    got = [(r.doc_id, r.ids) for r in tokenize.encode_corpus(df).orderBy("doc_id").collect()]
    order = reference.encode_ordinary("Order. Order.")
    assert got == [(1, []), (2, []), (3, reference.encode_ordinary(" ")), (4, order), (4, order)]
    assert tokenize.encode_corpus(df.limit(0)).count() == 0
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = {r.doc_id: reference.encode_ordinary(r.text or "") for r in docs.collect()}
    assert {r.doc_id: r.ids for r in tokenize.encode_corpus(docs).collect()} == want


def test_hugging_face_vocabulary_agrees(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenize.VOCABULARY.replace(".tiktoken", ".json")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    for text in ("Hello, world!", "größe=929;maß=33", "<|endoftext|>", "l'a-t-il appris ?\n\n  x"):
        assert encoder.encode(text) == t.encode(text, add_special_tokens=False).ids
