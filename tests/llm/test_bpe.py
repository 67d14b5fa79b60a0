from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from urltriage.llm import bpe
from urltriage.llm.tokens import SYMBOLS, ByteBpe, WordBpe, encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LETTERS = "aé \n\t\x1c\xa0 'sStTl<|endoftext|>9½Ǻßİ!. 中—́"


def numbers(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


@pytest.mark.parametrize(("kind", "path"), [(ByteBpe, BYTE), (WordBpe, WORD)])
def test_encoder_equals_the_library(kind, path):
    rng = random.Random(5)
    words = encoder(kind, path)
    texts = ["".join(rng.choices(LETTERS, k=rng.randint(0, 60))) for _ in range(4000)]
    texts += ["it's 'll ' s", " x", "x  ", "a  b\n\n c", "<|endoftext|> <|endoftext|>a", "é ́e", "DON'T"]
    for text in texts:
        want = words.library.encode(text, add_special_tokens=False).ids
        assert numbers(words.encode(text)) == want, repr(text)
        if kind is ByteBpe:
            assert words.decode(want) == words.library.decode(want, skip_special_tokens=False)


def test_slabs_of_a_long_text(monkeypatch):
    monkeypatch.setattr("urltriage.llm.tokens.SLAB_CHARS", 50)
    rng = random.Random(6)
    for kind, path in ((ByteBpe, BYTE), (WordBpe, WORD)):
        words = encoder(kind, path)
        for _ in range(200):
            text = "".join(rng.choices("ab  \n.\t'é", k=400))
            assert numbers(words.encode(text)) == words.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefgh", "éa", "=", " ", "0123456789", "ethanio"])
def test_joined_halves_equal_the_whole(alphabet):
    rng = random.Random(7)
    words = encoder(ByteBpe, BYTE)
    for _ in range(60):
        symbols = "".join(SYMBOLS[b] for b in "".join(rng.choices(alphabet, k=rng.randint(20, 400))).encode())
        parts = [words.model_ids(p) for p in bpe._halves(symbols, 16)]
        assert bpe.join_tree(parts, words, window=1) == words.model_ids(symbols)


@pytest.mark.parametrize("alphabet", ["abc", "ab c", "a\n b'sé!!9", "<|endoftext|>a b", " \t", "ab中'll\xa0"])
def test_leaves_fold_to_the_whole(alphabet):
    rng = random.Random(8)
    words = encoder(ByteBpe, BYTE)
    for _ in range(120):
        text = "".join(rng.choices(alphabet, k=rng.randint(1, 500)))
        text += rng.choice(["", "<|endoftext|>", "x" * 100, "!" * 70])
        cut = bpe.leaves(text, words, 24)
        ids = bpe.fold([k for k, _ in cut], [bpe._leaf_ids(k, t, words) for k, t in cut], words, 1)
        assert numbers(ids) == words.library.encode(text, add_special_tokens=False).ids, repr(text)


def test_digests(spark):
    rng = random.Random(9)
    texts = [None, "", "hello  world", "x" * 3000, "".join(rng.choices("ab c.é", k=2500))]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, texts[3], "c"), (4, texts[4], "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encode_digests(docs, BYTE, leaf_chars=100).collect()
    assert len(got) == len(rows)
    library = encoder(ByteBpe, BYTE).library
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append(
            (
                doc_id,
                len(ids),
                hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(decoded.encode()).hexdigest(),
            )
        )
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encode_digests(docs.limit(0), BYTE).count() == 0
