from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from urltriage.llm.packing import Layout, Packer, pack, plan_windows

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts, layout):
    """Every id in one piece, windows gapless and short enough; returns padding."""
    windows = defaultdict(list)
    library = Tokenizer.from_file(PATH)
    documents = defaultdict(list)
    for r in rows:
        documents[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    for doc_id, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [layout.end_id]
        at = 0
        for r in sorted(documents[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            data = np.array(ids[at : at + r["length"]], dtype="<u4").tobytes()
            assert zlib.crc32(data) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for pieces in windows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= layout.window
        padding += 0 if at & (at - 1) == 0 else layout.window - at
    return padding


@pytest.mark.parametrize("stretch", [700, 1 << 20])
def test_pieces(spark, prose, stretch):
    layout = Layout(window=128, least_power=16, inner_cut=8, stretch=stretch)
    texts = {i: prose(i, n) for i, n in enumerate([0, 1, 5, 40, 300, 3000, 7, 90, 2, 1500])}
    texts |= {50: None, 51: "x" * 5000, 52: "no stop " * 900, 53: "Ünï \x1c ½ <|endoftext|> a"}
    rows = [(i, t, "c") for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").coalesce(2)
    got = pack(docs, PATH, layout=layout).collect()
    padding = check(got, texts, layout)
    total = sum(r["length"] for r in got)
    # Sentences are a quarter of this small window.
    assert padding < 0.1 * total
    assert pack(docs.limit(0), PATH).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = pack(docs, PATH).collect()
    assert sorted((str(r["doc_id"]), r["doc_tokens"]) for r in got) == [("1", 3), ("1", 3), ("None", 2)]


def test_plan_is_least(prose):
    """Against all ways to cut a short row."""
    rng = np.random.default_rng(2)
    for _ in range(60):
        layout = Layout(window=16, least_power=4)
        at = np.unique(np.concatenate(([0], rng.integers(1, 70, 25), [70])))
        at = np.unique(np.concatenate((at, np.arange(0, 70, 12))))
        cost = rng.integers(0, 5, len(at))
        best, begin = plan_windows(at, cost, layout)
        brute = [0] + [10**9] * (len(at) - 1)
        for j in range(1, len(at)):
            for i in range(j):
                n = int(at[j] - at[i])
                pad = 0 if n >= layout.least_power and n & (n - 1) == 0 else layout.window - n
                if n <= layout.window:
                    brute[j] = min(brute[j], brute[i] + pad + int(cost[j]))
        assert best == brute


def test_stretches_don_t_change_what_is_packed():
    ends = np.zeros(10, dtype=bool)
    ends[5] = True
    data = [bytes(np.array([1, 2, 5, 3] * n, dtype="<u4").tobytes()) for n in (3, 0, 50, 8, 200, 1)]
    for stretch in (8, 60, 10_000):
        packer = Packer(ends, Layout(window=64, least_power=8, stretch=stretch), 0)
        out = [p for i, d in enumerate(data) for p in packer.add(i, d)] + list(packer.flush(last=True))
        per_document = defaultdict(int)
        for ids, _, lengths, *_ in out:
            for i, n in zip(ids, lengths, strict=True):
                per_document[i] += int(n)
        assert dict(per_document) == {i: len(d) // 4 + 1 for i, d in enumerate(data)}
