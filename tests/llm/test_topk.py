from __future__ import annotations

import math
import random

import numpy as np
import pytest

from urltriage.llm.topk import best_rows, slice_block, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, k, every):
    usable = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in {(i, tuple(v)) for i, v in usable if i % every == 0}:
        scored = [(-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in usable if i != q and len(a) == len(b)]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 1000])
def test_equals_brute_force(spark, block):
    rng = random.Random(block)
    same = [0.25, -0.5, 0.125]
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(60)]
    rows += [(100 + i, same) for i in range(40)]  # many ties
    rows += [(200, None), (None, same), (201, [0.1, None, 0.2]), (202, [0.1, float("nan"), 0.2]), (203, [0.1, float("inf"), 0.2])]
    rows += [(205, [1.0, 2.0]), (210, [3.0, -1.0]), (220, [])]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], SCHEMA)
    got = top_k(df, k=5, every=5, block_rows=block, block_queries=4)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 5)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0], 1, "c"), (3, [2.0], 1, "c")], SCHEMA)
    assert list(map(tuple, top_k(df).collect())) == [(0, 1, 3, 256 * 512)]
    assert top_k(df.limit(0)).count() == 0


def test_too_large_components_are_reported(spark):
    df = spark.createDataFrame([(0, [1e30], 1, "c"), (3, [2.0], 1, "c")], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        top_k(df).collect()


def test_slices():
    rng = np.random.default_rng(4)
    for rows in (1, 63, 64, 200):
        x = rng.integers(-300, 300, (rows, 5))
        block = slice_block(np.arange(rows), x)
        slices = np.frombuffer(block["slices"], np.uint64).reshape(5, block["bits"], -1)
        every = np.packbits(np.ones(rows, dtype=bool), bitorder="little")
        every = np.pad(every, (0, -len(every) % 8)).view(np.uint64)
        for w in (np.zeros(5, dtype=np.int64), rng.integers(-200, 200, 5)):
            chosen = best_rows(slices, every, w, 7)
            order = sorted(range(rows), key=lambda r: (-int(x[r] @ w), r))[:7]
            assert sorted(chosen.tolist()) == sorted(order)
