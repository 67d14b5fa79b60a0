"""Exact top-k inner products with a bit-sliced index.

The integer attributes of a block of vectors are stored as slices: one bitmap over
the rows for each attribute and bit. A query's score is a sum of slices shifted by
the bits of its weights; slices of one weight are added with carry-save adders, so
the scores of a block again stand in slices. The best rows are chosen from the most
significant slice downward; rows that tie at the boundary are resolved by their id.

Attributes are stored above their smallest possible value, and a negative weight
takes the complement, so that all terms are positive.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urltriage.llm.common import col, stored

#: Rows of an index block, and queries that are asked together.
BLOCK_ROWS = 16_384
BLOCK_QUERIES = 64
SCALE = 256
#: Components must stay below, so that scores of some thousand dimensions fit a long.
LARGEST = 1 << 25

_INDEX = "dims int, rows int, bits int, low long, vec_ids binary, slices binary, components binary"
_ASKED = "dims int, query_ids binary, weights binary"


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id``, ``x`` (array of long) of the rows that take part."""

    def usable(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)

    def whole(x: Column) -> Column:
        value = F.floor(F.lit(SCALE) * x)
        return F.when(F.abs(F.lit(SCALE) * x) < LARGEST, value).otherwise(
            F.raise_error(F.lit("a vector component is too large for an integer score")).cast("long")
        )

    rows = vectors.select(
        col(id_col).cast("long").alias("vec_id"), col(vector_col).cast("array<double>").alias("x")
    )
    return rows.where(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", usable)
    ).select("vec_id", F.transform("x", whole).alias("x"))


def _chunks(frames, size: int):
    """(dims, ids, matrix) of at most ``size`` rows with equally long vectors."""
    waiting = defaultdict(lambda: ([], []))
    for frame in frames:
        for vec_id, x in zip(frame["vec_id"], frame["x"], strict=True):
            ids, rows = waiting[len(x)]
            ids.append(vec_id)
            rows.append(x)
            if len(ids) == size:
                yield len(x), np.array(ids, dtype=np.int64), np.array(rows, dtype=np.int64).reshape(size, -1)
                ids.clear()
                rows.clear()
    for dims, (ids, rows) in waiting.items():
        if ids:
            yield dims, np.array(ids, dtype=np.int64), np.array(rows, dtype=np.int64).reshape(len(ids), -1)


def _pack(bits: np.ndarray) -> np.ndarray:
    """Bitmaps of 64-bit words along the last axis."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    pad = -packed.shape[-1] % 8
    padded = np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, pad)])
    return np.ascontiguousarray(padded).view(np.uint64)


def slice_block(ids: np.ndarray, x: np.ndarray) -> dict:
    """Index of a block: rows in order of their id, slices by attribute and bit."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    low = int(x.min()) if x.size else 0
    bits = max(1, int(x.max() - low).bit_length()) if x.size else 1
    above = (x - low).T
    slices = np.stack([_pack((above >> b) & 1 == 1) for b in range(bits)], axis=1)
    return {
        "dims": x.shape[1],
        "rows": len(ids),
        "bits": bits,
        "low": low,
        "vec_ids": ids.tobytes(),
        "slices": slices.tobytes(),
        "components": x.astype(np.int32).tobytes(),
    }


def _added(columns: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Adds bitmaps of weight 2**level, given as stacks by level; returns the slices of the sums."""
    out, level = [], 0
    while any(k >= level for k in columns):
        stacks = columns.pop(level, [])
        stack = np.concatenate(stacks) if stacks else None
        while stack is not None and len(stack) > 1:
            full = len(stack) // 3
            if full:
                a, b, c = stack[:full], stack[full : 2 * full], stack[2 * full : 3 * full]
                either = a ^ b
                carry = (a & b) | (either & c)
                stack = np.concatenate((either ^ c, stack[3 * full :]))
            else:
                carry, stack = (stack[0] & stack[1])[None], (stack[0] ^ stack[1])[None]
            columns.setdefault(level + 1, []).append(carry)
        out.append(stack[0] if stack is not None else None)
        level += 1
    return out


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def _rows(bitmap: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` rows of a bitmap."""
    found = []
    for word in np.flatnonzero(bitmap):
        bits = int(bitmap[word])
        while bits and len(found) < most:
            found.append(64 * int(word) + (bits & -bits).bit_length() - 1)
            bits &= bits - 1
        if len(found) == most:
            break
    return np.array(found, dtype=np.int64)


def best_rows(slices: np.ndarray, allowed: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Rows with the ``k`` highest sums of weights, among equal ones the first rows.

    ``slices``: (attributes, bits, words); ``allowed``: bitmap of rows that may be chosen.
    """
    levels = defaultdict(list)
    bits = slices.shape[1]
    for bit in range(int(np.abs(weights).max()).bit_length() if weights.size else 0):
        has = (np.abs(weights) >> bit) & 1 == 1
        plus, minus = slices[has & (weights > 0)], ~slices[has & (weights < 0)]
        for b in range(bits):
            for part in (plus, minus):
                if len(part):
                    levels[bit + b].append(part[:, b])
    sure, open_ = np.zeros_like(allowed), allowed
    n_sure = 0
    for level in reversed(_added(levels)):
        if level is None:
            continue
        high = open_ & level
        n = n_sure + _count(high)
        if n > k:
            open_ = high
            continue
        sure, n_sure, open_ = sure | high, n, open_ & ~level
        if n == k:
            break
    return np.concatenate((_rows(sure, k), _rows(open_, k - n_sure)))


def _answers(block: dict, query_ids: np.ndarray, weights: np.ndarray, k: int):
    ids = np.frombuffer(block["vec_ids"], np.int64)
    dims, rows = block["dims"], block["rows"]
    words = -(-rows // 64)
    slices = np.frombuffer(block["slices"], np.uint64).reshape(dims, block["bits"], words)
    x = np.frombuffer(block["components"], np.int32).reshape(rows, dims)
    every = _pack(np.ones(rows, dtype=bool))
    for query_id, w in zip(query_ids.tolist(), weights, strict=True):
        allowed = every
        first, last = np.searchsorted(ids, query_id, "left"), np.searchsorted(ids, query_id, "right")
        if last > first:
            own = np.zeros(rows, dtype=bool)
            own[first:last] = True
            allowed = every & ~_pack(own)
        chosen = best_rows(slices, allowed, w, k)
        yield query_id, ids[chosen], x[chosen].astype(np.int64) @ w


def top_k(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """The ``k`` highest inner products of each query row with all other rows.

    Queries are the rows whose id is divisible by ``every``. Components count as
    floor(256 * x). Columns: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``;
    among equal scores the smaller id comes first; fewer rows than ``k`` are all
    returned. Rows whose id or vector is null, or that hold a null or non-finite
    component, take no part. Vectors are compared with those of their own length.
    Rows with the query's id are its own, also if there are several; of repeated
    query rows with different vectors, each asks, and the best answers of all count.
    A component beyond 2**25 / 256 raises an error. An empty table gives an empty
    result. Other columns are ignored.
    """
    rows = stored(quantised(vectors, id_col, vector_col), "vectors")
    total = rows.count()
    blocks = max(1, math.ceil(total / block_rows))

    def index(frames):
        for _, ids, x in _chunks(frames, block_rows):
            yield pd.DataFrame([slice_block(ids, x)])

    def ask(frames):
        for dims, ids, x in _chunks(frames, block_queries):
            yield pd.DataFrame([{"dims": dims, "query_ids": ids.tobytes(), "weights": x.tobytes()}])

    indexed = stored(
        rows.repartition(blocks).mapInPandas(index, _INDEX).withColumn("block", F.monotonically_increasing_id()),
        "bit-slices",
    )
    # Number and length of the blocks: a row for each block_rows vectors.
    asked_of = indexed.select("dims", "block").groupBy("dims").agg(F.collect_list("block").alias("blocks"))
    queries = rows.where(F.col("vec_id") % every == 0).distinct()
    asked = queries.repartition(max(1, math.ceil(blocks / every))).mapInPandas(ask, _ASKED)
    cells = (
        asked.join(asked_of, "dims")
        .select("query_ids", "weights", F.explode("blocks").alias("block"))
        .join(indexed, "block")
    )

    def answer(frames):
        for frame in frames:
            for cell in frame.to_dict("records"):
                query_ids = np.frombuffer(cell["query_ids"], np.int64)
                weights = np.frombuffer(cell["weights"], np.int64).reshape(len(query_ids), cell["dims"])
                for query_id, ids, scores in _answers(cell, query_ids, weights, k):
                    yield pd.DataFrame({"query_id": query_id, "vec_id": ids, "score": scores})

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        cells.mapInPandas(answer, "query_id long, vec_id long, score long")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
