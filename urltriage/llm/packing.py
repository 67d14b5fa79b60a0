"""Order-preserving packing of documents into fixed windows of tokens.

The documents of a partition stand in a row, in their order. Dynamic programming
over document and sentence ends chooses where windows are cut, so that padding plus
the penalties of cuts inside documents is least. The cost of a window is linear in
its length, so the best start of the window that ends at a boundary is the front of
a monotone queue. Windows whose length is a power of two need no padding and are
further transitions.

A row is treated in stretches of bounded length; the end of a stretch, from its
last chosen cut on, is carried into the next one. Only the end of the row is filled
up, or cut into powers of two where that costs less.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from urltriage.llm.common import col
from urltriage.llm.tokens import WordBpe, encoder


@dataclass(frozen=True)
class Layout:
    """Window size, and costs in tokens of padding."""

    window: int = 4096
    #: Cut at the end of a sentence inside a document.
    sentence_cut: int = 2
    #: Cut inside a sentence.
    inner_cut: int = 64
    #: Smallest window that is not filled up because its length is a power of two.
    least_power: int = 256
    #: Tokens of a stretch.
    stretch: int = 1 << 20
    #: Id behind each document.
    end_id: int = 2


PIECES = (
    "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def _boundaries(ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray, layout: Layout):
    """Positions at which the row ``ids`` may be cut, and the cost of a cut there.

    ``ends``: positions of the document ends, the last one is the end of the row.
    Sentences longer than the window get further positions.
    """
    closes = sentence_end[np.minimum(ids, len(sentence_end) - 1)]
    sentences = np.flatnonzero(closes[:-1] & ~closes[1:]) + 1
    at = np.unique(np.concatenate(([0], sentences, ends, [len(ids)])))
    gaps = np.diff(at)
    if len(gaps) and gaps.max() > layout.window // 2:
        step = layout.window // 4
        inside = [
            np.arange(a + step, b, step)
            for a, b in zip(at[:-1][gaps > 2 * step], at[1:][gaps > 2 * step], strict=True)
        ]
        inner = np.concatenate(inside)
        at = np.unique(np.concatenate((at, inner)))
    else:
        inner = np.zeros(0, dtype=at.dtype)
    cost = np.full(len(at), layout.sentence_cut)
    cost[np.searchsorted(at, inner)] = layout.inner_cut
    cost[np.searchsorted(at, ends)] = 0
    cost[0] = 0
    return at, cost


def plan_windows(at: np.ndarray, cost: np.ndarray, layout: Layout) -> tuple[list[int], list[int]]:
    """Least total cost of a cut at each boundary, and the boundary at which its window begins."""
    window = layout.window
    place = np.full(int(at[-1]) + 1, -1, dtype=np.int64)
    place[at] = np.arange(len(at))
    exact: dict[int, list[int]] = {}
    power = layout.least_power
    while power < window:
        ends = np.flatnonzero(at >= power)
        begins = place[at[ends] - power]
        for j, i in zip(ends[begins >= 0].tolist(), begins[begins >= 0].tolist(), strict=True):
            exact.setdefault(j, []).append(i)
        power *= 2
    positions, costs = at.tolist(), cost.tolist()
    best, begin = [0] * len(positions), [0] * len(positions)
    queue = deque([(0, 0, 0)])  # best + position, position, boundary; both of the first two increase
    for j in range(1, len(positions)):
        here = positions[j]
        while queue[0][1] < here - window:
            queue.popleft()
        least, _, i = queue[0]
        total = least + window - here
        for k in exact.get(j, ()):
            if best[k] < total:
                total, i = best[k], k
        best[j], begin[j] = total + costs[j], i
        entry = best[j] + here
        while queue and queue[-1][0] >= entry:
            queue.pop()
        queue.append((entry, here, j))
    return best, begin


@cache
def _tail_plans(layout: Layout) -> list[tuple[int, int]]:
    """For each length of a last window: its least cost and the first power of two to cut off, or 0."""
    plans = [(0, 0)]
    for n in range(1, layout.window + 1):
        options = [(0 if n & (n - 1) == 0 else layout.window - n, 0)]
        power = 1
        while power < n:
            options.append((layout.inner_cut + plans[n - power][0], power))
            power *= 2
        plans.append(min(options))
    return plans


def _tail(begin: int, end: int, layout: Layout) -> list[int]:
    plans, cuts = _tail_plans(layout), []
    while power := plans[end - begin][1]:
        begin += power
        cuts.append(begin)
    return [*cuts, end]


def choose_cuts(at: np.ndarray, cost: np.ndarray, layout: Layout, last: bool) -> list[int]:
    """Positions of the window ends of a row; what is behind the last one stays open unless ``last``."""
    best, begin = plan_windows(at, cost, layout)
    end = int(at[-1])
    j = len(at) - 1
    if not last:
        near = int(np.searchsorted(at, end - layout.window, side="right"))
        if near >= len(at) or near == 0:
            return []
        j = min(range(near, len(at)), key=lambda k: (best[k], -k))
    chosen = []
    while j:
        chosen.append(j)
        j = begin[j]
    cuts = at[chosen[::-1]].tolist()
    if last and cuts:
        cuts[-1:] = _tail(cuts[-2] if len(cuts) > 1 else 0, end, layout)
    return cuts


class Packer:
    """Packs documents that arrive one by one and returns the pieces of finished windows."""

    def __init__(self, sentence_end: np.ndarray, layout: Layout, first_sequence: int):
        self.sentence_end, self.layout, self.sequence = sentence_end, layout, first_sequence
        self.names: list = []  # of documents of which tokens are waiting
        self.sizes: list[int] = []  # their whole token counts
        self.data: list[bytes] = []  # their waiting tokens
        self.done = 0  # tokens of the first of them that are packed
        self.waiting = 0

    def add(self, name, ids: bytes) -> Iterator[tuple]:
        ids += int(self.layout.end_id).to_bytes(4, "little")
        self.names.append(name)
        self.sizes.append(len(ids) // 4)
        self.data.append(ids)
        self.waiting += len(ids) // 4
        if self.waiting >= self.layout.stretch:
            yield from self.flush(last=False)

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.waiting:
            return
        row = b"".join(self.data)
        ends = np.cumsum([len(d) // 4 for d in self.data])
        at, cost = _boundaries(np.frombuffer(row, "<u4"), ends, self.sentence_end, self.layout)
        cuts = np.array(choose_cuts(at, cost, self.layout, last), dtype=np.int64)
        if not len(cuts):
            return
        closed = int(cuts[-1])
        starts = np.concatenate(([0], ends[:-1]))
        begins = np.unique(np.concatenate(([0], cuts, starts)))
        begins = begins[begins < closed]
        stops = np.append(begins[1:], closed)
        document = np.searchsorted(starts, begins, side="right") - 1
        sequence = np.searchsorted(cuts, begins, side="right")
        window_start = np.concatenate(([0], cuts))[sequence]
        start = begins - starts[document]
        start[document == 0] += self.done
        yield (
            [self.names[d] for d in document.tolist()],
            start,
            stops - begins,
            np.array(
                [zlib.crc32(row[4 * a : 4 * b]) for a, b in zip(begins.tolist(), stops.tolist(), strict=True)],
                dtype=np.int64,
            ),
            np.array(self.sizes, dtype=np.int64)[document],
            sequence + self.sequence,
            begins - window_start,
        )
        self.sequence += len(cuts)
        first = int(np.searchsorted(ends, closed, side="right"))  # first document with tokens left
        kept = self.data[first:]
        if kept:
            into = closed - int(starts[first])
            self.done = into + (self.done if first == 0 else 0)
            kept[0] = kept[0][4 * into :]
        else:
            self.done = 0
        self.names, self.sizes, self.data = self.names[first:], self.sizes[first:], kept
        self.waiting = sum(map(len, kept)) // 4


def sentence_ends(path: str) -> np.ndarray:
    """For each id whether its token ends a sentence."""
    vocabulary = encoder(WordBpe, path).library.get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    for token, i in vocabulary.items():
        out[i] = token.removesuffix("</w>").endswith((".", "!", "?"))
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    layout: Layout = Layout(),
) -> DataFrame:
    """Pieces of windows, in document order within each partition of ``docs``.

    ``tokenizer``: file of a vocabulary in lower case with word ends. Columns:
    ``doc_id``, ``start`` (ids of the document before the piece), ``length``,
    ``ids_crc32``, ``doc_tokens`` (with the closing id), ``sequence_id``, ``offset``.
    A null or empty text is its closing id alone. Null and repeated ids are packed as
    they come; each row is its own document. An empty table gives no pieces. Other
    columns are ignored. Sequence ids hold the number of the partition.
    """
    source = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        words = encoder(WordBpe, tokenizer)
        packer = Packer(
            sentence_ends(tokenizer), layout, TaskContext.get().partitionId() << 40
        )

        def rows(pieces):
            for doc_id, *numbers in pieces:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_id, type=id_type), *(pa.array(n, type=pa.int64()) for n in numbers)], names=names
                )

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from rows(packer.add(name, words.encode(text)))
        yield from rows(packer.flush(last=True))

    return source.mapInArrow(run, PIECES.format(id=kind))
