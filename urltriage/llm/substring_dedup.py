"""Repeated passages by content-defined chunking.

A gear hash of the last 16 bytes decides where a chunk ends, so chunks depend on
nearby content only and are the same again a few words after an insertion. Chunks
with the same digest in several documents are shared. Consecutive shared chunks of a
document form a passage; a passage counts if it is long enough, and not only through
tiny chunks that many documents have by chance.

Where there is no ASCII white space for long (Chinese, Japanese, Thai, encoded data),
a number of bytes stands for a word, both for the cuts and for the length of a passage.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urltriage.llm.common import col, fresh, stored

#: Bytes that are hashed together.
SLAB_BYTES = 1 << 22
GEAR_BYTES = 16
#: Bytes without white space after which text counts as unspaced.
UNSPACED_BYTES = 32
#: Bytes of a character by its first byte; none for the others.
_WIDTH = np.array([1] * 128 + [0] * 64 + [2] * 32 + [3] * 16 + [4] * 16, dtype=np.uint32)
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b])) for b in range(256)], dtype=np.uint32)
_DIGESTS = "digest long, doc_id {id}"
_CHUNKS = _DIGESTS + ", no int, start int, stop int, words int"


@dataclass(frozen=True)
class Passages:
    #: Mean length of a chunk in words; long words are cut every ``bytes`` bytes, too.
    words: int = 4
    bytes: int = 512
    #: Least words of the chunks inside a passage. The ends of a repeated text, up to
    #: its first and from its last cut, lie outside.
    least_words: int = 24
    #: Words of a chunk that count as chance.
    chance_words: int = 2
    #: Least words of a passage beyond those.
    least_beyond: int = 8
    #: Bytes of unspaced text that stand for a word.
    word_bytes: int = 6


def _gear(data: np.ndarray) -> np.ndarray:
    """Gear hash of the ``GEAR_BYTES`` bytes that end at each position."""
    h = _GEAR[data]
    width = 1
    while width < GEAR_BYTES:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h, width = longer, 2 * width
    return h


class Unspaced:
    """Stretches of ``data`` whose texts have no white space in the ``UNSPACED_BYTES`` before."""

    def __init__(self, data: np.ndarray, begins: np.ndarray):
        # A text begins as after white space; the end of the data closes the last stretch.
        white = data <= 32
        white[begins[begins > 0] - 1] = True
        head = [-1] if (begins == 0).any() else []
        breaks = np.concatenate((np.array(head, dtype=np.int64), np.flatnonzero(white), [len(data)]))
        long = np.flatnonzero(np.diff(breaks) > UNSPACED_BYTES + 1)
        self.start, self.stop = breaks[long] + 1 + UNSPACED_BYTES, breaks[long + 1]
        self.before = np.concatenate(([0], np.cumsum(self.stop - self.start)))

    def inside(self, at: np.ndarray) -> np.ndarray:
        """Which positions lie in a stretch."""
        k = np.searchsorted(self.start, at, side="right")
        return at < np.concatenate(([0], self.stop))[k]

    def count(self, at: np.ndarray) -> np.ndarray:
        """Bytes of stretches before each position."""
        if not len(self.start):
            return np.zeros(len(at), dtype=np.int64)
        k = np.searchsorted(self.start, at, side="right")
        last = np.maximum(k - 1, 0)
        return self.before[k] - np.where(k > 0, np.maximum(0, self.stop[last] - at), 0)


def cut_points(
    data: np.ndarray, rule: Passages, unspaced: Unspaced | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Positions before which ``data`` (UTF-8 bytes) is cut, and those at which words begin."""
    unspaced = unspaced or Unspaced(data, np.zeros(1, dtype=np.int64))
    cuts, starts = [], []
    for begin in range(0, len(data), SLAB_BYTES):
        low = max(0, begin - GEAR_BYTES)
        part = data[low : begin + SLAB_BYTES]
        h = _gear(part)[:-1]  # of what ends before each position from the second on
        before, after = part[:-1], part[1:]
        word = (before <= 32) & (after > 32)
        cut = word & (h < np.uint32(2**32 // rule.words))
        cut |= (h < np.uint32(2**32 // rule.bytes)) & ((after & 0xC0) != 0x80)
        # As many cuts for the bytes of a word as elsewhere for a word; only before whole characters.
        maybe = np.flatnonzero(h < np.uint32(2**32 // (rule.words * rule.word_bytes)) * _WIDTH[after])
        cut[maybe[unspaced.inside(maybe + low + 1)]] = True
        own = max(0, begin - low - 1)
        cuts.append(np.flatnonzero(cut[own:]) + own + low + 1)
        starts.append(np.flatnonzero(word[own:]) + own + low + 1)
    if not cuts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(cuts), np.concatenate(starts)


def _marked(size: int, *positions: np.ndarray) -> np.ndarray:
    """The distinct positions below ``size``, ascending, without sorting them."""
    mark = np.zeros(size, dtype=bool)
    for p in positions:
        mark[p] = True
    return np.flatnonzero(mark)


def _chunk_group(texts: list[bytes], rule: Passages, positions: bool = True):
    """Arrays (text, digest, no, start, stop, words) of the chunks of some texts, in characters.

    Without ``positions``, only the first two.
    """
    line = b"".join(texts)
    data = np.frombuffer(line, dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    unspaced = Unspaced(data, begins)
    cuts, words = cut_points(data, rule, unspaced)
    # The hash of the first bytes of a text would reach into the one before it.
    of = np.searchsorted(ends, cuts, side="right")
    cuts = cuts[cuts - begins[of] >= GEAR_BYTES]
    full = begins[sizes > 0]
    first = _marked(len(data), full, cuts)
    last = np.append(first[1:], len(data))
    text = np.searchsorted(ends, first, side="right")
    digest = np.array(
        [xxhash.xxh3_64_intdigest(line[a:b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)],
        dtype=np.uint64,
    ).view(np.int64)
    if not positions:
        return text, digest
    heads = np.searchsorted(first, full)
    sizes_in_chunks = np.diff(np.append(heads, len(first)))
    no = np.arange(len(first)) - np.repeat(heads, sizes_in_chunks)
    words = _marked(len(data), words, full)
    n_words = np.searchsorted(words, last) - np.searchsorted(words, first)
    # Counted from the beginning of the text, so that no rest is lost at a chunk's end.
    origin = unspaced.count(begins)[text]
    n_words += (unspaced.count(last) - origin) // rule.word_bytes
    n_words -= (unspaced.count(first) - origin) // rule.word_bytes
    inside = np.add.reduceat((data & 0xC0) != 0x80, first, dtype=np.int64)
    characters = np.concatenate(([0], np.cumsum(inside)))
    origin = np.repeat(characters[heads], sizes_in_chunks)
    return text, digest, no, characters[:-1] - origin, characters[1:] - origin, n_words


def chunks(
    docs: DataFrame, id_col: str, text_col: str, rule: Passages, positions: bool = True
) -> DataFrame:
    """``digest``, ``doc_id``, ``no``, ``start``, ``stop`` (characters), ``words`` of all chunks.

    Without ``positions``, only the first two columns.
    """
    source = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).where(
        "doc_id is not null and text <> ''"
    )
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            begin = 0
            while begin < len(texts):
                group, size, end = [], 0, begin
                while end < len(texts) and size < SLAB_BYTES:
                    group.append(texts[end].encode())
                    size += len(group[-1])
                    end += 1
                text, digest, *numbers = _chunk_group(group, rule, positions)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(digest),
                        batch.column(0).take(pa.array(text + begin)),
                        *(pa.array(a.astype(np.int32)) for a in numbers),
                    ],
                    ["digest", "doc_id", "no", "start", "stop", "words"][: 2 + len(numbers)],
                )
                begin = end

    return source.mapInArrow(run, (_CHUNKS if positions else _DIGESTS).format(id=kind))


def _shared(docs: DataFrame, id_col: str, text_col: str, rule: Passages) -> DataFrame:
    """Chunks inside passages, with the number of the passage and the first document of the chunk."""
    found = chunks(docs, id_col, text_col, rule)
    firsts = stored(
        chunks(docs, id_col, text_col, rule, positions=False)
        .groupBy("digest")
        .agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"))
        .where("first_doc_id <> last_doc_id")
        .drop("last_doc_id"),
        "shared-digests",
    )
    # Repeated rows leave where the chunks of a document meet, without a further shuffle.
    shared = found.join(firsts, "digest").drop("digest").repartition("doc_id").distinct()
    order = Window.partitionBy("doc_id").orderBy("no")
    begins = F.coalesce(F.col("no") - F.lag("no").over(order) != 1, F.lit(True)).cast("int")
    runs = shared.withColumn("begins", begins).withColumn(
        "passage", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    whole = Window.partitionBy("doc_id", "passage")
    beyond = F.greatest(F.lit(0), F.col("words") - rule.chance_words)
    return (
        runs.withColumn("total", F.sum("words").over(whole))
        .withColumn("beyond", F.sum(beyond).over(whole))
        .where((F.col("total") >= rule.least_words) & (F.col("beyond") >= rule.least_beyond))
        .select("doc_id", "passage", "no", "start", "stop", "words", "first_doc_id")
    )


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Passages = Passages()
) -> DataFrame:
    """Passages of documents that other documents have, too.

    One row per passage: ``doc_id``, ``start``, ``stop`` (characters, end exclusive),
    ``n_words``, ``removed_words`` (of chunks that a document with a smaller id
    keeps), ``first_doc_ids`` (smallest ids of documents with its chunks, ascending).
    Words are separated by ASCII white space; after ``UNSPACED_BYTES`` bytes without
    any, each ``rule.word_bytes`` further bytes count as a word.
    Documents are told apart by id: repeated rows count once, rows with a null id
    take no part. Null and empty texts have no passage; what a text repeats within
    itself doesn't count. An empty table gives an empty result. Other columns are
    ignored.
    """
    removed = F.col("first_doc_id") != F.col("doc_id")
    return (
        _shared(docs, id_col, text_col, rule)
        .groupBy("doc_id", "passage")
        .agg(
            F.min("start").alias("start"),
            F.max("stop").alias("stop"),
            F.sum("words").alias("n_words"),
            F.sum(F.when(removed, F.col("words")).otherwise(0)).alias("removed_words"),
            F.sort_array(F.collect_set("first_doc_id")).alias("first_doc_ids"),
        )
        .drop("passage")
    )


def drop_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Passages = Passages()
) -> DataFrame:
    """``docs`` without the chunks of repeated passages that a document with a smaller id keeps.

    All rows and columns stay; a text may become empty.
    """
    spans = (
        _shared(docs, id_col, text_col, rule)
        .where("first_doc_id <> doc_id")
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    )
    id_name, spans_name = fresh(docs.columns, "id", "spans")
    marked = docs.join(
        stored(spans, "repeat-spans").toDF(id_name, spans_name), col(id_col) == F.col(id_name), "left"
    ).drop(id_name)
    names = docs.columns
    text_at = [c.lower() for c in names].index(text_col.lower())

    def run(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(text_at).to_pylist(), batch.column(-1).to_pylist(), strict=True):
                if spans:
                    edges = [0, *(e for s in spans for e in (s["start"], s["stop"])), len(text)]
                    text = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                texts.append(text)
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            arrays[text_at] = pa.array(texts, batch.schema.field(text_at).type)
            yield pa.RecordBatch.from_arrays(arrays, names)

    return marked.select(*map(col, names), spans_name).mapInArrow(run, docs.schema)
