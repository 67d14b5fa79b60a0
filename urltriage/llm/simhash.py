"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is cut into segments of two bits; the numbers of bits set in
the 32 segments are its embedding. The Manhattan distance of two embeddings is never
above the Hamming distance of the fingerprints. Of two fingerprints within four
bits, the embeddings are within two in the first or in the second 16 segments, so
they meet in a cell of that half's grid if each enters its own cell and those one
step away. In a cell, the whole Manhattan distance and then the exact Hamming
distance are checked.

Equal fingerprints are one class first. A cell returns a spanning forest of its
links, never all pairs of a dense group; a cell with very many members is dealt out
as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urltriage.llm.common import col, fresh, stored
from urltriage.llm.components import components

SEED = 42
#: Bytes of a text that are hashed at a time.
SLAB = 1 << 20
#: Members of a cell that one task compares at a time.
CELL_BLOCK = 16_384
#: Cells up to this size are compared with array shifts, larger ones member by member.
SMALL_CELL = 64

_LOW_BITS = np.uint64(0x5555555555555555)
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1).astype(np.int64)


def _slabs(data: bytes) -> Iterator[list[bytes]]:
    """Words of ``data``, a bounded number at a time; no word is cut."""
    begin = 0
    while begin < len(data):
        end = begin + SLAB
        while end < len(data) and data[end] not in b"\x20\x09\x0a\x0b\x0c\x0d":
            end += 1
        yield data[begin:end].split()
        begin = end


def _add_bits(shingles: list[int], counts: np.ndarray) -> None:
    octets = np.array(shingles, dtype=">u8").view(np.uint8).reshape(-1, 8)
    for i in range(8):
        counts[8 * i : 8 * i + 8] += np.bincount(octets[:, i], minlength=256) @ _BYTE_BITS


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash; see ``fingerprints``."""
    counts, total, tail = np.zeros(64, dtype=np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    # bytes.lower() and bytes.split() know ASCII only, which is what is wanted.
    for words in _slabs((text or "").encode().lower()):
        words = tail + words
        if len(words) >= width:
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = np.concatenate(([0], ends[:-1]))
            line = b" ".join(words)
            hashes = [
                digest(line[a:b], SEED)
                for a, b in zip(
                    starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True
                )
            ]
            _add_bits(hashes, counts)
            total += len(hashes)
        tail = words[1 - width :] if width > 1 else []
    if not total:
        if not tail:
            return 0
        _add_bits([digest(b" ".join(tail), SEED)], counts)
        total = 1
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, digest: bool = False
) -> DataFrame:
    """``doc_id``, ``fp`` (64 bits as a signed long) of every row and whole text.

    ``digest`` adds the SHA-256 of the text; a null text has that of the empty one.

    A-Z become lower case; words are separated by ASCII white space; shingles are
    ``width`` words joined by a space, repeats included; a text with fewer words is
    one shingle; one without words (or null) has fingerprint zero.
    """
    source = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    more = ["digest"] if digest else []
    if digest:
        source = source.withColumn("digest", _digest(F.col("text")))
    fields = source.select("doc_id", F.lit(0).cast("long").alias("fp"), *more).schema

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t, width) for t in batch.column(1).to_pylist()]
            fps = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), fps, *batch.columns[2:]], names=["doc_id", "fp", *more]
            )

    return source.mapInArrow(run, fields)


def embed(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, two bits each, packed like the fingerprint."""
    return (fps & _LOW_BITS) + ((fps >> np.uint64(1)) & _LOW_BITS)


def manhattan(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed embeddings."""
    total = np.zeros(np.broadcast(left, right).shape, dtype=np.int16)
    for shift in range(0, 64, 2):
        a = ((left >> np.uint64(shift)) & np.uint64(3)).astype(np.int16)
        b = ((right >> np.uint64(shift)) & np.uint64(3)).astype(np.int16)
        total += np.abs(a - b)
    return total


def _cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid cells (half << 32 | embedding) each fingerprint enters, and the fingerprints."""
    packed, cells, members = embed(fps), [], []
    for half in range(2):
        own = (packed >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        base = own | np.uint64(half << 32)
        cells.append(base)
        members.append(fps)
        for shift in range(0, 32, 2):
            step = np.uint64(1 << shift)
            count = (own >> np.uint64(shift)) & np.uint64(3)
            for fits, near in ((count < 2, base + step), (count > 0, base - step)):
                cells.append(near[fits])
                members.append(fps[fits])
    return np.concatenate(cells), np.concatenate(members)


def grid(classes: DataFrame) -> DataFrame:
    """``cell``, ``fp`` for every cell that the distinct fingerprints ``fp`` enter."""

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            cells, members = _cells(fps)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells.view(np.int64)), pa.array(members.view(np.int64))], names=["cell", "fp"]
            )

    return classes.select("fp").mapInArrow(run, "cell long, fp long")


def _linked(left: np.ndarray, right: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs link: the lower bound first, the exact distance for what it leaves."""
    a, b = embed(left), embed(right)
    # The count of differing count bits is at most the Manhattan distance, and much cheaper.
    maybe = np.flatnonzero(np.bitwise_count(a ^ b) <= 2 * max_bits)
    maybe = maybe[manhattan(a[maybe], b[maybe]) <= max_bits]
    exact = np.bitwise_count(left[maybe] ^ right[maybe]) <= max_bits
    out = np.zeros(len(left), dtype=bool)
    out[maybe[exact]] = True
    return out


def _forest(members: np.ndarray, max_bits: int, edges: list) -> None:
    """Adds a spanning forest of the links between ``members``."""
    left = members
    while left.size > 1:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            seed = queue.pop()
            near = np.bitwise_count(left ^ seed) <= max_bits
            if near.any():
                hit = left[near]
                edges.append((np.full(hit.size, seed, dtype=np.uint64), hit))
                queue.extend(hit)
                left = left[~near]


def _cell_edges(cells: np.ndarray, fps: np.ndarray, max_bits: int) -> list:
    """Links within cells; ``cells`` is sorted."""
    edges: list = []
    starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(cells)])))
    which = np.repeat(np.arange(len(starts)), sizes)
    dense = sizes > SMALL_CELL
    shifted = np.flatnonzero(~dense[which])
    lag, found = 1, []
    active = shifted[sizes[which[shifted]] > 1]
    while active.size:
        inside = active[active + lag < len(cells)]
        active = inside[which[inside] == which[inside + lag]]
        hits = active[_linked(fps[active], fps[active + lag], max_bits)]
        found.append(np.stack((hits, hits + lag)))
        lag += 1
    if found:
        at, to = np.concatenate(found, axis=1)
        links = np.bincount(which[at], minlength=len(starts))
        dense |= links >= sizes  # more links than a forest needs
        sparse = ~dense[which[at]]
        edges.append((fps[at[sparse]], fps[to[sparse]]))
    for k in np.flatnonzero(dense):
        _forest(fps[starts[k] : starts[k] + sizes[k]], max_bits, edges)
    return edges


def _spread(entries: DataFrame, cell_block: int) -> DataFrame:
    """Deals a cell with more than ``cell_block`` members out as pairs of blocks."""
    hot = stored(
        entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_block), "hot-cells"
    )
    if hot.isEmpty():
        return entries.withColumn("part", F.lit(0).cast("long"))
    blocks = F.ceil(F.coalesce("n", F.lit(1)) / cell_block).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks").cast("long"))
    return (
        entries.join(hot, "cell", "left")
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
        .select(
            "cell",
            "fp",
            (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("part"),
        )
    )


def links(classes: DataFrame, max_bits: int = 4, cell_block: int = CELL_BLOCK) -> DataFrame:
    """Edges ``a``, ``b`` between distinct fingerprints ``fp`` that connect all links."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the grid finds links of at most four bits")
    entries = _spread(grid(classes), cell_block)
    dealt = entries.repartition("cell", "part").sortWithinPartitions("cell", "part", "fp")

    def run(batches):
        cells = parts = fps = np.zeros(0, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            c, f, p = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("cell", "fp", "part"))
            cells, parts, fps = np.concatenate((cells, c)), np.concatenate((parts, p)), np.concatenate((fps, f))
            # The last cell may go on in the next batch.
            last = (cells == cells[-1]) & (parts == parts[-1])
            done = len(cells) - int(last.sum())
            yield from emit(cells[:done], parts[:done], fps[:done])
            cells, parts, fps = cells[done:], parts[done:], fps[done:]
        yield from emit(cells, parts, fps)

    def emit(cells, parts, fps):
        if not len(cells):
            return
        key = np.cumsum(np.concatenate(([0], (np.diff(cells) != 0) | (np.diff(parts) != 0))))
        for a, b in _cell_edges(key, fps.view(np.uint64), max_bits):
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
            )

    return dealt.mapInArrow(run, "a long, b long")


def _reached(fps: DataFrame, first: Column, max_bits: int, cell_block: int) -> DataFrame:
    """``fp``, ``first``: for each distinct fingerprint the smallest ``first`` of its component."""
    classes = stored(fps.groupBy("fp").agg(F.min(first).alias("first")), "fingerprint-classes")
    edges = stored(links(classes, max_bits, cell_block).distinct(), "fingerprint-links")
    roots = stored(components(edges), "fingerprint-roots")
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    linked = rooted.join(least, "root").select("fp", "least", F.lit(True).alias("linked"))
    return stored(
        classes.join(linked, "fp", "left").select(
            "fp", F.when(F.col("linked"), F.col("least")).otherwise(F.col("first")).alias("first")
        ),
        "fingerprint-components",
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_bits: int = 4,
    width: int = 4,
    cell_block: int = CELL_BLOCK,
) -> DataFrame:
    """Components of documents whose fingerprints differ in at most ``max_bits`` bits.

    One row per document: ``doc_id``, ``fingerprint`` (16 hex digits),
    ``component_id`` (smallest id that can be reached, itself included). Null and
    empty texts have fingerprint zero and link like any other. Null ids don't count
    for the smallest one; a component of null ids has a null ``component_id``.
    Repeated rows stay. An empty table gives an empty result.
    """
    fps = stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    reached = _reached(fps, F.col("doc_id"), max_bits, cell_block)
    return fps.join(reached, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id")
    )


def drop_near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_bits: int = 4,
    width: int = 4,
    cell_block: int = CELL_BLOCK,
) -> DataFrame:
    """``docs`` with exactly one row of each component: the one with the smallest id.

    A null id comes after all others; of several texts with that id the one with the
    smallest digest stays, and of rows that share both, any one.
    """
    fps = stored(fingerprints(docs, id_col, text_col, width, digest=True), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "digest")
    reached = _reached(fps, first, max_bits, cell_block)
    # Equal texts have equal fingerprints, so an id and a digest belong to one component only.
    kept = stored(reached.select("first.doc_id", "first.digest").distinct(), "kept-rows")
    digest, kept_id, kept_digest = fresh(docs.columns, "digest", "kept_id", "kept_digest")
    out = docs.withColumn(digest, _digest(col(text_col))).join(
        kept.toDF(kept_id, kept_digest),
        col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(digest) == F.col(kept_digest)),
        "left_semi",
    )
    # Rows that share both id and text all pass the join above.
    if not fps.groupBy("doc_id", "digest").count().where("count > 1").isEmpty():
        out = out.dropDuplicates([c for c in out.columns if c.lower() in (id_col.lower(), digest.lower())])
    return out.drop(digest)
