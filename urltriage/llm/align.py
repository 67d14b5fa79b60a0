"""Alignment of the tokens of two tokenizers over the same bytes.

Both tokenizers encode a whole text first: A, a byte-level BPE of the tokenizers
library, encodes a space and the text; B, a SentencePiece BPE, encodes the text
and adds that space itself. Each token has bytes: A's vocabulary entry decoded
byte by byte, B's piece in UTF-8 with U+2581 as a space and ``<0xHH>`` as the byte.

Anchors: byte offsets where an A token and a B token both end and the next ones
begin with white space. They cut a document into windows. Between a sign that is no
white space and a space (or a line feed, if no piece holds one) neither tokenizer
joins tokens, so the ids of a text are those of its windows one after another. In
plain Latin texts neither does between letters, digits and marks (checked on the
pieces), and windows are cut there, too. Each distinct window is encoded and aligned once per task and remembered. The bytes of a
window's tokens are compared with the window. A text in which one differs, or with
U+2581, is encoded whole by the libraries, compared, and cut where the tokens meet.
Within a window:

* groups: the window is cut again wherever an A and a B token end together;
* links: every A and B token in it whose byte ranges overlap.

Links are counted across the corpus by Spark: an id pair counts the documents in
which it is linked; the best count of an A id is the highest over its pairs.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urltriage.llm.common import col, fresh, stored
from urltriage.llm.piece import SPACE
from urltriage.llm.piece import model as piece_model
from urltriage.llm.tokens import _LATIN, _PLAIN, SYMBOLS, ByteBpe, as_symbols

#: Windows remembered per task, at least; twice as many at most.
REMEMBERED = 150_000
#: Longer windows are not remembered.
LONGEST_REMEMBERED = 64
#: Rows of a pair table that is sent to all tasks; a larger one is joined by shuffle.
BROADCAST_PAIRS = 500_000
_LOW = (1 << 32) - 1
_NO_LINKS = np.zeros(0, dtype=np.int64)
_BETWEEN_WORDS = re.compile(r"(?<=\S)(?= \S)")
# What begins with an apostrophe can be a contraction, and stays whole.
_RUNS = re.compile(f"[ \n]*(?:[{_LATIN}]+|[0-9]+|'[^ \n]*|[^ \n{_LATIN}0-9]+)|[ \n]+")
_LETTER = re.compile(f"[{_LATIN}]")


def _kind(sign: str) -> str:
    """Letter, number, mark or something else, as the runs of plain texts have it."""
    if _LETTER.match(sign):
        return "L"
    return "N" if sign in "0123456789" else "M" if "!" <= sign <= "~" else "-"


def _ascii_symbols(part: str) -> str:
    return part.replace(" ", SYMBOLS[32]).replace("\n", SYMBOLS[10])


class Aligner:
    """Tokens of both tokenizers for a text, and the alignment of their windows."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        self.a = ByteBpe(byte_bpe)
        self.a.library.encode_special_tokens = True
        self.a_bytes = self.a.token_bytes
        self.b = piece_model(piece_bpe)
        self.b_bytes = self.b.bytes_of
        self.piece_path = piece_bpe
        added = self.a.library.get_added_tokens_decoder().values()
        # Tokens that are not special are found in texts all the same.
        self.plain = self.b.dummy_prefix and all(t.special for t in added)
        self.lines = not any("\n" in p for p in self.b.score)
        beside = {_kind(p[k]) + _kind(p[k + 1]) for p in self.b.score for k in range(len(p) - 1)}
        self.runs = beside.isdisjoint(("LN", "NL", "LM", "ML", "NM", "MN"))
        self.a_size, self.b_size = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self.decimal = [str(i) for i in range(max(len(self.a_size), len(self.b_size)))]
        self.windows: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    @functools.cached_property
    def b_library(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=self.piece_path)

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """A's and B's ids, or none if the text is null, empty or either side's bytes differ."""
        if not text:
            return [], []
        expected = (" " + text).encode("utf-8", "surrogatepass")
        a = self.a.library.encode(" " + text, add_special_tokens=False).ids
        b = self.b_library.encode(text)
        if b"".join(self.a_bytes[i] for i in a) != expected:
            return [], []
        if b"".join(self.b_bytes[i] for i in b) != expected:
            return [], []
        return a, b

    def cut(self, a: list[int], b: list[int]) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
        """Windows of ids between anchors, in order."""
        windows = []
        i = j = 0  # next A and B token
        ea = eb = 0  # bytes before them
        start_a = start_b = 0
        while i < len(a) and j < len(b):
            if ea == eb and i > start_a and self.a_bytes[a[i]][:1] == b" " and self.b_bytes[b[j]][:1] == b" ":
                windows.append((tuple(a[start_a:i]), tuple(b[start_b:j])))
                start_a, start_b = i, j
            if ea <= eb:
                ea += len(self.a_bytes[a[i]])
                i += 1
            else:
                eb += len(self.b_bytes[b[j]])
                j += 1
        windows.append((tuple(a[start_a:]), tuple(b[start_b:])))
        return windows

    def _align(self, a: Sequence[int], b: Sequence[int]) -> tuple[int, str, bytes]:
        """Token counts (A's above B's 32 bits), groups and links of tokens over the same bytes.

        Groups as ``a1,a2|b1;a3|b2,b3``; a link is A's id above B's 32 bits.
        """
        a_size, b_size, decimal = self.a_size, self.b_size, self.decimal
        groups, links = [], []
        x, y = a[0], b[0]
        i = j = 1
        ea, eb = a_size[x], b_size[y]
        group_a, group_b = decimal[x], decimal[y]
        while True:
            # Tokens x and y overlap; the one that ends first makes room for the next.
            links.append(x << 32 | y)
            if ea == eb:
                groups.append(f"{group_a}|{group_b}")
                if i == len(a):
                    break
                x, y = a[i], b[j]
                i, j = i + 1, j + 1
                ea, eb = ea + a_size[x], eb + b_size[y]
                group_a, group_b = decimal[x], decimal[y]
            elif ea < eb:
                x = a[i]
                i += 1
                ea += a_size[x]
                group_a = f"{group_a},{decimal[x]}"
            else:
                y = b[j]
                j += 1
                eb += b_size[y]
                group_b = f"{group_b},{decimal[y]}"
        return len(a) << 32 | len(b), ";".join(groups), struct.pack(f"<{len(links)}q", *links)

    def _window(self, window: str) -> tuple[int, str, bytes] | None:
        """The alignment of a window of a text with its space; none if its bytes differ."""
        if _PLAIN.fullmatch(window):
            parts = self.a.parts.findall(window)
            a = [i for p in parts for i in self.a.model_ids(_ascii_symbols(p) if p.isascii() else as_symbols(p))]
        else:
            a = self.a.library.encode(window, add_special_tokens=False).ids
        b = [i for p in self.b.split(window.replace(" ", SPACE)) for i in self.b._part(p)]
        expected = window.encode("utf-8", "surrogatepass")
        if b"".join([self.a_bytes[i] for i in a]) != expected:
            return None
        if b"".join([self.b_bytes[i] for i in b]) != expected:
            return None
        return self._align(a, b)

    def window(self, window: str) -> tuple[int, str, bytes] | None:
        found = self.older[window] if window in self.older else self._window(window)
        if len(window) <= LONGEST_REMEMBERED:
            self.windows[window] = found
        return found

    def trim(self) -> None:
        """Bounds what is remembered, between texts."""
        if len(self.windows) > REMEMBERED:
            self.older, self.windows = self.windows, {}
            self.b.compatible.trim()

    def split(self, text: str) -> list[str]:
        """Windows of a text with its space."""
        if not self.lines or self.a.unusual.search(text):
            return _BETWEEN_WORDS.split(text)
        if self.runs and _PLAIN.fullmatch(text):
            return _RUNS.findall(text)
        return self.a.split(text)

    def measure(self, text: str | None) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, groups_sha256, the distinct links of one text and their numbers."""
        if not text:
            return 0, 0, 0, "", _NO_LINKS, _NO_LINKS
        found = None
        if self.plain and SPACE not in text:
            known = self.windows
            found = [known[w] if w in known else self.window(w) for w in self.split(" " + text)]
            self.trim()
        if found is None or None in found:
            a, b = self.tokens(text)
            if not a:
                return 0, 0, 0, "", _NO_LINKS, _NO_LINKS
            found = [self._align(*window) for window in self.cut(a, b)]
        n = sum([f[0] for f in found])
        groups = ";".join([f[1] for f in found])
        links = np.frombuffer(b"".join([f[2] for f in found]), dtype="<i8")
        pairs, times = np.unique(links, return_counts=True)
        return n >> 32, n & _LOW, groups.count("|"), hashlib.sha256(groups.encode()).hexdigest(), pairs, times

    def document(self, text: str | None) -> tuple[int, int, int, str, Counter]:
        """n_a, n_b, n_groups, groups_sha256 and the links of one text."""
        *counts, pairs, times = self.measure(text)
        links = {(p >> 32, p & _LOW): m for p, m in zip(pairs.tolist(), times.tolist(), strict=True)}
        return *counts, Counter(links)


@functools.cache
def aligner(byte_bpe: str, piece_bpe: str) -> Aligner:
    return Aligner(byte_bpe, piece_bpe)


DOCUMENT = "n_a long, n_b long, n_groups long, groups_sha256 string, links array<struct<pair:long,m:long>>"
#: Links that are handed to Spark together.
BATCH_LINKS = 1 << 20


def align_documents(
    docs: DataFrame, byte_bpe: str, piece_bpe: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Alignment of every whole text with link counts over the corpus.

    Columns: ``doc_id``, ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links`` (A-B token
    occurrences that overlap), ``n_best`` (links whose pair count is the highest of
    their A id, ties included), ``count_sum`` (pair counts summed over links), all
    long, and ``groups_sha256`` (SHA-256 of ``a1,a2|b1;a3|b2,b3``). A null, empty or
    not byte-exact text has zeros and '' as digest. Each row is a document, repeated
    rows and null ids too; a pair's count is the number of rows linking it. An empty
    table gives an empty result. Other columns, whatever their names, are ignored.
    """
    rid, = fresh([], "rid")
    source = docs.select(
        col(id_col).alias("doc_id"), col(text_col).alias("text"), F.monotonically_increasing_id().alias(rid)
    )
    kind = source.schema["doc_id"].dataType.simpleString()

    def aligned(batches):
        tool = aligner(byte_bpe, piece_bpe)

        def out(ids, rids, rows):
            n_a, n_b, n_g, sha, pairs, times = zip(*rows, strict=True)
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in pairs])))
            links = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(pairs), pa.int64()), pa.array(np.concatenate(times), pa.int64())],
                ["pair", "m"],
            )
            return pa.RecordBatch.from_arrays(
                [
                    ids,
                    rids,
                    pa.array(n_a, pa.int64()),
                    pa.array(n_b, pa.int64()),
                    pa.array(n_g, pa.int64()),
                    pa.array(sha, pa.string()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), links),
                ],
                ["doc_id", rid, "n_a", "n_b", "n_groups", "groups_sha256", "links"],
            )

        for batch in batches:
            rows, size, begin = [], 0, 0
            for text in batch.column(1):
                rows.append(tool.measure(text.as_py()))
                size += len(rows[-1][4])
                if size >= BATCH_LINKS:
                    yield out(batch.column(0).slice(begin, len(rows)), batch.column(2).slice(begin, len(rows)), rows)
                    rows, size, begin = [], 0, begin + len(rows)
            if rows:
                yield out(batch.column(0).slice(begin), batch.column(2).slice(begin), rows)

    # Written once: row numbers and tokens stay fixed when a task runs again.
    per_doc = stored(source.mapInArrow(aligned, f"doc_id {kind}, {rid} long, {DOCUMENT}"), "aligned")
    # A pair once per document that links it; partial counts before the shuffle.
    counts = per_doc.select(F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("pair_count"))
    first = F.shiftright("pair", 32)
    best = counts.groupBy(first.alias("a")).agg(F.max("pair_count").alias("best_count"))
    pairs = stored(
        counts.withColumn("a", first)
        .join(best, "a")
        .select("pair", "pair_count", (F.col("pair_count") == F.col("best_count")).alias("is_best")),
        "pair-counts",
    )
    if pairs.count() <= BROADCAST_PAIRS:
        pairs = F.broadcast(pairs)
    scored = (
        per_doc.select(rid, F.explode("links").alias("l"))
        .select(rid, "l.pair", "l.m")
        .join(pairs, "pair")
        .groupBy(rid)
        .agg(
            F.sum("m").alias("n_links"),
            F.sum(F.when(F.col("is_best"), F.col("m")).otherwise(0)).alias("n_best"),
            F.sum(F.col("m") * F.col("pair_count")).alias("count_sum"),
        )
    )
    out = per_doc.drop("links").join(scored, rid, "left")
    return out.select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")),
        "groups_sha256",
    )
