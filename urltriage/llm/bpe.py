"""Exact byte-level BPE encoding and decoding of texts of any length.

Most texts are encoded where they are read. A longer text is cut into leaves that
are encoded in parallel. A cut between words is exact as it is. An unsplit piece
longer than a leaf (no pattern of the vocabulary cuts it) is halved until the parts
are short enough; the encodings of the halves are joined up the tree. At a join, a
window of tokens on both sides is encoded anew. If its first token is the old first
one and its last token the old last one, the joined sequence is the encoding of the
whole piece, because a sequence of tokens is an encoding exactly if each adjacent
pair is; else the window is doubled.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urltriage.llm.common import col, stored
from urltriage.llm.tokens import SYMBOLS, ByteBpe, Encoder, encoder

#: Characters of a leaf. Longer texts are cut.
LEAF_CHARS = 32_768
#: Tokens on each side of a join that are encoded anew at first.
WINDOW = 8

#: Kinds of leaves: whole words; a part of an unsplit piece; the last part of one.
WORDS, PART, LAST_PART = 0, 1, 2


def _halves(symbols: str, leaf: int) -> list[str]:
    if len(symbols) <= leaf:
        return [symbols]
    middle = len(symbols) // 2
    return _halves(symbols[:middle], leaf) + _halves(symbols[middle:], leaf)


def _unsplit(text: str, words: Encoder, leaf: int) -> list[tuple[int, str]]:
    """Leaves of a text without a safe place to cut, from the vocabulary's own pieces."""
    out: list[tuple[int, str]] = []
    added = re.compile("(" + "|".join(map(re.escape, sorted(words.added, key=len, reverse=True))) + ")")

    def close(section: str, pieces: list) -> None:
        # How white space is cut depends on what follows, so none may end a leaf of words.
        tail = []
        while pieces and section[pieces[-1][1] : pieces[-1][2]].isspace():
            tail.append((LAST_PART, pieces.pop()[0]))
        if pieces:
            out.append((WORDS, section[pieces[0][1] : pieces[-1][2]]))
        out.extend(reversed(tail))
        pieces.clear()

    for k, section in enumerate(added.split(text) if words.added else [text]):
        if k % 2:
            out.append((WORDS, section))
            continue
        pieces: list = []
        for symbols, (start, stop) in words.library.pre_tokenizer.pre_tokenize_str(section):
            if len(symbols) > leaf:
                close(section, pieces)
                parts = _halves(symbols, leaf)
                out.extend((PART, p) for p in parts[:-1])
                out.append((LAST_PART, parts[-1]))
                continue
            if pieces and stop - pieces[0][1] > leaf:
                close(section, pieces)
            pieces.append((symbols, start, stop))
        close(section, pieces)
    return out


def leaves(text: str, words: Encoder, leaf: int = LEAF_CHARS) -> list[tuple[int, str]]:
    """Cuts a text into leaves (kind, text or byte symbols) of at most about ``leaf``.

    Words are cut before a space or line feed that follows anything but white space:
    no pattern of the vocabulary reaches over such a place.
    """
    out: list[tuple[int, str]] = []
    safe = re.compile(r"(?<=\S)(?=[ \n])")
    begin = 0
    while len(text) - begin > leaf:
        end = 0
        for m in safe.finditer(text, begin + leaf // 2, begin + leaf + 1):
            end = m.start()
        if not end:
            # No such place in reach: the unsplit stretch ends at the next one.
            m = safe.search(text, begin + leaf)
            end = m.start() if m else len(text)
            out.extend(_unsplit(text[begin:end], words, leaf))
        else:
            out.append((WORDS, text[begin:end]))
        begin = end
    if begin < len(text):
        out.append((WORDS, text[begin:]))
    return out


def join(left: list[int], right: list[int], words: ByteBpe, window: int = WINDOW) -> list[int]:
    """The encoding of an unsplit piece from the encodings of its halves."""
    while True:
        a, b = left[-window:], right[:window]
        data = b"".join(map(words.token_bytes.__getitem__, a + b))
        new = words.model_ids("".join(map(SYMBOLS.__getitem__, data)))
        begins = len(left) <= window or new[0] == a[0]
        ends = len(right) <= window or new[-1] == b[-1]
        if begins and ends:
            return left[: -len(a)] + new + right[len(b) :]
        window *= 2


def join_tree(parts: list[list[int]], words: ByteBpe, window: int = WINDOW) -> list[int]:
    while len(parts) > 1:
        pairs = zip(parts[::2], parts[1::2], strict=False)
        joined = [join(a, b, words, window) for a, b in pairs]
        parts = joined + parts[len(joined) * 2 :]
    return parts[0]


def _leaf_ids(kind: int, text: str, words: ByteBpe) -> bytes:
    if kind == WORDS:
        return words.encode(text)
    return np.array(words.model_ids(text), dtype="<u4").tobytes()


def fold(kinds: list[int], encoded: list[bytes], words: ByteBpe, window: int = WINDOW) -> bytes:
    """Ids of a text from those of its leaves in order."""
    out, parts = [], []
    for kind, ids in zip(kinds, encoded, strict=True):
        if kind == WORDS:
            out.append(ids)
            continue
        parts.append(np.frombuffer(ids, "<u4").tolist())
        if kind == LAST_PART:
            out.append(np.array(join_tree(parts, words, window), dtype="<u4").tobytes())
            parts = []
    return b"".join(out)


def _digests(ids: bytes, words: ByteBpe, decimals: list[str]) -> tuple[int, str, str]:
    numbers = np.frombuffer(ids, "<u4").tolist()
    written = ",".join(map(decimals.__getitem__, numbers))
    decoded = words.decode(numbers)
    return (
        len(numbers),
        hashlib.sha256(written.encode()).hexdigest(),
        hashlib.sha256(decoded.encode()).hexdigest(),
    )


def _coded(tokenizer: str):
    words = encoder(ByteBpe, tokenizer)
    return words, [str(i) for i in range(len(words.token_bytes))]


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"
_DIGEST_NAMES = ["n_tokens", "ids_sha256", "decoded_sha256"]


def _digest_arrays(rows: list[tuple[int, str, str]]) -> list[pa.Array]:
    n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
    return [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]


def encode_digests(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    leaf_chars: int = LEAF_CHARS,
    window: int = WINDOW,
) -> DataFrame:
    """Encodes and decodes every whole text.

    ``tokenizer``: file of a byte-level vocabulary. Columns: ``doc_id``, ``n_tokens``,
    ``ids_sha256`` (decimal ids joined by commas), ``decoded_sha256`` (the decoded
    text). Null counts as empty; an empty text has no token. Repeated rows and null
    ids stay. An empty table gives an empty result. Other columns are ignored.
    """
    source = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def short(batches):
        words, decimals = _coded(tokenizer)
        for batch in batches:
            rows = [_digests(words.encode(t), words, decimals) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_digest_arrays(rows)], ["doc_id", *_DIGEST_NAMES])

    direct = source.where(F.length("text") <= leaf_chars).mapInArrow(short, f"doc_id {kind}, {DIGESTS}")
    long = source.where(F.length("text") > leaf_chars).withColumn("text_sha256", F.sha2("text", 256))
    return direct.unionByName(_long_digests(long, tokenizer, leaf_chars, window))


def _long_digests(long: DataFrame, tokenizer: str, leaf_chars: int, window: int) -> DataFrame:
    """Digests of texts above a leaf, each distinct text once."""

    def cut(batches):
        words = encoder(ByteBpe, tokenizer)
        for batch in batches:
            for sha, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = leaves(text, words, leaf_chars)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([sha] * len(parts)),
                        pa.array(range(len(parts)), pa.int32()),
                        pa.array([k for k, _ in parts], pa.int32()),
                        pa.array([t for _, t in parts], pa.string()),
                    ],
                    ["text_sha256", "no", "kind", "leaf"],
                )

    def encode(batches):
        words = encoder(ByteBpe, tokenizer)
        for batch in batches:
            kinds, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ids = [_leaf_ids(k, t, words) for k, t in zip(kinds, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(ids, pa.binary())],
                ["text_sha256", "no", "kind", "ids"],
            )

    def folded(key, pdf):
        words, decimals = _coded(tokenizer)
        ordered = pdf.sort_values("no")
        ids = fold(ordered["kind"].tolist(), ordered["ids"].tolist(), words, window)
        n, ids_sha, decoded_sha = _digests(ids, words, decimals)
        return pdf.head(1)[["text_sha256"]].assign(n_tokens=n, ids_sha256=ids_sha, decoded_sha256=decoded_sha)

    parts = long.select("text_sha256", "text").mapInArrow(cut, "text_sha256 string, no int, kind int, leaf string")
    # Repeated texts leave here, and the leaves of a text spread over the tasks.
    encoded = parts.distinct().mapInArrow(encode, "text_sha256 string, no int, kind int, ids binary")
    whole = stored(
        encoded.groupBy("text_sha256").applyInPandas(folded, f"text_sha256 string, {DIGESTS}"), "long-texts"
    )
    return long.select("doc_id", "text_sha256").join(whole, "text_sha256").select("doc_id", *_DIGEST_NAMES)
