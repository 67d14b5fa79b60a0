"""Exact SentencePiece BPE encoding by backtracking over longest matches.

A text is escaped as the model's normalizer does (a space before it, every space
as U+2581) and cut before every run of U+2581: no piece holds that sign after
another sign, so no merge crosses such a cut. It is also cut between characters of
two classes (letters, marks and so on, as the pieces have it): none stand side by
side in a piece. Each cut part is encoded once per task and remembered.

Within a part, characters without a piece of their own stand alone and become
their UTF-8 bytes. Every other stretch is encoded by backtracking:

* An Aho-Corasick automaton over all pieces that encode to themselves gives the
  longest piece starting at a position, and those that follow it one after another:
  what the steps below take if no pair is rejected. Positions are looked up when
  they are reached.
* The longest piece at the current position is taken if the piece before it is
  compatible with it: merging the characters of both anew by the model's rule
  (highest score first, leftmost on ties) gives exactly these two pieces. A
  sequence is the encoding exactly if all adjacent pairs are compatible.
* Else the longest piece that is a proper prefix of it is tried. If none is
  left, the position is marked failed in a bitfield, the piece before is taken
  back and its own shorter prefixes are tried. An end position marked failed
  is never taken again.

Pair checks are remembered by the two pieces. A check replays how each piece merges
alone, and looks whether a merge across the border would come first.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import re
from collections.abc import Iterable

import ahocorasick
from sentencepiece import sentencepiece_model_pb2 as model_pb2

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"
#: Cut parts remembered per task, at least; twice as many at most.
REMEMBERED = 200_000
#: Longer parts are not remembered.
LONGEST_REMEMBERED = 64
#: Pair checks remembered per task at most.
PAIRS = 1 << 18


def _parts_pattern(pieces: Iterable[str]) -> str:
    """Pattern of parts that nothing merges across: a run of spaces and characters of one class.

    Characters that stand side by side in a piece are of one class.
    """
    of: dict[str, set[str]] = {}
    for p in pieces:
        signs = set(p) - {SPACE}
        classes = {id(c): c for c in (of.get(ch) for ch in signs) if c}
        joined = max(classes.values(), key=len, default=set())
        joined.update(signs, *classes.values())
        of.update(dict.fromkeys(signs.union(*classes.values()), joined))
    classes = {id(c): "".join(sorted(c)) for c in of.values() if len(c) > 1}
    runs = "|".join(f"[{re.escape(c)}]+" for c in sorted(classes.values(), key=len, reverse=True))
    return f"{SPACE}*(?:{runs or '(?!)'}|[^{SPACE}])|{SPACE}+"


class _Parts(dict):
    """What was made of the last parts."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, part: str):
        found = self.older.get(part)
        if found is None:
            found = self.make(part)
        if len(part) <= LONGEST_REMEMBERED:
            self[part] = found
        return found

    def trim(self) -> bool:
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()
            return True
        return False


class _Follow(dict):
    """Whether pieces may follow one piece."""

    def __init__(self, left: str, check):
        super().__init__()
        self.left, self.check = left, check

    def __missing__(self, right: str) -> bool:
        found = self[right] = self.check(self.left, right)
        return found


class _Pairs(dict):
    """Pair checks by the first piece."""

    def __init__(self, check):
        super().__init__()
        self.check = check

    def __missing__(self, left: str) -> _Follow:
        found = self[left] = _Follow(left, self.check)
        return found

    def trim(self) -> None:
        if sum(map(len, self.values())) > PAIRS:
            self.clear()


class PieceBpe:
    """Ids of texts by one SentencePiece BPE model, as ``encode(text)`` gives them."""

    def __init__(self, path: str):
        proto = model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.name != "identity" or spec.remove_extra_whitespaces:
            raise ValueError("only BPE models with the identity normalizer are supported")
        if any(p.type == USER for p in proto.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.dummy_prefix = spec.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.unknown = next(i for i, k in enumerate(self.kinds) if k == UNKNOWN)
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.id_of = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.byte_id = {}
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
        self.chars = {p for p in self.score if len(p) == 1}
        whole = [p for p in self.score if len(p) == 1 or self.merged(list(p)) == [p]]
        self.automaton = ahocorasick.Automaton()
        for p in whole:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        kept = set(whole)
        self.shorter = {}
        for p in whole:
            for k in range(len(p) - 1, 0, -1):
                if p[:k] in kept:
                    self.shorter[p] = p[:k]
                    break
        self.compatible = _Pairs(self._compatible)
        self.split = re.compile(_parts_pattern(self.score)).findall
        self.history = functools.lru_cache(maxsize=len(whole))(self._history)
        self.parts = _Parts(self._part)
        self.digested = _Parts(self._digested)
        self.bytes_of = [self.token_bytes(i) for i in range(len(self.pieces))]
        self.decimal = [str(i) for i in range(len(self.pieces))]

    # -- the model's rule ---------------------------------------------------

    def merged(self, symbols: list[str]) -> list[str]:
        """Symbols merged by the model's rule: highest score first, leftmost on ties."""
        score = self.score
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _history(self, piece: str) -> tuple[list[float], list[str], list[str]]:
        """Merges of a piece that merges into itself: score, first and last symbol before each."""
        score, symbols = self.score, list(piece)
        scores, firsts, lasts = [], [], []
        while True:
            firsts.append(symbols[0])
            lasts.append(symbols[-1])
            if len(symbols) == 1:
                scores.append(-math.inf)
                return scores, firsts, lasts
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            scores.append(best)

    def _compatible(self, left: str, right: str) -> bool:
        """Whether the characters of both merge into just these two pieces.

        Merges within a side go as alone until one crosses the border: the merge
        with the higher score comes first, on ties the one further left.
        """
        l_scores, _, lasts = self.history(left)
        r_scores, firsts, _ = self.history(right)
        score = self.score
        i = j = 0
        while True:
            own, other = l_scores[i], r_scores[j]
            across = score.get(lasts[i] + firsts[j])
            if across is not None and across > own and across >= other:
                return False
            if own >= other:
                i += 1
                if i == len(l_scores):
                    return True
            else:
                j += 1

    # -- encoding -------------------------------------------------------------

    def backtrack(self, run: str) -> list[str]:
        """Pieces of a stretch whose characters all have a piece."""
        n = len(run)
        longest = [0] * n
        matches, compatible = self.automaton.iter_long, self.compatible
        usable = bytearray(b"\x01") * (n + 1)
        tokens: list[str] = []
        before: dict[str, bool] = {}  # checks of the piece before, by the candidate
        pos = 0
        while pos < n:
            if not longest[pos]:
                # Longest pieces from here on, one after another, up to a known one.
                for end, length in matches(run, pos):
                    start = end - length + 1
                    if longest[start]:
                        break
                    longest[start] = length
            candidate = run[pos : pos + longest[pos]]
            while not (usable[pos + len(candidate)] and (not tokens or before[candidate])):
                candidate = self.shorter.get(candidate)
                while candidate is None:
                    # Nothing fits here: this start fails, the piece before is taken back.
                    usable[pos] = 0
                    candidate = tokens.pop()
                    pos -= len(candidate)
                    candidate = self.shorter.get(candidate)
                    before = compatible[tokens[-1]] if tokens else {}
            tokens.append(candidate)
            pos += len(candidate)
            before = compatible[candidate]
        return tokens

    def _part(self, part: str) -> list[int]:
        if self.chars.issuperset(part):
            return [self.id_of[p] for p in self.backtrack(part)]
        out: list[int] = []
        start = 0
        for k, ch in enumerate(part):
            if ch not in self.chars:
                if start < k:
                    out.extend(self.id_of[p] for p in self.backtrack(part[start:k]))
                out.extend(self.byte_id[b] for b in ch.encode("utf-8", "surrogatepass"))
                start = k + 1
        if start < len(part):
            out.extend(self.id_of[p] for p in self.backtrack(part[start:]))
        return out

    def escaped(self, text: str) -> str:
        if not text:
            return ""
        return (" " + text if self.dummy_prefix else text).replace(" ", SPACE)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty give none."""
        found = map(self.parts.__getitem__, self.split(self.escaped(text or "")))
        out = list(itertools.chain.from_iterable(found))
        if self.parts.trim():
            self.compatible.trim()
        return out

    # -- decoding -------------------------------------------------------------

    def token_bytes(self, i: int) -> bytes:
        """Bytes of one id: U+2581 as a space, byte pieces as their byte, control ids none."""
        kind = self.kinds[i]
        if kind == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return self.pieces[i].replace(SPACE, " ").encode()

    def decode(self, ids: list[int]) -> str:
        """The text of ids, as ``decode(ids)`` of the library gives it."""
        table = self.bytes_of
        data = b"".join([table[i] for i in ids])
        if ids and self.drops_space(ids[0]):
            data = data[1:]
        return data.decode("utf-8", "replace")

    def drops_space(self, first: int) -> bool:
        """Whether decoding drops the space that this first id begins with."""
        return self.dummy_prefix and self.kinds[first] == NORMAL and self.pieces[first].startswith(SPACE)


    # -- digests --------------------------------------------------------------

    def _digested(self, part: str) -> tuple[str, str]:
        """Decimal ids of a part, joined by commas, and the text they decode to.

        Its ids hold whole characters, so texts of parts can be joined.
        """
        ids = self._part(part)
        table = self.bytes_of
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return ",".join([self.decimal[i] for i in ids]), text

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded text."""
        found = list(map(self.digested.__getitem__, self.split(self.escaped(text or ""))))
        if self.digested.trim():
            self.compatible.trim()
        ids, decoded = ",".join([f[0] for f in found]), "".join([f[1] for f in found])
        if found and self.drops_space(int(ids.partition(",")[0])):
            decoded = decoded[1:]
        return (
            ids.count(",") + 1 if found else 0,
            hashlib.sha256(ids.encode()).hexdigest(),
            hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest(),
        )


@functools.cache
def model(path: str) -> PieceBpe:
    """One model per path and Python worker."""
    return PieceBpe(path)


def piece_digests(docs, model_path: str, id_col: str = "doc_id", text_col: str = "text"):
    """Encodes and decodes every whole text by a SentencePiece BPE model.

    Columns: ``doc_id``, ``n_tokens`` (all ids, no begin or end id), ``ids_sha256``
    (decimal ids joined by commas), ``decoded_sha256`` (the decoded text in UTF-8).
    Null counts as empty; an empty text has no id and decodes to ''. Repeated rows
    and null ids stay, one result row each. An empty table gives an empty result.
    Other columns, whatever their names, are ignored. Texts are encoded where they
    lie; a task holds one batch of texts and the parts it remembers.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    from urltriage.llm.common import col

    source = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def encode(batches):
        coder = model(model_path)
        for batch in batches:
            rows = [coder.digests(t) for t in batch.column(1).to_pylist()]
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return source.mapInArrow(encode, schema)
