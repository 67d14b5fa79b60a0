"""Exact token ids of whole texts, fast for words that occur again.

Two public vocabularies are read by the tokenizers library. Its result for a text
is the concatenation of its results for the stretches between certain white space,
so each distinct stretch is encoded once and remembered. Stretches of plain
Latin letters, digits and ASCII marks are cut by the vocabulary's own pattern and
their parts given to the library's model; all others are given to the library whole.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator

from tokenizers import Tokenizer

#: Characters of a text that are looked at together.
SLAB_CHARS = 1 << 20
#: Words that are remembered at least; twice as many at most.
REMEMBERED = 400_000
#: Longer words are not remembered.
LONGEST_REMEMBERED = 64

_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"[!-~{_LATIN} \n]+")
# White space of Python that the library takes for marks.
_MARKS_NOT_SPACE = re.compile("[\x1c-\x1f]")
_OTHER_SPACE = re.compile(r"[^\S \n]")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves; the others, in order, for 256 and up.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


SYMBOLS = byte_symbols()
_BYTE_OF = {s: b for b, s in enumerate(SYMBOLS)}
_SYMBOL_TABLE = dict(enumerate(SYMBOLS))


def as_symbols(text: str) -> str:
    """The bytes of a text, each as its character."""
    return text.encode().decode("latin-1").translate(_SYMBOL_TABLE)


def as_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class _Memory(dict):
    """The last words and their ids, as little-endian unsigned 32-bit bytes."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(word) <= LONGEST_REMEMBERED:
            self[word] = ids
        return ids

    def trim(self) -> None:
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()


class Encoder:
    """Ids of texts by one vocabulary file, without added or special handling.

    Stands for ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.
    """

    parts: re.Pattern

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # Matches nowhere if there is no added token.
        self.has_added = re.compile("|".join(map(re.escape, self.added)) or "(?!)").search
        self.words, self.pieces = _Memory(self._word), _Memory(self._piece)

    def whole(self, text: str) -> bytes:
        """Ids of any text by the library itself."""
        return as_bytes(self.library.encode(text, add_special_tokens=False).ids)

    def model_ids(self, symbols: str) -> list[int]:
        """Ids of one unsplit piece, given as byte symbols."""
        return [t.id for t in self.model.tokenize(symbols)]

    def _piece(self, piece: str) -> bytes:
        return as_bytes(self.model_ids(as_symbols(piece)))

    def _word(self, word: str) -> bytes:
        if not _PLAIN.fullmatch(word) or self.has_added(word):
            return self.whole(word)
        return b"".join(map(self.pieces.__getitem__, self.parts.findall(self.folded(word))))

    def folded(self, word: str) -> str:
        return word

    def split(self, text: str) -> list[str]:
        raise NotImplementedError

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        slabs = [text] if len(text) <= SLAB_CHARS else self._slabs(text)
        out = b"".join(
            self.whole(s) if self.unusual.search(s) else b"".join(map(self.words.__getitem__, self.split(s)))
            for s in slabs
        )
        self.words.trim()
        self.pieces.trim()
        return out

    def _slabs(self, text: str) -> Iterator[str]:
        """Parts whose ids concatenate: each begins with a space after a letter, digit or mark."""
        begin = 0
        while begin < len(text):
            end = text.find(" ", begin + SLAB_CHARS)
            while end > 0 and text[end - 1].isspace():
                end = text.find(" ", end + 1)
            end = len(text) if end < 0 else end
            yield text[begin:end]
            begin = end


class ByteBpe(Encoder):
    """Byte-level vocabulary in which a word keeps the space before it."""

    parts = re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^ \\n{_LATIN}0-9]+|[ \\n]+(?![^ \\n])|[ \\n]+"
    )
    # A stretch ends before a space or line feed, so other white space must not touch it.
    unusual = re.compile(f"{_OTHER_SPACE.pattern}|{_MARKS_NOT_SPACE.pattern}")
    split = staticmethod(re.compile(r"[ \n]*[^ \n]+|[ \n]+").findall)

    @functools.cached_property
    def token_bytes(self) -> list[bytes]:
        """The bytes of each id; an added token stands for its own text."""
        size = self.library.get_vocab_size(with_added_tokens=True)
        tokens = [self.library.id_to_token(i) for i in range(size)]
        return [
            t.encode() if t in self.added else bytes(map(_BYTE_OF.__getitem__, t)) for t in tokens
        ]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; stands for ``decode(ids, skip_special_tokens=False)``."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode(errors="replace")


class WordBpe(Encoder):
    """Vocabulary in lower case whose words end in a marked token; white space is dropped."""

    parts = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^ \\n{_LATIN}0-9]+")
    unusual = _MARKS_NOT_SPACE
    split = staticmethod(str.split)

    def folded(self, word: str) -> str:
        return word.lower()


@functools.cache
def encoder(kind: type[Encoder], path: str) -> Encoder:
    """One encoder for each Python worker; its memory outlives the task."""
    return kind(path)
