"""Tokens of public BPE vocabularies, remembered by pre-token.

The pre-tokenizer of either vocabulary cuts a text into pieces, and each piece is encoded by
itself: so a piece is encoded by the library's model once and then looked up. Texts with
characters for which Python's and the library's character classes could differ, or with a
special token's string, go to the library whole.
"""

from __future__ import annotations

import os
import re
import struct

# The pre-tokenizer patterns of the two public vocabularies, with the letters,
# numbers and white space below U+0250 written out.
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
_S = "\\t-\\r "
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_PATTERN = f"{_SHORT}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
WORD_PATTERN = f"{_SHORT}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+"
# Characters for which both sides surely agree; the dotted capital I lower-cases to two characters.
_UNSURE = re.compile("[^\\t-\\r -~¡-įı-ɏ‐-‧‰-⁞]|<\\|")
_REMEMBER = 200_000  # pieces in each of two generations


def library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores belong to Spark's tasks
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = _byte_letters()


class Pieces(dict):
    """Encodes texts with one vocabulary; made once in a task. Maps a piece to its value."""

    def __init__(self, path: str, pattern: str, lower: bool = False):
        super().__init__()
        self.tokenizer = library(path)
        self.model = self.tokenizer.model
        self.pattern = re.compile(pattern)
        self.lower = lower
        self.old: dict = {}

    def __missing__(self, piece: str):
        value = self.old.get(piece)
        if value is not None:
            self[piece] = value
            return value
        letters = piece.encode().decode("latin-1").translate(_LETTERS)
        value = self[piece] = self.value([t.id for t in self.model.tokenize(letters)])
        return value

    def sure(self, text: str) -> bool:
        return _UNSURE.search(text) is None

    def cut(self, text: str) -> list[str]:
        return self.pattern.findall(text.lower() if self.lower else text)

    def value(self, ids: list[int]):
        return len(ids)

    def values(self, text: str):
        """The value of each piece in order; only for sure texts."""
        if len(self) > _REMEMBER:
            self.old = dict(self)  # frequent pieces move on from the older half
            self.clear()
        return map(self.__getitem__, self.cut(text))

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class PackedPieces(Pieces):
    """The same with each piece's ids as little-endian unsigned 32-bit numbers."""

    def value(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def packed(self, text: str) -> bytes:
        if self.sure(text):
            return b"".join(self.values(text))
        return self.value(self.ids(text))
