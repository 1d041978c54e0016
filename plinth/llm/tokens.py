"""Exact byte-level BPE ids by the tokenizers library, remembered per word."""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Words remembered by a worker; the memory is emptied beyond (about 200 bytes a word).
REMEMBERED = 600_000
_LONGEST_REMEMBERED = 40
#: A space between two characters that are no white space always starts a new pre-token of this family of tokenizers.
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Words(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= _LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


_MARKS = frozenset(".,;:!?")


def _bytes(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


def _byte_chars() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 as it is, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Whole texts to ids. Each distinct word is encoded once by the library; words never merge across a safe space or
    a line break between two characters that are no white space, so the joined ids are those of the whole text."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.table = _byte_chars()
        self.plain = _Words(self._whole)
        self.spaced = _Words(self._after_space)
        self.line_break = self._whole("\n")

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _whole(self, text: str) -> bytes:
        return _bytes(self.library.encode(text, add_special_tokens=False).ids)

    def _after_space(self, word: str) -> bytes:
        if word.isalpha():  # one pre-token: straight to the library's BPE model
            chars = "Ġ" + (word if word.isascii() else word.encode().decode("latin-1").translate(self.table))
            return _bytes([t.id for t in self.model.tokenize(chars)])
        if word[-1] in _MARKS and word[:-1].isalpha():  # the mark is a pre-token of its own
            return self.spaced[word[:-1]] + self.plain[word[-1]]
        return self._whole(" " + word)

    def _line(self, line: str) -> bytes | None:
        words = line.split(" ")
        if "" in words or not line.isprintable():  # printable text has no white space but the space
            return None
        return self.plain[words[0]] + b"".join(map(self.spaced.__getitem__, words[1:]))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, without an end id."""
        if not text:
            return b""
        lines = []
        for line in text.split("\n"):
            ids = self._line(line)
            if ids is None:
                break
            lines.append(ids)
        else:
            return self.line_break.join(lines)
        first, *rest = _SAFE_SPACE.split(text)
        return self._whole(first) + b"".join(map(self.spaced.__getitem__, rest))


def document_ids(text: str | None, path: str, end_id: int = END_ID) -> bytes:
    """Ids of a whole text (null: empty) with the end id."""
    return Encoder.of(path).encode(text or "") + np.array([end_id], "<u4").tobytes()
