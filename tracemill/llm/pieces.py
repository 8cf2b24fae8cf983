"""Texts in pieces that a tokenizer treats alone, and a bounded memory of their tokens."""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Callable

import regex

#: Pre-tokenisation patterns of the two public tokenizers; fixed values.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of these characters only need no normalisation but lower case, and all pattern engines agree on them.
PLAIN = re.compile(r"[ \nA-Za-z0-9À-ÖØ-öø-ÿ.,;:!?'\"()#*$%&|/+=@~_{}\[\]-]*\Z")
#: Most pieces: a word of such letters with marks behind it. Both patterns cut it into the word and the marks.
SIMPLE = re.compile(r"(\n?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#$%&*|]*)\Z")


def byte_alphabet() -> list[str]:
    """The printable character that byte-level tokenizers write for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


_LATIN = dict(zip(range(256), byte_alphabet(), strict=True))


def spelled(text: str) -> str:
    if text.isascii() and text.isprintable():
        return text.replace(" ", _LATIN[32])
    return text.encode().decode("latin-1").translate(_LATIN)


class Memory(dict):
    """Values of recent keys of at most LONGEST characters: two generations of at most `size` keys each, so the space is
    bounded and frequent keys stay. Longer keys are made anew each time."""

    LONGEST = 64

    def __init__(self, make: Callable[[str], object], size: int = 400_000):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key: str):
        if len(key) > self.LONGEST:
            return self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        value = self[key] = self.old[key] if key in self.old else self.make(key)
        return value


def cut(text: str) -> list[str]:
    """Cut before each space and line feed. A piece stands for itself with a space before it, but a piece that starts with a line feed, and the first (marked by a NUL), stand for themselves."""
    found = text.replace("\n", " \n").split(" ")
    found[0] = "\0" + found[0]
    return found


def piece_text(piece: str) -> str:
    return piece[1:] if piece[0] == "\0" else piece if piece[0] == "\n" else " " + piece


def stands_alone(piece: str) -> bool:
    """A cut after this piece is one that byte-level pre-tokenisation makes too: no white space stands before it."""
    return bool(piece) and not piece[-1].isspace() and piece != "\0" and ord(piece[-1]) >= 32


def simple_parts(piece: str) -> list[str] | None:
    """The pre-tokens of a simple piece for byte-level tokenizers."""
    m = SIMPLE.match(piece)
    if m is None:
        return None
    line, word, marks = m.groups()
    parts = ["\n", word] if line else [" " + word]
    if marks:
        parts.append(marks)
    return parts


class LibraryTokens:
    """Token ids of the tokenizers library as little-endian bytes, remembered by piece.

    Plain pieces go through the library's own BPE model after the same splitting; all others, and texts whose pieces
    do not stand alone, through its whole encoder.
    """

    def __init__(self, path: str, by_word: bool, pieces: int = 400_000, parts: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model, self.by_word = self.tok.model, by_word
        self.pattern = regex.compile(WORD_PATTERN if by_word else BYTE_PATTERN)
        self.parts, self.memory = Memory(self._part, parts), Memory(self._piece, pieces)

    def _part(self, part: str) -> bytes:
        return array("H", [t.id for t in self.model.tokenize(spelled(part))]).tobytes()

    def whole(self, text: str) -> bytes:
        return array("H", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes | None:
        parts = self.parts
        if self.by_word:
            if m := SIMPLE.match(piece):
                _, word, marks = m.groups()
                return parts[word.lower()] + parts[marks] if marks else parts[word.lower()]
            text = piece.lower() if PLAIN.match(piece) else None
        elif m := SIMPLE.match(piece):
            line, word, marks = m.groups()
            if not (line or marks):
                return self._part(" " + word)
            found = parts["\n"] + parts[word] if line else self.memory[word]  # a word is a piece, so it is kept once
            return found + parts[marks] if marks else found
        elif not stands_alone(piece):
            return None
        else:
            piece = piece_text(piece)
            text = piece if PLAIN.match(piece) else None
        if text is None:
            return self.whole(piece)
        return b"".join([parts[p] for p in self.pattern.findall(text)])

    def encode(self, text: str) -> bytes:
        """The ids as unsigned 16-bit integers of this machine's (little-endian) order; the vocabularies fit."""
        memory = self.memory
        found = [memory[p] for p in (text.replace("\n", " ").split(" ") if self.by_word else cut(text))] if text else []
        return self.whole(text) if None in found else b"".join(found)


@functools.cache
def library_tokens(path: str, by_word: bool, *remembered: int) -> LibraryTokens:
    """One for each worker process and file; `remembered` are the numbers of pieces and of their parts that are kept."""
    return LibraryTokens(path, by_word, *remembered)
