"""Exact and fast use of a tokenizer file: pieces of text that the pre-tokenizer separates are encoded once and remembered."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Sequence
from functools import lru_cache
from struct import pack

from tokenizers import Tokenizer

#: Fixed value: the split pattern of byte-level pre-tokenizers.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The last character whose handling is remembered by piece.
_LAST = 0x24F


def _spaced(text: str) -> bool:
    """Whether white space stands beside a space or at an end: a piece could then hold more than one space."""
    return "  " in text or " \n" in text or "\n " in text or "\t" in text or "\r" in text or text[0].isspace() or text[-1].isspace()


def _members(kind: str) -> str:
    return "".join(chr(c) for c in range(_LAST + 1) if unicodedata.category(chr(c))[0] == kind)


def _narrow(pattern: str) -> re.Pattern:
    """The pattern over characters up to ``_LAST``, for the faster standard library."""
    return re.compile(pattern.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}").replace(r"[^\s\p{L}\p{N}]", f"[^\\s{_members('L')}{_members('N')}]").replace(r"\p{L}", f"[{_members('L')}]").replace(r"\p{N}", f"[{_members('N')}]"))


def _byte_letters() -> dict[int, str]:
    """Characters that stand for the bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}

#: Characters for which lower-casing, composition and character classes agree in every Unicode version and library.
_UNSURE = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ɏ]")


class _Remembered(dict):
    """A table of two generations: when the young one is full it becomes the old one, from which what is met again comes back."""

    old: dict = {}

    def turn(self, most: int) -> None:
        if len(self) > most:
            self.old = dict(self)
            self.clear()


class _Pieces(_Remembered):
    """Ids of pieces, each merged by the tokenizer's model when first met."""

    def __init__(self, merge):
        super().__init__()
        self.merge, self.letters = merge, _byte_letters()

    def merged(self, piece: str) -> bytes:
        ids = [x.id for x in self.merge(piece.encode().decode("latin-1").translate(self.letters))]
        return pack(f"<{len(ids)}I", *ids)

    def __missing__(self, piece: str) -> bytes:
        self[piece] = out = self.old.get(piece) or self.merged(piece)
        return out


class _Words(_Remembered):
    """Ids of words between spaces, put together from those of their pieces; a word of one piece is remembered here alone."""

    def __init__(self, pieces: _Pieces, split, before: str):
        super().__init__()
        self.pieces, self.split, self.before = pieces, split, before

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            parts, n = self.split(self.before + word), len(self.before)
            if len(parts) == 1:
                out = self.pieces.merged(parts[0])
            else:
                out = b"".join([self.get(x[n:]) or self.pieces[x] if x.startswith(self.before) else self.pieces[x] for x in parts])
        self[word] = out
        return out


class Encoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    Strings of special tokens inside a text get their ids, as the tokenizer gives them; with ``special_as_text`` they count
    as ordinary text (the tokenizer's ``encode_special_tokens``). Merges never cross a piece, and pieces
    never cross a single space between words, so the ids of a text are those of its words. Texts with
    characters on which libraries could differ, or with the string of an added token, go to the tokenizer whole. About
    ``max_words`` words and as many pieces are remembered, and those before them.
    """

    def __init__(self, path: str, max_words: int = 500_000, special_as_text: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.max_words = max_words
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        self.added, self.normalized = [t["content"] for t in added], [t["content"].lower() for t in added if t["normalized"]]
        self.split, self.lower = self._splitter(spec)
        self.pieces = _Pieces(self.tokenizer.model.tokenize)
        self.words = _Words(self.pieces, self.split, "" if self.lower else " ")

    @staticmethod
    def _splitter(spec: dict):
        """The pieces of a text and whether it is in lower case and without white space; None where the file's rules are others."""
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if spec["model"]["type"] != "BPE":
            return None, False
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            return _narrow(BYTE_LEVEL_SPLIT).findall, False
        parts = pre.get("pretokenizers", [])
        kinds = [n["type"] for n in (norm or {}).get("normalizers", [])]
        if len(parts) == 2 and parts[0]["type"] == "Split" and parts[0].get("invert") and parts[0]["behavior"] == "Removed" and parts[1]["type"] == "ByteLevel" and not parts[1]["use_regex"] and kinds == ["NFC", "Replace", "Lowercase"]:
            return _narrow(parts[0]["pattern"]["Regex"]).findall, True
        return None, False

    def _one(self, text: str) -> bytes:
        if self.split is None or _UNSURE.search(text) or any(t in text for t in self.added) or self.normalized and any(t in text.lower() for t in self.normalized):
            return pack(f"<{len(ids := self.tokenizer.encode(text, add_special_tokens=False).ids)}I", *ids)
        if self.lower:
            return b"".join(map(self.words.__getitem__, text.lower().split()))
        if _spaced(text):
            return b"".join(map(self.pieces.__getitem__, self.split(text)))
        first, *rest = text.split(" ")
        return b"".join([*map(self.pieces.__getitem__, self.split(first)), *map(self.words.__getitem__, rest)])

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; a null is an empty text."""
        out = []
        for text in texts:
            out.append(self._one(text) if text else b"")
            self.words.turn(self.max_words)
            self.pieces.turn(self.max_words)
        return out


@lru_cache(maxsize=4)
def encoder(path: str, max_words: int = 500_000) -> Encoder:
    """One encoder for each file and Python worker."""
    return Encoder(path, max_words)
