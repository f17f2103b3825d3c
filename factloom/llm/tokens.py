"""Token ids of whole texts by the tokenizers library, with a bounded memo in each Python worker.

The byte-level pre-tokenizer never lets a token cross a single space between
two non-space characters, nor a line end between two, so a text falls apart
there into units whose ids are independent.  Most units repeat; each worker keeps
the ids of units of up to ``UNIT`` characters, of about ``MEMO_BYTES`` in all.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import islice

MEMO_BYTES, UNIT = 128 << 20, 64
ENTRY_BYTES = 160  # what a memo's entry takes beside its characters and ids
MARKS = ".,!?;:|#$%&*"

_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"[^\S \n]")
#: The letters of Latin-1, and where byte-level vocabularies put the bytes that are no printable characters.
_LETTERS = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}

_encoders: dict[tuple[str, bool], Encoder] = {}


class _Memo(dict):
    """unit -> ids; a unit that is not there is encoded, and kept if it is short and the bound allows."""

    def __init__(self, encode):
        self._encode, self._left = encode, MEMO_BYTES

    def __missing__(self, unit: str) -> bytes:
        ids = self._encode(unit)
        size = ENTRY_BYTES + len(unit) + len(ids)
        if len(unit) <= UNIT and size <= self._left:
            self._left -= size
            self[unit] = ids
        return ids


class Encoder:
    """ids of texts as little-endian unsigned 32-bit integers.

    As the library does by itself, strings of special tokens get these tokens'
    ids; with ``as_text`` they are ordinary text, so that no text makes such an id.
    """

    def __init__(self, path: str, as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = as_text
        self._tokenize = self._tokenizer.model.tokenize
        self._memo = _Memo(self._unit)
        self._marks: dict[str, bytes] = {}

    @property
    def size(self) -> int:
        """One more than the largest id."""
        return max(self._tokenizer.get_vocab().values(), default=0) + 1

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str, space: str) -> bytes | None:
        """ids of a word, with a space before or none, if it is a run of Latin letters: one pre-token, which the model takes as it is."""
        if word.isascii():
            return array("I", [x.id for x in self._tokenize(space + word)]).tobytes() if word.isalpha() else None
        if _LETTERS.fullmatch(word):
            return array("I", [x.id for x in self._tokenize(space + word.encode().decode("latin-1").translate(_BYTES))]).tobytes()
        return None

    def _mark(self, mark: str) -> bytes:
        if mark not in self._marks:
            if len(mark) > 3:
                return self._plain([mark])[0]
            self._marks[mark] = self._plain([mark])[0]
        return self._marks[mark]

    def _unit(self, unit: str) -> bytes:
        """ids of a unit, with a space before unless it begins a line; a word's closing marks are taken apart."""
        begins = unit[:1] == "\n"
        stem = unit.rstrip(MARKS)
        word = self._word(stem[1:], "") if begins else self._word(stem, "\u0120")
        if word is not None and (len(stem) == len(unit) or "a" <= stem[-1] <= "z"):
            return (self._mark("\n") if begins else b"") + word + (self._mark(unit[len(stem) :]) if len(stem) < len(unit) else b"")
        return self._plain([unit if begins else " " + unit])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = []
        for text in texts:
            clean = not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[:1] == " " or text[-1:] == " ") and not _ODD.search(text)
            parts.append(text.replace("\n", " \n").split(" ") if clean else _CUT.split(text))
        heads = self._plain([p[0] for p in parts])
        get = self._memo.__getitem__
        return [head + b"".join(map(get, islice(p, 1, None))) for head, p in zip(heads, parts)]


def encoder(path: str, as_text: bool = False) -> Encoder:
    if (path, as_text) not in _encoders:
        _encoders[path, as_text] = Encoder(path, as_text)
    return _encoders[path, as_text]
