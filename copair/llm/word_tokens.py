"""Token ids of whole texts, unit by unit, with the ids of recent units kept."""

from __future__ import annotations

import os
import re

import numpy as np

#: Units kept per generation and Python worker; two generations are held.
CACHE_UNITS = 300_000
#: Longer units are encoded each time, which bounds the bytes that are kept.
LONGEST_KEPT = 64
#: Characters of texts whose units this module finds itself: printable Latin-1, tab and line ends.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*")
_LETTERS, _DIGITS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The tokenizer's units in lower-case text of those characters (fixed by its file).
_UNITS = re.compile(rf"[{_LETTERS}]+|[{_DIGITS}]|'(?:s|t|re|ve|m|ll|d)|[^\s{_LETTERS}{_DIGITS}]+")
#: White space to ``str.split`` but not to the tokenizer.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def byte_symbols() -> list[str]:
    """The printable character that byte-level models write for each byte: itself where that is
    a visible Latin-1 character, else the next one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


class WordEncoder:
    """Token ids of whole texts.

    In texts of plain characters the tokenizer's units (runs of letters, single digits, runs of
    marks) are found by one pattern and each unit goes through the model alone, without the
    costly normalisation.  Other texts are cut at white space, which the tokenizer drops, and
    their words take the tokenizer's own path.
    """

    _kept: dict[str, "WordEncoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.packed = [i.to_bytes(4, "little") for i in range(self.vocabulary)]
        symbols = byte_symbols()
        self.to_symbols = {c: "".join(symbols[b] for b in chr(c).encode()) for c in range(128, 256)}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str) -> "WordEncoder":
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _unit(self, unit: str) -> bytes:
        symbols = unit if unit.isascii() else unit.translate(self.to_symbols)
        return b"".join([self.packed[t.id] for t in self.model.tokenize(symbols)])

    def _joined(self, units: list[str], encode) -> bytes:
        if len(self.cache) > CACHE_UNITS:
            self.older, self.cache = self.cache, {}
        cache = self.cache
        found = list(map(cache.get, units))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    unit = units[k]
                    ids = cache.get(unit)  # met earlier in this text
                    if ids is None:
                        ids = self.older.get(unit)
                        if ids is None:
                            ids = encode(unit)
                        if len(unit) <= LONGEST_KEPT:
                            cache[unit] = ids
                    found[k] = ids
        return b"".join(found)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text (null: none)."""
        out = []
        for text in texts:
            if not text:
                out.append(b"")
            elif _PLAIN.fullmatch(text) and "<|" not in text:
                out.append(self._joined(_UNITS.findall(text.lower()), self._unit))
            elif any(c in text for c in _SEPARATORS):
                out.append(self._whole(text))
            else:
                out.append(self._joined([" " + w for w in text.split()], self._whole))
        return out
