"""Safe cuts of a text for the two tokenizer families, and bounded caches of what each cut piece gives.

A cut is safe if no token of the vocabulary reaches over it, so the tokens of the
whole text are those of the parts, one after the other.

* Merge vocabularies with a space mark (``U+2581``): a cut before a run of marks is
  safe if no piece has a mark behind another character; a cut before a run of line
  feeds is safe if no piece holds one.  ``PieceCuts`` checks both on the vocabulary.
* Byte-level merge vocabularies with the usual word pattern: white space never joins
  what stands before it, and only a single space joins what stands behind it.
"""

from __future__ import annotations

import re

from corpusforge.llm.common import WHITE_SPACE

MARK = "▁"
#: Entries a worker's cache holds before it is emptied (about 100 bytes each).
CACHE_ENTRIES = 300_000

_WS, _NOT = f"[{WHITE_SPACE}]", f"[^{WHITE_SPACE}]"
_BYTE_PARTS = re.compile(f"{_WS}+(?={_WS}{_NOT})| ?{_NOT}+|{_WS}+")


def byte_parts(text: str) -> list[str]:
    """Parts of ``text`` that byte-level vocabularies encode independently."""
    return _BYTE_PARTS.findall(text)


class PieceCuts:
    """Safe cuts for a vocabulary of marked pieces, as far as its pieces allow them."""

    def __init__(self, pieces: list[str]):
        mark_first = not any(MARK in p.lstrip(MARK) for p in pieces)
        lines_apart = not any("\n" in p for p in pieces)
        if mark_first and lines_apart:
            self._find = re.compile(" +[^ \n]*|\n+[^ \n]*").findall
        elif mark_first:
            self._find = re.compile(" +[^ ]*").findall
        else:
            self._find = lambda s: [s]

    def __call__(self, text: str) -> list[str]:
        """Parts of the normalized text with spaces for marks; the first starts with the dummy space."""
        return self._find(" " + text.replace(MARK, " ")) if text else []


class Bounded(dict):
    """A cache of ``make(part)`` that is emptied by ``trim`` once it has grown past its bound."""

    def __init__(self, make, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.entries = make, entries

    def __missing__(self, part):
        value = self[part] = self.make(part)
        return value

    def trim(self) -> None:
        if len(self) > self.entries:
            self.clear()
