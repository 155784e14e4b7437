"""The default text normalization of the subword trainer (T8, T9, M2): NFKC with its white-space rules, as a Column.

It rewrites the longest known prefix again and again.  Known are single characters with a compatibility
form, and the full decompositions of composed characters, whose parts may be compatibility variants;
marks are never reordered, and a composed character takes up no further mark.  So it is done in three
steps that give the same: characters that stand for one other character, then decompositions, then
characters that stand for several or for none.

ASCII text is rewritten natively; only other rows reach Python, in Arrow batches.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The library's additions to NFKC.  Characters that become a space, that vanish, and one that stays.
SPACES = "\t\n\f\r\u061c\u1680\u200b\u200c\u200e\u200f\u2028\u2029\u2581\ufeff\ufffd"
REMOVED = "".join(map(chr, [*range(0x01, 0x09), 0x0B, *range(0x0E, 0x20), 0x7F, 0x8F, 0x9F]))
KEPT = "\uff5e"


@lru_cache(maxsize=1)
def _rules() -> tuple[dict, dict, dict, re.Pattern, int]:
    """Single replacements, several or none, decompositions to composed, what may follow in one, and the longest."""
    one, other, composed = {}, {}, {}
    for point in range(1, sys.maxunicode + 1):
        c = chr(point)
        if not unicodedata.decomposition(c) and not "가" <= c <= "힣":  # Hangul syllables decompose by rule
            continue
        whole = unicodedata.normalize("NFKD", c)
        if len(whole) > 1:
            back = unicodedata.normalize("NFC", whole)
            if back != whole:
                composed[whole] = back
        short = unicodedata.normalize("NFKC", c)
        if short == c or c in KEPT:
            continue
        if len(whole) == 1:
            one[point] = whole
        else:
            other[point] = short
    for c in SPACES + REMOVED:
        one.pop(ord(c), None)
        other[ord(c)] = " " if c in SPACES else ""
    follow = sorted({c for s in composed for c in s[1:]})
    return one, other, composed, re.compile("[" + "".join(map(re.escape, follow)) + "]"), max(map(len, composed))


@lru_cache(maxsize=1)
def _rewritten() -> tuple[frozenset[str], frozenset[str], frozenset[str], frozenset[str]]:
    """Characters that a step may change, those of the first and of the last step, and marks of which every decomposition has one.

    A text without the first stays as it is, one without the marks has nothing to compose.
    """
    one, other, composed, _follow, _longest = _rules()
    single, several = frozenset(map(chr, one)), frozenset(map(chr, other))
    marks = frozenset(c for s in composed for c in s[1:] if not c.isascii())
    return single | several | marks, single, several, marks


@lru_cache(maxsize=256)
def _any_of(chars: frozenset[str]) -> re.Pattern:
    return re.compile("[" + "".join(map(re.escape, sorted(chars))) + "]")


def _replaced(text: str, chars: frozenset[str], table: dict) -> str:
    """``text`` with ``chars`` replaced by a table; with ``translate`` every character that stays would cost a missed lookup."""
    return _any_of(chars).sub(lambda m: table[ord(m[0])], text) if chars else text


def normalized(text: str) -> str:
    """``text`` as the library's normalizer gives it, before spaces are joined."""
    rewritten, single, several, marks = _rewritten()
    found = rewritten.intersection(text)
    if found.issubset(SPACES):
        for c in found:
            text = text.replace(c, " ")
        return text
    one, other, composed, follow, longest = _rules()
    text = _replaced(text, found & single, one)
    if not marks.isdisjoint(text):
        out, done = [], 0
        for m in follow.finditer(text):
            start = m.start() - 1
            if start < done:
                continue
            for size in range(longest, 1, -1):
                back = composed.get(text[start : start + size])
                if back is not None:
                    out += [text[done:start], back]
                    done = start + size
                    break
        if done:
            text = "".join([*out, text[done:]])
    return _replaced(text, several.intersection(text), other)


#: Rows that are Python texts at once.
SLICE_ROWS = 256


@F.arrow_udf(T.StringType())
def _normalized(texts: pa.Array) -> pa.Array:
    parts = [pa.array([], pa.string())]
    for low in range(0, len(texts), SLICE_ROWS):
        parts.append(pa.array([None if t is None else normalized(t) for t in texts.slice(low, SLICE_ROWS).to_numpy(zero_copy_only=False)], pa.string()))
    return pa.concat_arrays(parts)


def normalize_text(text: Column) -> Column:
    """Characters rewritten; white space of any kind is a space, tab, feed or return afterwards."""
    other = text.rlike(r"[^\x00-\x7F]")
    plain = F.regexp_replace(text, r"[\x01-\x08\x0B\x0E-\x1F\x7F]", "")
    return F.when(other, _normalized(F.when(other, text))).otherwise(plain)
