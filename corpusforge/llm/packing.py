"""Hierarchical packing of token ids into sequences of several lengths.

The tiers are the window and the powers of two below it.  A document is cut into full
windows; what is left over is routed to the shortest tier that holds it.  Long tiers are
packed first: a left-over opens a sequence of its tier's length and the gap is filled with
the longest left-overs of shorter tiers that fit, at last with the head of one that is cut
to the gap (its tail is routed anew).  A sequence of a tier is therefore always full.  What
a task has left at its end, less than a window, is cut into sequences of falling powers of
two, so nothing is padded.  ``step_group`` numbers runs of sequences of about
``group_tokens`` tokens (they differ by less than a window), so training steps are balanced.

Each task packs the rows of its own input partition: nothing is shuffled, and a task holds
one record batch and at most ``POOL`` left-overs, each shorter than a window.  Sequence ids
hold the partition in the high bits; a task that runs again gives the same rows.

Null text counts as empty: the end id alone.  Rows with a null id and repeated rows are packed
like any other.  Only the id and the text column are read, so further columns cannot clash;
an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusforge.llm.common import byte_slices, keyed_text, loaded, model_bytes
from corpusforge.llm.pieces import Bounded, byte_parts

WINDOW = 1024
#: Shortest tier; what a task has left at its end may make shorter sequences.
SHORTEST = 128
#: Id behind every document.
END_ID = 0
#: Left-overs a task gathers before it packs them.
POOL = 4096
#: Tokens of a step group.
GROUP_TOKENS = 64 * 1024
BATCH_BYTES = 4 << 20

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group long"


#: Letters and digits among the first 256 characters (fixed values of the Unicode standard).
_LETTER, _DIGIT = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
# fixed value: the word pattern that byte-level vocabularies of this kind are defined with, for these characters
_WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^\s{_LETTER}{_DIGIT}]+|\s+(?!\S)|\s+")


def latin_words(text: str) -> list[str] | None:
    """Words of a text by the vocabulary's pattern; None unless all characters are of the first 256 and white space is plain."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        if "\x85" in text or "\xa0" in text:
            return None
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return None  # white space to re, but not to the library
    return _WORDS.findall(text)


class ByteLevelIds:
    """Ids of texts as little-endian 32-bit bytes, for a byte-level merge vocabulary of the tokenizers library.

    A text of plain Latin characters is cut into words by the vocabulary's pattern, and each word goes
    once per cache to the library's merge model.  Of any other text the parts between safe cuts are
    treated so, or go through the library's whole path; a text that holds a special string does as a whole.
    """

    def __init__(self, data: bytes):
        import json

        from tokenizers import Tokenizer

        spec = json.loads(data)
        pre = spec.get("pre_tokenizer") or {}
        self.tok = Tokenizer.from_str(data.decode())
        self.tok.no_truncation()
        self.tok.no_padding()
        self.split = spec["model"]["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and pre.get("use_regex", True)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        # fixed values: how byte-level vocabularies show bytes as characters
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.word_ids = Bounded(self._word)
        self.part_ids = Bounded(self._part)

    def _word(self, word: str) -> bytes:
        shown = "".join(map(self.shown.__getitem__, word.encode()))
        return b"".join(t.id.to_bytes(4, "little") for t in self.tok.model.tokenize(shown))

    def _whole(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.tok.encode(text, add_special_tokens=False).ids)

    def _part(self, part: str) -> bytes:
        words = latin_words(part)
        return self._whole(part) if words is None else b"".join(map(self.word_ids.__getitem__, words))

    def __call__(self, text: str) -> bytes:
        if not self.split or any(s in text for s in self.special):
            return self._whole(text)
        self.word_ids.trim()
        words = latin_words(text)
        if words is not None:
            return b"".join(map(self.word_ids.__getitem__, words))
        self.part_ids.trim()
        return b"".join(map(self.part_ids.__getitem__, byte_parts(text)))


class TierPacker:
    """Packs the left-overs of one task; ``rows`` gathers finished pieces."""

    def __init__(self, partition: int, window: int = WINDOW, group_tokens: int = GROUP_TOKENS):
        self.window, self.group_tokens = window, group_tokens
        self.base = partition << 33
        self.sequences = self.tokens = self.waiting = self.held = 0
        self.pool: dict[int, deque] = {}  # by size
        self.sizes = 0  # bit s is set if the pool has a left-over of size s
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // 4
        full = n // self.window
        for k in range(full):
            self._sequence(self.window, [(doc_id, k * self.window, ids[4 * k * self.window : 4 * (k + 1) * self.window], n)])
        if n % self.window:
            self._wait((doc_id, full * self.window, ids[4 * full * self.window :], n))

    def _wait(self, piece: tuple) -> None:
        size = len(piece[2]) // 4
        self.pool.setdefault(size, deque()).append(piece)
        self.sizes |= 1 << size
        self.waiting += size
        self.held += 1

    def _take(self, size: int) -> tuple:
        queue = self.pool[size]
        piece = queue.popleft()
        if not queue:
            self.sizes &= ~(1 << size)
        self.waiting -= size
        self.held -= 1
        return piece

    def _fill(self, gap: int) -> list[tuple]:
        """Left-overs for the gap: the longest that fits again and again, else the head of the shortest."""
        out = []
        while gap:
            if fitting := self.sizes & ((2 << gap) - 1):
                size = fitting.bit_length() - 1
                out.append(self._take(size))
                gap -= size
            else:
                size = (self.sizes & -self.sizes).bit_length() - 1
                doc_id, start, ids, n = self._take(size)
                out.append((doc_id, start, ids[: 4 * gap], n))
                self._wait((doc_id, start + gap, ids[4 * gap :], n))
                gap = 0
        return out

    def pack(self) -> None:
        """Pack the pool until less than a window is left."""
        while self.waiting >= self.window:
            longest = self.sizes.bit_length() - 1
            tier = max(SHORTEST, 1 << (longest - 1).bit_length())
            piece = self._take(longest)
            self._sequence(tier, [piece, *self._fill(tier - longest)])

    def finish(self) -> None:
        self.pack()
        while self.waiting:
            tier = 1 << (self.waiting.bit_length() - 1)
            self._sequence(tier, self._fill(tier))

    def _sequence(self, length: int, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            size = len(ids) // 4
            self.rows.append((doc_id, start, size, zlib.crc32(ids), n, self.base + self.sequences, offset, length, self.base + self.tokens // self.group_tokens))
            offset += size
        self.sequences += 1
        self.tokens += length

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, step_group."""
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    data = model_bytes(path)
    key = ("packing", hashlib.sha256(data).hexdigest())
    slim = keyed_text(docs, id_col, text_col)
    names = ["_id", *(f.split()[0] for f in SCHEMA.split(", "))]
    end = end_id.to_bytes(4, "little")

    def run(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = loaded(key, lambda: ByteLevelIds(data))
        packer = TierPacker(TaskContext.get().partitionId(), window, group_tokens)
        kind = None

        def rows():
            cols = list(zip(*packer.taken(), strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])], names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for part in byte_slices(batch, 1, BATCH_BYTES):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    packer.add(doc_id, encode(text or "") + end)
                    if packer.held >= POOL:
                        packer.pack()
                yield rows()
        if kind is not None:
            packer.finish()
            yield rows()

    out = slim.mapInArrow(run, f"_id {slim.schema['_id'].dataType.simpleString()}, {SCHEMA}")
    return out.withColumnRenamed("_id", id_col)
