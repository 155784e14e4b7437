"""Substring dedup by fixed-block anchors: words that an earlier document already has in a run of ``window`` words.

A document is cut into non-overlapping blocks of ``(window + 1) // 2`` words, so every window of
``window`` words covers a whole block of the document it starts in.  The index files each block
under its anchor: the least hash of the block's word shingles.  A rolling window of a block's
length that has the same words has the same anchor, so every rolling window probes the index with
its anchor; neighbouring windows mostly share one, and only distinct anchors of a document are
shuffled, about a tenth of its windows.  An anchor that is a block's and is met by another
document is a hit.

Hits are extended to both sides as long as the anchors of the neighbouring rolling windows are
shared as well; the windows of ``window`` words inside are compared by 95 bits of their words'
hashes, over all documents, and a window that a smaller id has is covered.  Overlapping covered
windows make up the maximal exact repeats; their words go.  Windows are judged on the input, not on
what is left.

Nothing is paired.  Equal texts are one text: its smallest id takes part, the others lose all.  An
anchor keeps two of its texts only, merged before the shuffle.  A task settles the windows that it
has under a smaller id by itself and sends on one row for each window, so a passage in a third of
all documents gives a group of as many rows as tasks.  Hash collisions: 64 bits only pick what is
compared; a false cover needs equal 95 bits of different windows (or equal MD5 of texts).

Null and empty texts have no words; texts shorter than the window lose nothing.  A row with a null
id neither covers nor loses words.  Rows that repeat an id are judged each on its own, against
smaller ids only; the shared anchors of one id, over its different texts, are gathered in one row, as ids are
meant to name one text or few.  Only the id and text columns are read, so further columns cannot clash; an
empty table gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import byte_slices, keyed_text

WINDOW = 50
BATCH_BYTES = 2 << 20
#: Windows a task holds before it sends them on.
HELD = 1 << 21
#: Words of more bytes are hashed one by one.
LONG_WORD = 64

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD, _OTHER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, and where each text's words start among them (one entry more than texts)."""
    import xxhash

    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    size = int(offsets[-1] - offsets[0]) if len(texts) else 0
    if not size:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = np.zeros(size + 8, np.uint8)  # room to read eight bytes at the last one
    data[:size] = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    inside = ~_SPACE[data[:size]]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = (offsets - offsets[0])[(offsets > offsets[0]) & (offsets < offsets[-1])]
    begins[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    starts = np.nonzero(begins)[0]
    lengths = np.nonzero(ends)[0] + 1 - starts
    eight = np.ndarray((size + 1,), "<u8", data, strides=(1,))
    hashes = _mixed(lengths.astype(np.uint64) * np.uint64(_ODD))
    at = 0
    live = np.nonzero(lengths <= LONG_WORD)[0]
    while len(live):
        left = lengths[live] - at
        part = eight[starts[live] + at]
        cut = np.minimum(left, 8).astype(np.uint64)
        part &= _TOP >> ((np.uint64(8) - cut) * np.uint64(8))
        hashes[live] = _mixed((hashes[live] ^ part) * np.uint64(_OTHER) + np.uint64(1))
        live = live[left > 8]
        at += 8
    for k in np.nonzero(lengths > LONG_WORD)[0]:
        hashes[k] = xxhash.xxh64_intdigest(data[starts[k] : starts[k] + lengths[k]].tobytes())
    return hashes, np.searchsorted(starts, offsets - offsets[0])


def rolling(words: np.ndarray, width: int, base: int = _ODD) -> np.ndarray:
    """Hash of the ``width`` words from each position; behind the last full window the entries mean nothing."""
    n = len(words)
    power = np.full(n + 1, base, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    inverse = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse, dtype=np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * inverse[:n], dtype=np.uint64, out=sums[1:])
    out = np.full(n, _TOP)
    if n >= width:
        out[: n - width + 1] = _mixed((sums[width:] - sums[: n - width + 1]) * power[: n - width + 1])
    return out


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of x[i : i + width] (shorter at the end), by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        more = out.copy()
        more[:-step] = best(out[:-step], out[step:]) if step < len(x) else out[:-step]
        out, have = more, have + step
    return out


class Windows:
    """Word hashes, anchors and windows of the texts of one batch."""

    def __init__(self, texts: pa.Array, window: int):
        self.window = window
        self.block = (window + 1) // 2
        self.shingle = max(1, self.block // 4)
        self.words, self.first = word_hashes(texts)
        lengths = np.diff(self.first)
        self.row = np.repeat(np.arange(len(lengths)), lengths)
        self.place = np.arange(len(self.words)) - self.first[self.row]
        self.left = lengths[self.row] - self.place  # words from here to the end of the text
        # the anchor of the rolling window of a block's length from each word; 0 where there is none
        shingles = rolling(self.words, self.shingle) >> np.uint64(1) | np.uint64(1)
        least = _sliding(shingles, self.block - self.shingle + 1, np.minimum)
        self.anchor = np.where((lengths >= window)[self.row] & (self.left >= self.block), least, np.uint64(0)).view(np.int64)
        self.in_block = (self.anchor > 0) & (self.place % self.block == 0)

    def candidates(self, hits: list[np.ndarray]) -> np.ndarray:
        """Starts of the windows that cover a hit and have nothing but shared anchors; ``hits`` has each text's shared anchors, those of blocks negative."""
        shared, block = np.zeros((2, len(self.words) + 1), np.int64)
        for k, own in enumerate(hits):
            mine = slice(self.first[k], self.first[k + 1])
            anchors = self.anchor[mine]
            block[1:][mine] = np.isin(anchors, -own[own < 0])
            shared[1:][mine] = np.isin(anchors, np.abs(own))
        shared, block = np.cumsum(shared), np.cumsum(block)
        starts = np.nonzero(self.left >= self.window)[0]
        stop = starts + self.window - self.block + 1
        return starts[(shared[stop] - shared[starts] == stop - starts) & (block[stop] > block[starts])]


def _anchor_rows(window: int):
    """Distinct anchors of each text, and whether a block has it."""

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, 1, BATCH_BYTES):
                w = Windows(part.column(1), window)
                change = w.anchor > 0
                change[1:] &= (w.anchor[1:] != w.anchor[:-1]) | (w.row[1:] != w.row[:-1]) | w.in_block[1:]
                at = np.nonzero(change)[0]
                at = at[np.lexsort((~w.in_block[at], w.anchor[at], w.row[at]))]
                row, value = w.row[at], w.anchor[at]
                new = np.ones(len(at), bool)
                new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
                take = pa.array(row[new])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value[new]), part.column(0).take(take), part.column(2).take(take), pa.array(w.in_block[at[new]])],
                    names=["anchor", "_id", "_sum", "block"],
                )

    return run


class _Held:
    """Candidate windows of some texts, each window of each id once; those that a smaller id here has are settled."""

    names = ("h1", "h2", "settled", "_id", "_sum", "starts")

    def __init__(self):
        self.ids, self.sums, self.parts, self.size = [], [], [], 0
        self.seen: set = set()

    def add(self, part: pa.RecordBatch, w: Windows, starts: np.ndarray) -> None:
        keys = list(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True))
        fresh = np.zeros(len(keys), bool)  # rows that repeat an id with its text have the same windows
        for k, key in enumerate(keys):
            if key not in self.seen:
                self.seen.add(key)
                fresh[k] = True
        starts = starts[fresh[w.row[starts]]]
        one = rolling(w.words, w.window, _ODD)[starts].view(np.int64)
        two = (rolling(w.words, w.window, _OTHER)[starts] >> np.uint64(33)).astype(np.int64)
        self.parts.append((one, two, w.row[starts] + len(self.ids), w.place[starts]))
        self.ids += [i for i, _ in keys]
        self.sums += [s for _, s in keys]
        self.size += len(starts)

    def rows(self, kind: pa.DataType) -> pa.RecordBatch:
        one, two, row, place = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        _, rank = np.unique(np.array(self.ids, dtype=object), return_inverse=True)
        order = np.lexsort((place, row, rank[row], two, one))
        one, two, row, place = one[order], two[order], row[order], place[order]
        new = np.ones(len(row), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        lowest = rank[row][new][np.cumsum(new) - 1]
        settled = rank[row] > lowest
        # a row for each open window and text, and one for all settled windows of a text, filed under the text
        order = np.lexsort((place, np.where(settled, 0, np.arange(len(row))), row, settled))
        one, two, row, place, settled, new = (c[order] for c in (one, two, row, place, settled, new))
        one[settled], two[settled] = np.array(self.sums, np.int64)[row[settled]], row[settled]
        first = np.ones(len(row), bool)
        first[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (row[1:] != row[:-1]) | (settled[1:] != settled[:-1])
        at = np.nonzero(first)[0]
        # starts as bytes: half the room of an array of integers in a shuffle
        offsets = np.append(at, len(row)).astype(np.int32) * 4
        lists = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(place.astype(np.int32))])
        own = row[at]
        columns = [pa.array(one[at]), pa.array(two[at], pa.int32()), pa.array(settled[at]), pa.array([self.ids[k] for k in own], kind), pa.array([self.sums[k] for k in own], pa.int64()), lists]
        self.__init__()
        return pa.RecordBatch.from_arrays(columns, names=list(self.names))


def _window_rows(window: int, most: int):
    """Candidate windows of each text: 95 bits of their words, the text's key and the words they start at."""

    def run(batches):
        held = _Held()
        for batch in batches:
            for part in byte_slices(batch, 1, BATCH_BYTES):
                w = Windows(part.column(1), window)
                starts = w.candidates([np.asarray(own.values) for own in part.column(3)])
                if len(starts):
                    held.add(part, w, starts)
                if held.size >= most:
                    yield held.rows(part.schema.field(0).type)
        if held.size:
            yield held.rows(part.schema.field(0).type)

    return run


def _kept_rows(window: int):
    """What is left of each text, with counts and the removed runs of words."""

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, 1, BATCH_BYTES):
                n_words, n_removed, runs, kept = [], [], [], []
                for text, starts, copy in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    words = _WORD.findall(text or "")
                    at = np.unique(np.frombuffer(b"".join(starts or ()), np.int32)).astype(np.int64)
                    own = []
                    if copy and len(words) >= window:
                        own = [(0, len(words))]
                    elif len(at):
                        cut = np.nonzero(np.diff(at) > window)[0] + 1
                        own = list(zip(at[np.concatenate([[0], cut])].tolist(), (at[np.concatenate([cut - 1, [len(at) - 1]])] + window).tolist(), strict=True))
                    left, done = [], 0
                    for a, b in own:
                        left += words[done:a]
                        done = b
                    left += words[done:]
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(left))
                    runs.append([{"start": a, "stop": b} for a, b in own])
                    kept.append(" ".join(left))
                kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.string())],
                    names=["_id", "n_words", "n_removed", "removed", "kept"],
                )

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: the id, n_words, n_removed, removed (runs of words, stop exclusive), kept (the words left, joined by one space)."""
    if window < 1:
        raise ValueError("a window has one word at least")
    slim = keyed_text(docs, id_col, text_col).select("_id", "_text", F.xxhash64("_text").alias("_sum"))
    kind = slim.schema["_id"].dataType.simpleString()
    given = slim.where("_id is not null and _text is not null")
    same = given.select("_id", "_sum", F.md5("_text").alias("md5"))
    first = same.groupBy("md5").agg(F.min("_id").alias("low"), F.max("_id").alias("high")).where("low < high").select("md5", "low")
    copies = same.join(first, "md5").where("_id > low").select("_id", "_sum").distinct()
    # read twice: anchors cost less to make again than to write
    anchors = given.mapInArrow(_anchor_rows(window), f"anchor long, _id {kind}, _sum long, block boolean")
    shared = anchors.groupBy("anchor").agg(F.max("block").alias("block"), F.min("_sum").alias("low"), F.max("_sum").alias("high")).where("low < high")
    shared = shared.select("anchor", F.when(F.col("block"), -F.col("anchor")).otherwise(F.col("anchor")).alias("hit"))
    hits = anchors.select("anchor", "_id").join(shared, "anchor").groupBy("_id").agg(F.collect_set("hit").alias("_hits")).where(F.exists("_hits", lambda h: h < 0))
    hits = hits.join(copies.groupBy("_id").agg(F.collect_set("_sum").alias("_copies")), "_id", "left")
    text = given.join(hits, "_id").where(~F.coalesce(F.array_contains("_copies", F.col("_sum")), F.lit(False))).select("_id", "_text", "_sum", "_hits")
    windows = text.mapInArrow(_window_rows(window, HELD), f"h1 long, h2 int, settled boolean, _id {kind}, _sum long, starts binary")
    low = F.min("_id").over(Window.partitionBy("h1", "h2", "settled"))
    covered = windows.withColumn("low", low).where("settled or _id > low").select("_id", "_sum", "starts", F.lit(False).alias("copy"))
    marks = covered.unionByName(copies.select("_id", "_sum", F.lit(None).cast("binary").alias("starts"), F.lit(True).alias("copy")))
    marks = marks.groupBy("_id", "_sum").agg(F.collect_set("starts").alias("starts"), F.max("copy").alias("copy"))
    joined = slim.join(marks, ["_id", "_sum"], "left").select("_id", "_text", "starts", "copy")
    out = joined.mapInArrow(_kept_rows(window), f"_id {kind}, n_words long, n_removed long, removed array<struct<start:int,stop:int>>, kept string")
    return out.withColumnRenamed("_id", id_col)
