"""Best segmentations under a unigram vocabulary, an Arrow batch at a time.

The distinct units of a batch are segmented together, on the lattice tables that the learner uses, and every
occurrence takes its unit's tokens by position.  No unit outlives its batch, and tokens are put together for
some rows at a time, so a worker holds a batch and the vocabulary, however many units a corpus has.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpusforge.operators.unigram_learner import UNK_PENALTY, Block, Trie, cut_blocks

#: Units whose distinct ones are segmented together, units whose tokens are put together, and characters whose lattices are made at once.
BATCH_UNITS = 1 << 21
SLICE_UNITS = 1 << 17
LATTICE_CHARS = 1 << 16
#: Rows of tallies that are kept before they are merged.
MERGE_ROWS = 1 << 18

TOKENS = pa.list_(pa.field("element", pa.string()))
IDS = pa.list_(pa.field("element", pa.int32()))


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def _ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``first[k] .. first[k] + counts[k] - 1`` for each k, one behind the other."""
    return np.repeat(first - _starts(counts)[:-1], counts) + np.arange(int(counts.sum()))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sums) of parts with rows of two numbers for each key."""
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    rows = np.concatenate([r for _, r in parts])
    order = np.argsort(place, kind="stable")
    starts = np.searchsorted(place[order], np.arange(len(keys)))
    return keys, np.add.reduceat(rows[order], starts) if len(keys) else rows


class Encoder:
    """Segmenter over (piece, id, score); an unknown character costs ``UNK_PENALTY`` more than the least likely piece."""

    def __init__(self, pieces: dict[str, tuple[int, float]], longest: int, unk_id: int = 0):
        kept = [p for p in pieces if len(p) <= longest]
        self.trie = Trie(kept)
        self.names = pa.array(kept, pa.string())
        self.ids = np.array([pieces[p][0] for p in kept], np.int32)
        self.unk_id = unk_id
        least = min((s for _, s in pieces.values()), default=0.0)
        self.score = np.array([*(pieces[p][1] for p in kept), least - UNK_PENALTY])

    def _segmented(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Where each unit's tokens begin, how many they are, the token numbers, and the unknown characters numbered behind the pieces."""
        lengths = np.array([len(u) for u in units], np.int64)
        order = np.argsort(lengths, kind="stable")  # texts of one length end together
        first, count = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        tokens, made, unknown = [np.empty(0, np.int32)], 0, {}
        for low, high in cut_blocks(lengths[order], LATTICE_CHARS):
            own = order[low:high]
            block, inner = Block.of([units[k] for k in own], self.trie, long_first=True)
            own = own[inner]
            count[own], edges = block.best_paths(self.score)
            first[own] = made + _starts(count[own])[:-1]
            piece = block.piece[edges].astype(np.int32)
            bad = np.nonzero(piece == self.trie.unknown)[0]
            if len(bad):
                texts = np.searchsorted(_starts(count[own]), bad, "right") - 1
                places = block.place[block.start[edges[bad]]]
                piece[bad] = [unknown.setdefault(units[own[t]][p], self.trie.unknown + len(unknown)) for t, p in zip(texts, places, strict=True)]
            tokens.append(piece)
            made += len(piece)
        return first, count, np.concatenate(tokens), list(unknown)

    def _put_together(self, tokens: np.ndarray, counts: np.ndarray, names: pa.Array, ids: np.ndarray) -> pa.Array:
        """Rows of ``counts`` tokens each; consecutive unknown characters form one token."""
        numbers = ids[tokens]
        unknown = numbers == self.unk_id
        if unknown.any():
            row = np.repeat(np.arange(len(counts)), counts)
            more = np.zeros(len(tokens), bool)
            more[1:] = unknown[1:] & unknown[:-1] & (row[1:] == row[:-1])
            if more.any():
                head = np.nonzero(~more)[0]
                sizes = np.diff(np.append(head, len(tokens)))
                joined: dict[str, int] = {}
                merged = tokens[head]
                for k in np.nonzero(sizes > 1)[0]:
                    text = "".join(names.take(pa.array(tokens[head[k] : head[k] + sizes[k]])).to_pylist())
                    merged[k] = joined.setdefault(text, len(names) + len(joined))
                names = pa.concat_arrays([names, pa.array(list(joined), pa.string())])
                tokens, numbers = merged, numbers[head]
                counts = np.bincount(row[head], minlength=len(counts))
        offsets = pa.array(_starts(counts).astype(np.int32))
        texts = pa.ListArray.from_arrays(offsets, names.take(pa.array(tokens)), type=TOKENS)
        return pa.StructArray.from_arrays([texts, pa.ListArray.from_arrays(offsets, pa.array(numbers), type=IDS)], names=["tokens", "ids"])

    def encoded(self, batches: Iterable[pa.ListArray]) -> Iterator[pa.Array]:
        """(tokens, ids) of rows of units; no units give no tokens.  What comes out is cut more finely than what goes in."""
        for batch in batches:
            sizes = np.asarray(batch.value_lengths().fill_null(0), np.int64)
            for low, high in cut_blocks(sizes, BATCH_UNITS):
                yield from self._encoded(batch[low:high], sizes[low:high])

    def _encoded(self, rows: pa.ListArray, sizes: np.ndarray) -> Iterator[pa.Array]:
        coded = rows.flatten().dictionary_encode()
        first, count, tokens, extra = self._segmented(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        names = pa.concat_arrays([self.names, pa.array(extra, pa.string())]) if extra else self.names
        ids = np.append(self.ids, np.full(len(extra), self.unk_id, np.int32))
        unit, begin = np.asarray(coded.indices), _starts(sizes)
        for low, high in cut_blocks(sizes, SLICE_UNITS):
            own = unit[begin[low] : begin[high]]
            some = count[own]
            counts = np.diff(_starts(some)[begin[low : high + 1] - begin[low]])
            yield self._put_together(tokens[_ranges(first[own], some)], counts, names, ids)

    def parts_at(self, mark: str) -> bool:
        """Whether no run of unknown characters goes across this character."""
        return mark in self.names.to_pylist() and not (self.ids == self.unk_id).any()

    def _weighted(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Encoded rows of the first column and how often each of them counts: as the second column has it, or once."""
        for batch in batches:
            often = np.asarray(batch.column(1)) if batch.num_columns > 1 else np.ones(batch.num_rows, np.int64)
            done = 0
            for part in self.encoded([batch.column(0)]):
                yield part, often[done : done + len(part)]
                done += len(part)

    def tallied(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, n, length) of all rows: how often each id is a token, and these tokens' characters."""
        parts, size, least = [(np.zeros(0, np.int32), np.zeros((0, 2), np.int64))], 0, MERGE_ROWS
        for part, often in self._weighted(batches):
            ids = np.asarray(part.field("ids").flatten())
            lengths = np.asarray(pc.utf8_length(part.field("tokens").flatten()))
            often = np.repeat(often, np.asarray(part.field("ids").value_lengths()))
            own, place = np.unique(ids, return_inverse=True)
            parts.append((own, np.stack([np.bincount(place, often, len(own)), np.bincount(place, often * lengths, len(own))], 1).astype(np.int64)))
            size += len(own)
            if size >= least:  # as much again as all tallies have: each is merged a few times, however many parts there are
                parts = [_merged(parts)]
                size, least = 0, max(MERGE_ROWS, len(parts[0][0]))
        keys, found = _merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(found[:, 0]), pa.array(found[:, 1])], names=["id", "n", "length"])
