"""Unigram-LM learning (Kudo, 2018) on a table of units with counts, as Spark jobs (M2).

Seeds: the suffixes of all units, up to the longest piece, are aggregated, range-sorted and read in
order: a sorted table of suffixes is a suffix array whose neighbours' common prefixes give every
repeated substring with its count.  A substring that the same character always follows is left out, as its
extension occurs as often.  Each batch of the sorted table is worked on alone; the prefixes of its first and
last suffix, whose count may go on in other batches, are summed and judged by a join.

Expectation: a piece trie in flat arrays is walked from all positions of a batch of units at once, and the
edges found (start, end, piece) are kept as a lattice table of packed blocks, made once and reduced whenever
two thirds of its pieces are gone.  A pass computes the edges' shares of whole blocks, end position by end
position, in numpy, and deals the texts' weights out by them from the ends back; expected and best-path counts are
merged by a group-by.  What a piece is
replaced by when it goes is a pass over the lattices of the pieces themselves.

The driver holds the piece table, at most ``SEED_SIZE`` pieces and the characters, as arrays: it is the model,
which every task needs.
"""

from __future__ import annotations

import logging
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.student_t import digamma

log = logging.getLogger(__name__)

#: Candidate pieces that learning starts from, as many as the library takes; the same bound for every vocabulary size.
SEED_SIZE = 1_000_000
#: Pieces expected less often than this go after an expectation step (characters stay).
MIN_EXPECTED = 0.5
#: Part of the pieces that a pruning keeps; the library keeps more, which costs rounds and gains nothing measurable here.
SHRINK = 0.5
#: Cost of an unknown character below the least likely piece, in nats.
UNK_PENALTY = 10.0
#: Characters of a block of units.
BLOCK_CHARS = 1 << 17

_POINT = 21  # bits of a code point


# ------------------------------------------------------------------ seeds
def _repeated_prefixes(batches):
    """Batches of sorted distinct suffixes with counts -> (piece, f, border)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        texts = batch.column(0).to_numpy(zero_copy_only=False).tolist()
        weight = np.concatenate([[0.0], np.cumsum(np.asarray(batch.column(1), dtype=float))])
        length = np.array([len(t) for t in texts])
        codes = np.array(texts, dtype=f"U{length.max()}").view(np.uint32).reshape(n, -1).T.copy()
        # characters that a suffix shares with the next one
        shared, both, pair = np.zeros(n - 1, int), np.minimum(length[1:], length[:-1]), np.arange(n - 1)
        for k, at in enumerate(codes):
            pair = pair[(at[pair] == at[pair + 1]) & (both[pair] > k)]
            if not len(pair):
                break
            shared[pair] = k + 1
        # a suffix that shares less with its neighbours: it occurs as often as it ends here
        beside = np.maximum(np.append(shared, 0), np.append(0, shared))
        alone = np.nonzero((beside < length) & (weight[1:] - weight[:-1] >= 2))[0]
        alone = alone[(alone > 0) & (alone < n - 1)]
        pieces = [texts[r] for r in alone]
        counts = (weight[alone + 1] - weight[alone]).tolist()
        border = [False] * len(alone)
        for r in {0, n - 1}:  # prefixes of the first and of the last that no neighbour has
            for k in range(beside[r] + 1, length[r] + 1):
                pieces.append(texts[r][:k])
                counts.append(weight[r + 1] - weight[r])
                border.append(True)
        pair, k = np.nonzero(shared > 0)[0], 1  # suffixes that share k characters with the next one
        while len(pair):
            run = np.concatenate([[0], np.nonzero(np.diff(pair) != 1)[0] + 1])
            start, stop = pair[run], pair[np.append(run[1:], len(pair)) - 1] + 2
            f = weight[stop] - weight[start]
            # right-maximal: two suffixes part here, or the first one ends here
            maximal = (np.minimum.reduceat(shared[pair], run) == k) | (length[start] == k)
            edge = (start == 0) | (stop == n)
            out = np.nonzero(edge | maximal & (f >= 2))[0]
            pieces += [texts[r][:k] for r in start[out].tolist()]
            counts += f[out].tolist()
            border += edge[out].tolist()
            pair = pair[shared[pair] > k]
            k += 1
        yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), pa.array(counts, pa.float64()), pa.array(border, pa.bool_())], names=["piece", "f", "border"])


def repeated_substrings(counts: DataFrame, longest: int, partitions: int) -> DataFrame:
    """(piece, f): right-maximal substrings of the units (unit, c), up to ``longest`` characters, with a count of two or more."""
    starts = F.explode(F.sequence(F.lit(1), F.length("unit")))
    suffixes = counts.where(F.length("unit") > 0).select("unit", "c", starts.alias("i")).select(F.substring("unit", F.col("i"), longest).alias("s"), "c")
    ranked = suffixes.groupBy("s").agg(F.sum("c").alias("c")).repartitionByRange(partitions, "s").sortWithinPartitions("s")
    found = ranked.mapInArrow(_repeated_prefixes, "piece string, f double, border boolean").checkpoint(eager=True)
    # prefixes at the ends of batches: whole counts, and whether an extension occurs as often
    ends = found.where("border").groupBy("piece").agg(F.sum("f").alias("f"))
    longer = ends.where(F.length("piece") > 1).select(F.substring("piece", F.lit(1), F.length("piece") - 1).alias("piece"), F.col("f").alias("longer"))
    longer = longer.groupBy("piece").agg(F.max("longer").alias("longer"))
    ends = ends.join(longer, "piece", "left").where((F.col("f") >= 2) & (F.coalesce("longer", F.lit(0.0)) < F.col("f"))).select("piece", "f")
    return found.where("not border").select("piece", "f").unionByName(ends)


# ------------------------------------------------------------------ lattices
class Trie:
    """Pieces as sorted keys (parent node, character) with the piece at each node; node 0 is the root."""

    def __init__(self, pieces: list[str]):
        n = len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        state = np.zeros(n, np.int64)
        levels, piece, size = [], [np.array([-1], np.int32)], 0
        live = np.arange(n)
        depth = 0
        while len(live):
            live = live[lengths[live] > depth]
            keys, own = np.unique((state[live] << _POINT) | codes[first[live] + depth], return_inverse=True)
            state[live] = size + 1 + own
            at = np.full(len(keys), -1, np.int32)
            ends = lengths[live] == depth + 1
            at[own[ends]] = live[ends]
            levels.append(keys)
            piece.append(at)
            size += len(keys)
            depth += 1
        # parents are numbered level by level, so the keys are sorted as a whole
        self.keys, self.piece, self.longest = np.concatenate([*levels, [np.iinfo(np.int64).max]]), np.concatenate(piece), depth - 1
        self.unknown = n

    def edges(self, codes: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of all pieces in a row of texts; ``stops`` has the end of the text around each position."""
        at = np.arange(len(codes))
        state = np.zeros(len(codes), np.int64)
        single = np.zeros(len(codes), bool)
        out = []
        for k in range(self.longest):
            inside = at + k < stops[at]
            at, state = at[inside], state[inside]
            key = (state << _POINT) | codes[at + k]
            place = np.searchsorted(self.keys, key)
            known = self.keys[place] == key
            at, state = at[known], place[known] + 1
            if not len(at):
                break
            p = self.piece[state]
            hit = p >= 0
            if k == 0:
                single[at[hit]] = True
            out.append((at[hit], np.full(hit.sum(), k + 1), p[hit]))
        none = np.nonzero(~single)[0]  # an unknown character is always a way through
        out.append((none, np.ones(len(none), np.int64), np.full(len(none), self.unknown, np.int32)))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class Block:
    """Lattices of some texts, longest first: a slot before each character and behind the last, numbered place by place.

    An edge is a piece and its length; edges are in order of the slot they end at, ``count`` for each slot.
    """

    def __init__(self, lengths: np.ndarray, count: np.ndarray, width: np.ndarray, piece: np.ndarray):
        self.lengths, self.count, self.width, self.piece = lengths, count, width, piece
        longest = int(lengths.max(initial=0))
        # texts that reach each place, and the first slot of each place
        reach = len(lengths) - np.searchsorted(lengths[::-1], np.arange(longest + 1))
        self.first = np.concatenate([[0], np.cumsum(reach)])
        self.place = np.repeat(np.arange(longest + 1), reach)
        slots = np.arange(self.first[-1])
        self.text = slots - self.first[self.place]
        self.stop = np.repeat(slots, count)
        self.start = self.first[self.place[self.stop] - width] + self.text[self.stop]
        self.last = self.first[lengths] + np.arange(len(lengths))

    @staticmethod
    def of(texts: list[str], trie: Trie, whole: bool = True, long_first: bool = False) -> tuple[Block, np.ndarray]:
        """The block and the order of its texts; ``whole`` false leaves out the piece that is a whole text itself.

        ``best`` takes the first of equal edges: the longest with ``long_first``, else the shortest.
        """
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        codes = np.frombuffer("".join([texts[k] for k in order]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), lengths)
        begin = np.cumsum(lengths) - lengths
        at, width, piece = trie.edges(codes, (begin + lengths)[owner])
        if not whole:
            part = (width < lengths[owner[at]]) | (piece == trie.unknown)
            at, width, piece = at[part], width[part], piece[part]
        reach = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths.max(initial=0) + 1))
        first = np.concatenate([[0], np.cumsum(reach)])
        text = owner[at]
        stop = first[at - begin[text] + width] + text
        by_stop = np.argsort(stop * (trie.longest + 2) - width if long_first else stop, kind="stable")
        b = Block(lengths, np.bincount(stop, minlength=first[-1]), width[by_stop], piece[by_stop])
        return b, order

    def best_paths(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many edges the best path of each text has, and these edges, text by text."""
        _, back = self.best(score)
        at = self.last[self.lengths > 0]
        steps = [np.empty(0, np.int64)]
        while len(at):
            edge = back[at]
            steps.append(edge)
            at = self.start[edge]
            at = at[self.place[at] > 0]
        texts = [self.text[self.stop[edge]] for edge in steps]
        count = np.bincount(np.concatenate(texts), minlength=len(self.lengths))
        ends = np.cumsum(count)
        out = np.empty(int(count.sum()), np.int64)
        for k, (own, edge) in enumerate(zip(texts[1:], steps[1:], strict=True), 1):
            out[ends[own] - k] = edge
        return count, out

    def packed(self) -> list[bytes]:
        # no more edges end at a slot than a piece has characters; piece numbers take two bytes where they fit
        number = np.uint16 if self.piece.max(initial=0) < 1 << 16 else np.int32
        return [self.lengths.astype(np.int32).tobytes(), self.count.astype(np.uint8).tobytes(), self.width.astype(np.uint8).tobytes(), self.piece.astype(number).tobytes()]

    @staticmethod
    def unpacked(raw: list[bytes]) -> Block:
        number = np.uint16 if len(raw[3]) == 2 * len(raw[2]) else np.int32
        lengths, count, width, piece = (np.frombuffer(x, t) for x, t in zip(raw, (np.int32, np.uint8, np.uint8, number), strict=True))
        return Block(lengths.astype(np.int64), count, width, piece)

    @staticmethod
    def reduced(raw: list[bytes], number: np.ndarray) -> list[bytes]:
        """A packed block with pieces numbered anew, without the edges of pieces that have no number (-1)."""
        known = np.uint16 if len(raw[3]) == 2 * len(raw[2]) else np.int32
        count, width, piece = (np.frombuffer(x, t) for x, t in zip(raw[1:], (np.uint8, np.uint8, known), strict=True))
        piece = number[piece]
        kept = piece >= 0
        before = np.concatenate([[0], np.cumsum(kept)])
        ends = np.cumsum(count, dtype=np.int64)
        count = before[ends] - before[ends - count]
        piece = piece[kept]
        small = np.uint16 if piece.max(initial=0) < 1 << 16 else np.int32
        return [raw[0], count.astype(np.uint8).tobytes(), width[kept].tobytes(), piece.astype(small).tobytes()]

    def _levels(self):
        """Edges that end at one place, place by place: their range, the slots, and where each slot's edges begin and how many they are."""
        at = np.nonzero(self.count)[0]
        if not len(at):
            return
        ends = np.cumsum(self.count, dtype=np.int64)[at]
        size = self.count[at].astype(np.int64)
        place = self.place[at]
        cut = np.concatenate([[0], np.nonzero(place[1:] != place[:-1])[0] + 1, [len(at)]])
        for low, high in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            first = ends[low] - size[low]
            yield first, ends[high - 1], at[low:high], ends[low:high] - size[low:high] - first, size[low:high]

    def shares(self, score: np.ndarray) -> np.ndarray:
        """Part of the ways to its end that each edge has, all pieces weighed by their scores."""
        alpha = np.full(self.first[-1], -np.inf)
        alpha[: len(self.lengths)] = 0
        share = score[self.piece]
        for a, b, at, run, size in self._levels():
            v = share[a:b]
            v += alpha[self.start[a:b]]
            top = np.maximum.reduceat(v, run)
            v -= np.repeat(top, size)
            np.exp(v, out=v)
            total = np.add.reduceat(v, run)
            v /= np.repeat(total, size)
            alpha[at] = top + np.log(total)
        return share

    def best(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best score up to each slot, and the edge that it comes by."""
        top = np.full(self.first[-1], -np.inf)
        top[: len(self.lengths)] = 0
        back = np.full(self.first[-1], -1, np.int64)
        for a, b, at, run, size in self._levels():
            v = top[self.start[a:b]] + score[self.piece[a:b]]
            most = np.maximum.reduceat(v, run)
            hits = np.nonzero(v == np.repeat(most, size))[0]
            back[at] = hits[np.searchsorted(hits, run)] + a
            top[at] = most
        return top, back

    def expected(self, score: np.ndarray, weight: np.ndarray, pieces: int) -> np.ndarray:
        """A text's weight goes back from its end, by every edge its share; what an edge gets is its expected count."""
        flow = self.shares(score)
        due = np.zeros(self.first[-1])
        due[self.last] = weight
        for a, b, at, _, size in reversed([*self._levels()]):
            v = flow[a:b]
            v *= np.repeat(due[at], size)
            due[self.start[a:b]] += v  # edges to one place and from one slot are of different texts: no slot comes twice
        return np.bincount(self.piece, flow, pieces + 1)[:pieces]

    def best_counts(self, score: np.ndarray, weight: np.ndarray, pieces: int) -> np.ndarray:
        _, back = self.best(score)
        at = self.last[self.lengths > 0]
        weight = weight[self.lengths > 0]
        out = np.zeros(pieces + 1)
        while len(at):
            edge = back[at]
            out += np.bincount(self.piece[edge], weight, pieces + 1)
            at = self.start[edge]
            inside = self.place[at] > 0
            at, weight = at[inside], weight[inside]
        return out[:pieces]


_PACKED = "lengths binary, count binary, width binary, piece binary"


def cut_blocks(lengths: np.ndarray, size: int = BLOCK_CHARS):
    """Ranges of texts of about ``size`` characters."""
    ends = np.cumsum(lengths)
    low = 0
    while low < len(lengths):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + size, "right")))
        yield low, high
        low = high


def _lattice_rows(trie):
    def run(batches):
        for batch in batches:
            texts, weight = batch.column(0).to_numpy(zero_copy_only=False).tolist(), np.asarray(batch.column(1), dtype=float)
            for low, high in cut_blocks(np.array([len(t) for t in texts], np.int64)):
                block, order = Block.of(texts[low:high], trie.value)
                columns = [*block.packed(), weight[low:high][order].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=["lengths", "count", "width", "piece", "weight"])

    return run


def _reduced_rows(number):
    def run(batches):
        for batch in batches:
            for *raw, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                columns = [*Block.reduced(raw, number.value), weight]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=["lengths", "count", "width", "piece", "weight"])

    return run


def _piece_rows(trie, pieces):
    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0))
            own = [pieces.value[k] for k in ids]
            for low, high in cut_blocks(np.array([len(t) for t in own], np.int64)):
                block, order = Block.of(own[low:high], trie.value, whole=False)
                columns = [*block.packed(), ids[low:high][order].astype(np.int64).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=["lengths", "count", "width", "piece", "id"])

    return run


def _blocks(batches):
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield Block.unpacked(row[:4]), row[4]


def _count_rows(score, best: bool):
    def run(batches):
        n = len(score.value) - 1
        expected, found = np.zeros(n), np.zeros(n)
        for block, weight in _blocks(batches):
            weight = np.frombuffer(weight, np.float64)
            expected += block.expected(score.value, weight, n)
            if best:
                found += block.best_counts(score.value, weight, n)
        ids = np.nonzero((expected > 0) | (found > 0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(expected[ids]), pa.array(found[ids])], names=["id", "expected", "best"])

    return run


def _instead_rows(score):
    """Best score of each piece's text without the piece itself."""

    def run(batches):
        for block, ids in _blocks(batches):
            top, _ = block.best(score.value)
            ids = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(top[block.last])], names=["id", "instead"])

    return run


# ------------------------------------------------------------------ learning
def _arrays(df: DataFrame) -> dict[str, np.ndarray]:
    table = df.toArrow().combine_chunks()
    return {c: np.asarray(table.column(c)) for c in table.column_names}


def learn_pieces(counts: DataFrame, seeds: list[tuple[str, float]], chars: list[tuple[str, float]], size: int, em_iters: int, max_rounds: int, tasks: int) -> list[tuple[str, float]]:
    """(piece, score) of at most ``size`` pieces, from (unit, c), seed pieces and the characters that always stay."""
    spark = counts.sparkSession
    sc = spark.sparkContext
    began = time.perf_counter()
    freq = {**dict(seeds), **dict(chars)}
    pieces = list(freq)
    score = np.log(np.array([freq[p] for p in pieces]))
    score -= np.log(sum(freq.values()))
    known = {c for c, _ in chars}
    stays = np.array([p in known for p in pieces])
    lattice = of_pieces = None
    built = 0
    best = np.zeros(len(pieces))

    for round_ in range(max_rounds):
        for step in range(em_iters):
            if lattice is None or len(pieces) <= built // 3:
                old = (lattice, of_pieces)
                trie, names = sc.broadcast(Trie(pieces)), sc.broadcast(pieces)
                if lattice is None:
                    lattice = counts.select("unit", "c").mapInArrow(_lattice_rows(trie), f"{_PACKED}, weight binary").checkpoint(eager=True)
                else:
                    number = np.full(built + 1, -1, np.int32)
                    number[place] = np.arange(len(pieces))
                    number[built] = len(pieces)  # the unknown character
                    number = sc.broadcast(number)
                    lattice = lattice.mapInArrow(_reduced_rows(number), f"{_PACKED}, weight binary").checkpoint(eager=True)
                    number.unpersist()
                of_pieces = spark.range(0, len(pieces), 1, tasks).mapInArrow(_piece_rows(trie, names), f"{_PACKED}, id binary").checkpoint(eager=True)
                for df in old:
                    if df is not None:
                        df.unpersist()
                built, place = len(pieces), np.arange(len(pieces))
                trie.unpersist()
                names.unpersist()
                log.info("lattices of %d pieces at %.1fs", built, time.perf_counter() - began)
            # scores by the lattice's piece numbers; pieces that are gone cannot be taken
            full = np.full(built, -np.inf)
            full[place] = score
            bc = sc.broadcast(np.append(full, score.min() - UNK_PENALTY))
            # best-path counts feed only the pruning: they are made on the last step
            found = _arrays(lattice.mapInArrow(_count_rows(bc, step == em_iters - 1), "id int, expected double, best double").groupBy("id").agg(F.sum("expected").alias("expected"), F.sum("best").alias("best")))
            bc.unpersist()
            expected, both = np.zeros(built), np.zeros(built)
            expected[found["id"]], both[found["id"]] = found["expected"], found["best"]
            expected, best = expected[place], both[place]
            # Bayesian M-step: score = digamma(count) - digamma(total); characters that are not expected come last
            often = expected >= MIN_EXPECTED
            total = digamma(max(expected[often].sum(), 1.0))[0]
            score = np.where(often, digamma(np.maximum(expected, MIN_EXPECTED)) - total, 0.0)
            score[~often] = (score[often].min() if often.any() else -30.0) - 1.0
            keep = often | stays
            pieces, score, stays, best, place = [p for p, k in zip(pieces, keep, strict=True) if k], score[keep], stays[keep], best[keep], place[keep]
            log.info("round %d: %d pieces at %.1fs", round_, len(pieces), time.perf_counter() - began)
        if len(pieces) <= size:
            break
        if round_ == max_rounds - 1:
            raise RuntimeError(f"{max_rounds} prunings left {len(pieces)} pieces of {size} wanted")
        full = np.full(built, -np.inf)
        full[place] = score
        bc = sc.broadcast(np.append(full, score.min() - UNK_PENALTY))
        found = _arrays(of_pieces.mapInArrow(_instead_rows(bc), "id int, instead double"))
        bc.unpersist()
        instead = np.full(built, -np.inf)
        instead[found["id"]] = found["instead"]
        other = instead[place]
        loss = np.where(np.isfinite(other), best * (score - np.where(np.isfinite(other), other, 0.0)), np.inf)
        # characters always stay; the rest compete for the remaining places
        left = max(size, int(len(pieces) * SHRINK)) - int(stays.sum())
        others = np.nonzero(~stays)[0]
        ranked = sorted(others, key=lambda k: (-loss[k], pieces[k]))[: max(0, left)]
        keep = np.sort(np.concatenate([np.nonzero(stays)[0], np.array(ranked, int)]))
        pieces, score, stays, place = [pieces[k] for k in keep], score[keep], stays[keep], place[keep]
        best = best[keep]
    return list(zip(pieces, score.tolist(), strict=True))
