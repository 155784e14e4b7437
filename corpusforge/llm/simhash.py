"""SimHash near-duplicates: exact links within a bit distance, by bit-sliced comparison inside key groups.

Fingerprints: a bit is 1 if it is set in over half of the 64-bit hashes of the text's word
shingles.  Equal fingerprints are aggregated first, so copies cost one row.

Candidates: the fingerprint is cut into ``BLOCKS`` blocks; of two fingerprints within the
distance d, at least ``BLOCKS - d`` blocks are equal.  A row is filed once under each choice of
that many blocks, so linked fingerprints share at least one key: the search is exact.

Comparison: the members of a key group are neighbours in a sorted partition.  Their bits are
stored vertically, one plane per bit, 64 fingerprints to a machine word.  Shifting the planes
by s lanes sets every fingerprint against the s-th one behind it; the differing bits of all
lanes go through carry-save adders into bitwise counters, and words whose lanes have all
passed the distance are dropped from the rest of the planes.  Only links that join two parts
of a group leave it, at most one fewer than the group has members.

A key with more than ``GROUP`` fingerprints is dealt out in parts, and each pair of parts is
compared on its own, so no task holds an unbounded group and no link is lost.  Components over
the links are found by ``components`` between the smallest ids of the fingerprints.

Null text and a text without words have the fingerprint zero, linked like any other; a text
with fewer words than a shingle is one shingle.  Rows with a null id keep a null component and
link nothing; repeated rows give their own rows.  Only the id and the text column are read, so
further columns cannot clash; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm.common import byte_slices, keyed_text, written
from corpusforge.llm.components import connected_components

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Widths of the blocks; the keys of ``len(BLOCKS) - DISTANCE`` of them have 21 or 22 bits.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Most fingerprints that are compared as one group.
GROUP = 4096
BATCH_BYTES = 4 << 20

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint_of(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    import xxhash

    words = _WORD.findall((text or "").encode().translate(_LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = list(itertools.accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends]
    digest = xxhash.xxh64_digest
    # the n-th shingle reaches from its first word's start to its last word's end
    raw = b"".join([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=False)])
    n = len(raw) // 8
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        bits += np.unpackbits(np.frombuffer(raw[8 * at : 8 * (at + 65536)], np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``_id, fp``: the 64 bits as a long, one row per row of ``docs``."""

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, 1, BATCH_BYTES):
                fp = np.array([fingerprint_of(t, shingle, seed) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], names=["_id", "fp"])

    slim = keyed_text(docs, id_col, text_col)
    return slim.mapInArrow(run, f"_id {slim.schema['_id'].dataType.simpleString()}, fp long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all fingerprints, 64 to a word, padded with zeros by one word."""
    lanes = (len(fps) + 63) // 64 * 64 + 64
    padded = np.zeros(lanes, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(lanes, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _words(mask: np.ndarray) -> np.ndarray:
    """A truth value per lane as words of 64 lanes."""
    padded = np.zeros((len(mask) + 63) // 64 * 64, np.uint8)
    padded[: len(mask)] = mask
    return np.packbits(padded, bitorder="little").view(np.uint64)


def _lanes(words: np.ndarray) -> np.ndarray:
    return np.nonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))[0]


def within(planes: np.ndarray, step: int, wanted: np.ndarray, distance: int) -> np.ndarray:
    """Of the ``wanted`` lanes (words), those that differ from the lane ``step`` behind in at most ``distance`` bits.

    Carry-save counters of three bits and a sticky overflow hold the differences so far; after every
    eight planes the words in which no wanted lane is left are dropped.
    """
    out = np.zeros_like(wanted)
    at = np.nonzero(wanted)[0]
    alive = wanted[at]
    skip, shift = divmod(step, 64)
    ones, twos, fours = (np.zeros(len(at), np.uint64) for _ in range(3))
    # words behind the last hold zeros: no wanted lane looks there
    last = planes.shape[1] - 1
    left, right = np.uint64(shift), np.uint64((64 - shift) % 64)
    for top in range(0, 64, 8):
        here, low = planes[top : top + 8, at], planes[top : top + 8, np.minimum(at + skip, last)]
        there = (low >> left) | (planes[top : top + 8, np.minimum(at + skip + 1, last)] << right) if shift else low
        x = here ^ there
        over = np.zeros(len(at), np.uint64)
        for a, b in ((x[0], x[1]), (x[2], x[3]), (x[4], x[5]), (x[6], x[7])):
            half = ones ^ a  # carry-save adder: ones + a + b
            carry = (ones & a) | (half & b)
            ones = half ^ b
            more = twos & carry
            twos ^= carry
            over |= fours & more
            fours ^= more
        alive &= ~(over | _beyond(ones, twos, fours, distance))
        if not alive.all():
            stay = alive != 0
            at, alive, ones, twos, fours = at[stay], alive[stay], ones[stay], twos[stay], fours[stay]
            if not len(at):
                return out
    out[at] = alive
    return out


def _beyond(ones, twos, fours, distance: int):
    """Lanes whose three-bit count is over ``distance``."""
    over = np.zeros_like(ones)
    equal = ~over
    for bit, word in ((4, fours), (2, twos), (1, ones)):
        if distance & bit:
            equal &= word
        else:
            over |= equal & word
            equal &= ~word
    return over


def group_links(fps: np.ndarray, group: np.ndarray, side: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked rows that join the parts of each run of equal ``group``; rows of one side other than 0 are not compared."""
    n = len(fps)
    planes = planes_of(fps)
    root = np.arange(n)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = 1
    while step < n:
        same = group[:-step] == group[step:]
        if not same.any():
            break
        wanted = same & ((side[:-step] == 0) | (side[:-step] != side[step:]))
        if wanted.any():
            i = _lanes(within(planes, step, _words(wanted), distance))
            j = i + step
            while len(i):
                a, b = root[i], root[j]
                apart = a != b
                i, j, a, b = i[apart], j[apart], a[apart], b[apart]
                if not len(i):
                    break
                # one link for each greater root; the others are looked at again under the new roots
                high, low = np.maximum(a, b), np.minimum(a, b)
                _, first = np.unique(high, return_index=True)
                found.append((i[first], j[first]))
                root[high[first]] = low[first]
                while True:
                    up = root[root]
                    if (up == root).all():
                        break
                    root = up
        step += 1
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _linked(distance: int):
    """Arrow function over partitions sorted by cell: links between the members of each cell."""

    def run(batches):
        held: list[pa.Table] = []

        def links(table: pa.Table):
            cell = table.column("cell").combine_chunks().dictionary_encode()
            cell = cell.combine_chunks() if isinstance(cell, pa.ChunkedArray) else cell
            group = np.asarray(cell.indices)
            fps = np.asarray(table.column("fp").combine_chunks()).view(np.uint64)
            i, j = group_links(fps, group, np.asarray(table.column("side").combine_chunks()), distance)
            node = table.column("node").combine_chunks()
            return pa.RecordBatch.from_arrays([node.take(pa.array(i)), node.take(pa.array(j))], names=["a", "b"])

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            table = pa.concat_tables(held)
            if table.num_rows < 8192:
                continue
            # the last cell may go on in the next batch
            last = table.column("cell")[table.num_rows - 1].as_py()
            cells = table.column("cell").to_pylist()
            cut = table.num_rows
            while cut and cells[cut - 1] == last:
                cut -= 1
            if cut:
                yield links(table.slice(0, cut))
            held = [table.slice(cut)]
        if held:
            table = pa.concat_tables(held)
            if table.num_rows:
                yield links(table)

    return run


def near_links(spark: SparkSession, rows: DataFrame, distance: int = DISTANCE, blocks: tuple[int, ...] = BLOCKS, group: int = GROUP) -> DataFrame:
    """``a, b``: links that span the components of ``rows(node, fp)``, each fp once, under the bit distance."""
    if not 0 < distance < min(len(blocks), 8) or sum(blocks) != 64:
        raise ValueError("the blocks must cover 64 bits, and be more than the distance, which is below 8")
    starts = list(itertools.accumulate([0, *blocks[:-1]]))
    keys = []
    for k, chosen in enumerate(itertools.combinations(range(len(blocks)), len(blocks) - distance)):
        key = F.lit(0).cast("long")
        for b in chosen:
            bits = F.shiftrightunsigned("fp", starts[b]).bitwiseAND(F.lit((1 << blocks[b]) - 1))
            key = F.shiftleft(key, blocks[b]).bitwiseOR(bits)
        keys.append(F.struct(F.lit(k).alias("choice"), key.alias("key")))
    filed = rows.select("node", "fp", F.explode(F.array(*keys)).alias("k")).select("node", "fp", "k.choice", "k.key")
    # keys with more than a group's fingerprints: at most one for each `group` rows
    crowded = filed.groupBy("choice", "key").count().where(F.col("count") > group)
    crowded = written(spark, crowded.select("choice", "key", F.ceil(F.col("count") * 2 / group).cast("int").alias("parts")))
    filed = filed.join(crowded, ["choice", "key"], "left")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # a row of part p meets the rows of part q in the cell of {p, q}
    pairs = F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = filed.select("node", "fp", "choice", "key", "parts", part.alias("part"), F.explode(pairs).alias("other"))
    cell = F.concat_ws(".", "choice", "key", F.least("part", "other"), F.greatest("part", "other"))
    # inside the cell of two different parts each part's own pairs are left to the part's own cell
    side = F.when(F.col("other") < 0, 0).when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2)
    cell = F.when(F.col("other") < 0, F.concat_ws(".", "choice", "key")).otherwise(cell)
    dealt = dealt.select("node", "fp", cell.alias("cell"), side.cast("int").alias("side"))
    ordered = dealt.repartition("cell").sortWithinPartitions("cell", "fp", "node")
    kind = rows.schema["node"].dataType.simpleString()
    return ordered.mapInArrow(_linked(distance), f"a {kind}, b {kind}").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``docs``: the id, fingerprint (16 hexadecimal digits), component_id (the smallest linked id)."""
    each = written(spark, fingerprints(docs, id_col, text_col, shingle))
    nodes = written(spark, each.where("_id is not null").groupBy("fp").agg(F.min("_id").alias("node")))
    classes = connected_components(spark, near_links(spark, nodes, distance))
    component = nodes.join(classes, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = each.join(written(spark, component), "fp", "left")
    return out.select(
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
