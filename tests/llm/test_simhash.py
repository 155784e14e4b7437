import random
import re

import numpy as np
import xxhash

from corpusforge.llm.components import connected_components
from corpusforge.llm.simhash import fingerprint_of, group_links, near_duplicates, near_links


def brute_fingerprint(text, n=4):
    """Straight from the definition, one hash and one bit at a time."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + n]).encode(), 42) for k in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_of(fps, distance=4):
    """Smallest index reachable, over all pairs."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(fps))]


def planted(n, centers, seed):
    """Fingerprints in chains and clouds around a few centers, and some on their own."""
    draw = random.Random(seed)
    out = [draw.getrandbits(64) for _ in range(centers)]
    while len(out) < n:
        x = draw.choice(out) if draw.random() < 0.8 else draw.getrandbits(64)
        for _ in range(draw.randint(0, 6)):
            x ^= 1 << draw.randrange(64)
        out.append(x)
    return out


def test_fingerprints(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t in [*texts, None, "", " \n", "a", "A b", "a b c", "a b c d", "a b c d e", "É a\x0bb\x85c d\re f", "x " * 200000]:
        assert fingerprint_of(t) == brute_fingerprint(t)


def test_group_links_span_the_components_of_each_group():
    for n, centers, groups in ((1, 1, 1), (2, 1, 1), (64, 2, 1), (65, 2, 1), (300, 3, 1), (300, 4, 7)):
        fps = planted(n, centers, n)
        group = np.sort(np.random.default_rng(n).integers(0, groups, n))
        i, j = group_links(np.array(fps, np.uint64), group, np.zeros(n, int), 4)
        for g in range(groups):
            own = np.nonzero(group == g)[0].tolist()
            want = classes_of([fps[k] for k in own])
            root = {k: k for k in own}

            def find(x, root=root):
                while root[x] != x:
                    x = root[x]
                return x

            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                if group[a] == g:
                    assert group[b] == g and (fps[a] ^ fps[b]).bit_count() <= 4
                    x, y = find(a), find(b)
                    assert x != y  # no link is superfluous
                    root[max(x, y)] = min(x, y)
            assert [own.index(find(k)) for k in own] == want


def test_links_are_complete_with_and_without_crowded_keys(spark):
    fps = sorted(set(planted(700, 4, 11)))
    rows = [(k, x - (1 << 64) if x >> 63 else x) for k, x in enumerate(fps)]
    nodes = spark.createDataFrame(rows, "node long, fp long")
    want = classes_of(fps)
    for group in (4096, 40):
        found = dict(connected_components(spark, near_links(spark, nodes, group=group)).collect())
        assert [found.get(k, k) for k in range(len(fps))] == want


def test_near_duplicates_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out = near_duplicates(spark, docs).collect()
    texts = dict(docs.collect())
    ids = sorted(texts)
    fps = [fingerprint_of(texts[i]) for i in ids]
    want = {i: (f"{f:016x}", ids[c]) for i, f, c in zip(ids, fps, classes_of(fps), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out} == want
    assert len({c for _, c in want.values()}) < len(ids)


def test_edges(spark):
    rows = [(5, None, "x"), (3, "", "x"), (9, " \t", "x"), (4, "one two three four five", "x"), (4, "one two three four five", "x"), (None, "one two three four five", "x"), (8, "One TWO three four five", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumnRenamed("fp", "component_id")
    got = sorted((tuple(r) for r in near_duplicates(spark, docs).collect()), key=str)
    f = f"{brute_fingerprint('one two three four five'):016x}"
    zero = "0" * 16
    assert got == sorted([(5, zero, 3), (3, zero, 3), (9, zero, 3), (4, f, 4), (4, f, 4), (None, f, None), (8, f, 4)], key=str)
    assert near_duplicates(spark, docs.limit(0)).count() == 0
