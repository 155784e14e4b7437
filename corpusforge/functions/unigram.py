"""Unigram-LM lattice helpers (Kudo, 2018) used inside Arrow-batched tasks:
Viterbi segmentation and forward-backward expected counts over one unit.

The piece table is a plain dict ``piece -> (id, score)`` shipped once per
executor through a broadcast variable; its size is bounded by the vocabulary
size the caller asked for.  Edges are found by walking a prefix set, so a
start position stops extending as soon as no piece begins that way.
"""

from __future__ import annotations

import math

NEG_INF = float("-inf")


def _lse(a: float, b: float) -> float:
    if a == NEG_INF:
        return b
    if b == NEG_INF:
        return a
    if a > b:
        return a + math.log1p(math.exp(b - a))
    return b + math.log1p(math.exp(a - b))


class Lattice:
    """Segmenter over a piece dict; an unknown character costs ``unk_score``."""

    def __init__(self, pieces: dict[str, tuple[int, float]], unk_id: int = 0, unk_penalty: float = 10.0,
                 max_len: int | None = None):
        self.pieces = pieces
        self.unk_id = unk_id
        scores = [s for _, s in pieces.values()]
        self.unk_score = (min(scores) if scores else 0.0) - unk_penalty
        longest = max((len(p) for p in pieces), default=1)
        self.max_len = min(max_len or longest, longest)
        prefixes: set[str] = set()
        for p in pieces:
            for k in range(1, len(p) + 1):
                prefixes.add(p[:k])
        self.prefixes = prefixes
        self._memo: dict[str, tuple[list[str], list[int]]] = {}

    def edges(self, w: str, exclude: str | None = None) -> list[list[tuple[int, str, int, float]]]:
        """For each end position, the (start, piece, id, score) edges ending there."""
        n = len(w)
        ends: list[list[tuple[int, str, int, float]]] = [[] for _ in range(n + 1)]
        get = self.pieces.get
        pre = self.prefixes
        ml = self.max_len
        for s in range(n):
            ch = w[s]
            if ch not in self.pieces or ch == exclude:
                # an unknown single character is always a way through
                ends[s + 1].append((s, ch, self.unk_id, self.unk_score))
            if ch not in pre:
                continue
            stop = min(n, s + ml)
            for e in range(s + 1, stop + 1):
                sub = w[s:e]
                if sub not in pre:
                    break
                hit = get(sub)
                if hit is not None and sub != exclude:
                    ends[e].append((s, sub, hit[0], hit[1]))
        return ends

    def _best(self, w: str, ends) -> tuple[list[str], list[int], float]:
        n = len(w)
        best = [NEG_INF] * (n + 1)
        back: list[tuple[int, str, int]] = [(0, "", 0)] * (n + 1)
        best[0] = 0.0
        for e in range(1, n + 1):
            be = NEG_INF
            for s, p, pid, sc in ends[e]:
                v = best[s] + sc
                if v > be:
                    be = v
                    back[e] = (s, p, pid)
            best[e] = be
        toks, ids = [], []
        e = n
        while e > 0:
            s, p, pid = back[e]
            toks.append(p)
            ids.append(pid)
            e = s
        toks.reverse()
        ids.reverse()
        return toks, ids, best[n]

    def viterbi(self, w: str, exclude: str | None = None) -> tuple[list[str], list[int], float]:
        """Best segmentation; ``exclude`` removes one piece from the table for this call."""
        return self._best(w, self.edges(w, exclude))

    def encode_word(self, w: str) -> tuple[list[str], list[int]]:
        hit = self._memo.get(w)
        if hit is None:
            toks, ids, _ = self.viterbi(w)
            hit = (toks, ids)
            if len(self._memo) < 200_000:
                self._memo[w] = hit
        return hit

    def expected_counts(self, w: str, weight: float, acc: dict[str, list[float]], viterbi: bool = True) -> float:
        """Add weight * E[count(piece)] (and, with ``viterbi``, the best-path counts) to ``acc``;
        return weight * log Z."""
        n = len(w)
        if n == 0:
            return 0.0
        ends = self.edges(w)
        alpha = [NEG_INF] * (n + 1)
        alpha[0] = 0.0
        for e in range(1, n + 1):
            a = NEG_INF
            for s, _p, _pid, sc in ends[e]:
                a = _lse(a, alpha[s] + sc)
            alpha[e] = a
        beta = [NEG_INF] * (n + 1)
        beta[n] = 0.0
        for e in range(n, 0, -1):
            be = beta[e]
            if be == NEG_INF:
                continue
            for s, _p, _pid, sc in ends[e]:
                beta[s] = _lse(beta[s], be + sc)
        z = alpha[n]
        if z == NEG_INF:
            return 0.0
        pieces = self.pieces
        for e in range(1, n + 1):
            be = beta[e] - z
            for s, p, _pid, sc in ends[e]:
                if p not in pieces:
                    continue
                post = weight * math.exp(alpha[s] + sc + be)
                slot = acc.get(p)
                if slot is None:
                    acc[p] = [post, 0.0]
                else:
                    slot[0] += post
        if not viterbi:
            return weight * z
        toks, _ids, _ = self._best(w, ends)
        for t in toks:
            slot = acc.get(t)
            if slot is not None:
                slot[1] += weight
        return weight * z
