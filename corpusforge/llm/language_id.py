"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows; in each window one network reads forwards and one
backwards, every position is labelled with a probability for each language from both states,
and the document's probabilities are the mean over all positions of all its windows.  Every
byte of a text is read, whatever its length.

The network is trained with numpy by backpropagation through time, on the driver, from a
bounded sample: at most ``SAMPLE`` documents of each language (those of least hash) with
``PER_DOCUMENT`` windows spread over the whole text of each.  Prediction runs in Arrow tasks over
blocks of windows, so memory does not grow with a text's length.

Null texts and texts without a letter are ``und`` with score 0, as is every text if there is
nothing to learn from.  Rows with a null id are not learned from and not held out; repeated
rows give their own rows; prediction adds columns to rows, with names that are not taken; an
empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Documents of each language that are learned from, windows of each, characters of a window before training cuts it.
SAMPLE, PER_DOCUMENT, WINDOW_CHARS = 300, 8, 128
#: Bytes of a window, hidden units of a direction, windows of a block.
WINDOW, HIDDEN, BLOCK = 128, 12, 2048
#: Training: windows of a step, their bytes, steps, step size.
BATCH, TRAIN_BYTES, STEPS, RATE = 192, 64, 260, 0.02
#: Bytes of text a task holds at a time.
SLICE_BYTES = 4 << 20
UNKNOWN = "und"


@dataclass
class Direction:
    """One gated recurrent network: input rows by byte (bias included), and recurrent weights; gates are z, r, then the candidate."""

    table: np.ndarray  # 256 x 3H
    gates: np.ndarray  # H x 2H
    candidate: np.ndarray  # H x H

    @classmethod
    def start(cls, rng, hidden: int) -> Direction:
        scale = 1 / np.sqrt(hidden)
        return cls(*(rng.normal(0, s, shape).astype(np.float32) for s, shape in ((0.3, (256, 3 * hidden)), (scale, (hidden, 2 * hidden)), (scale, (hidden, hidden)))))

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both gates, the candidate and the next state, from input rows and the state."""
        n = h.shape[1]
        g = h @ self.gates
        g += x[:, : 2 * n]
        g *= 0.5  # the logistic function by the hyperbolic tangent
        np.tanh(g, out=g)
        g *= 0.5
        g += 0.5
        c = (g[:, n:] * h) @ self.candidate
        c += x[:, 2 * n :]
        np.tanh(c, out=c)
        return g, c, c + g[:, :n] * (h - c)

    def states(self, bytes_: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """States after each step, for windows in columns (steps x windows)."""
        steps, n = bytes_.shape
        out = np.empty((steps, n, self.candidate.shape[0]), np.float32)
        h = np.zeros(out.shape[1:], np.float32)
        for t in range(steps):
            _, _, h = self.step(self.table[bytes_[t]], h)
            if mask is not None:
                h = h * mask[t][:, None]
            out[t] = h
        return out

    def gradients(self, bytes_: np.ndarray, d_states: np.ndarray) -> list[np.ndarray]:
        """Backpropagation through time of the loss's derivatives by the states."""
        steps, n = bytes_.shape
        size = self.candidate.shape[0]
        kept, h = [], np.zeros((n, size), np.float32)
        for t in range(steps):
            g, c, after = self.step(self.table[bytes_[t]], h)
            kept.append((h, g, c))
            h = after
        d_table, d_gates, d_candidate = (np.zeros_like(w) for w in (self.table, self.gates, self.candidate))
        d_h = np.zeros((n, size), np.float32)
        for t in reversed(range(steps)):
            h, g, c = kept[t]
            z, r = g[:, :size], g[:, size:]
            d = d_h + d_states[t]
            d_c = d * (1 - z) * (1 - c * c)
            d_rh = d_c @ self.candidate.T
            d_g = np.concatenate([d * (h - c) * z * (1 - z), d_rh * h * r * (1 - r)], axis=1)
            d_candidate += (r * h).T @ d_c
            d_gates += h.T @ d_g
            np.add.at(d_table, bytes_[t], np.concatenate([d_g, d_c], axis=1))
            d_h = d * z + d_rh * r + d_g @ self.gates.T
        return [d_table, d_gates, d_candidate]


@dataclass
class LanguageModel:
    languages: list[str]
    forward: Direction
    backward: Direction
    weights: np.ndarray  # 2H x languages
    bias: np.ndarray

    @classmethod
    def start(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> LanguageModel:
        rng = np.random.default_rng(seed)
        return cls(languages, Direction.start(rng, hidden), Direction.start(rng, hidden), rng.normal(0, 0.3, (2 * hidden, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [d_ for d in (self.forward, self.backward) for d_ in (d.table, d.gates, d.candidate)] + [self.weights, self.bias]

    def loss(self, bytes_: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over all positions of the windows (steps x windows), and its gradients."""
        steps, n = bytes_.shape
        turned = bytes_[::-1]
        states = np.concatenate([self.forward.states(bytes_), self.backward.states(turned)[::-1]], axis=2)
        logits = states @ self.weights + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        right = np.take_along_axis(p, np.broadcast_to(labels[None, :, None], (steps, n, 1)), axis=2)
        loss = float(-np.log(right + 1e-12).mean())
        p[:, np.arange(n), labels] -= 1
        p /= steps * n
        size = self.forward.candidate.shape[0]
        d_states = p @ self.weights.T
        grads = self.forward.gradients(bytes_, d_states[:, :, :size]) + self.backward.gradients(turned, d_states[::-1, :, size:])
        return loss, [*grads, states.reshape(-1, 2 * size).T @ p.reshape(-1, p.shape[2]), p.sum(axis=(0, 1))]

    def window_sums(self, bytes_: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Sum of the probabilities over the first ``length`` positions of each window (steps x windows)."""
        steps, n = bytes_.shape
        full = bool((length == steps).all())
        mask = None if full else (np.arange(steps)[:, None] < length[None, :]).astype(np.float32)
        size = self.forward.candidate.shape[0]
        ahead = self.forward.states(bytes_)
        total = np.zeros((n, len(self.languages)), np.float32)
        h = np.zeros((n, size), np.float32)
        to_f, to_b = self.weights[:size], self.weights[size:]
        for t in reversed(range(steps)):
            _, _, h = self.backward.step(self.backward.table[bytes_[t]], h)
            if mask is not None:
                h *= mask[t][:, None]
            logits = ahead[t] @ to_f
            logits += h @ to_b
            logits += self.bias
            logits -= logits.max(axis=1, keepdims=True)
            np.exp(logits, out=logits)
            scale = 1 / logits.sum(axis=1)
            logits *= (scale if mask is None else scale * mask[t])[:, None]
            total += logits
        return total

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all positions of each text (texts must not be empty)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        windows = -(-sizes // WINDOW)
        raw = b"".join([t + b"\0" * (-len(t) % WINDOW) for t in texts])
        rows = np.frombuffer(raw, np.uint8).reshape(-1, WINDOW)
        owner = np.repeat(np.arange(len(texts)), windows)
        length = np.full(len(rows), WINDOW)
        length[np.cumsum(windows) - 1] = sizes - (windows - 1) * WINDOW
        sums = np.empty((len(rows), len(self.languages)), np.float64)
        # whole windows first: they need no mask
        order = np.argsort(length != WINDOW, kind="stable")
        for at in range(0, len(rows), BLOCK):
            part = order[at : at + BLOCK]
            sums[part] = self.window_sums(np.ascontiguousarray(rows[part].T).astype(np.intp), length[part])
        total = np.zeros((len(texts), len(self.languages)))
        np.add.at(total, owner, sums)
        return total / sizes[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [k for k, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        if known:
            p = self.probabilities([texts[k].encode() for k in known])
            for k, best, value in zip(known, p.argmax(axis=1), p.max(axis=1), strict=True):
                names[k], scores[k] = self.languages[best], float(min(1.0, value))
        return names, scores


def train(windows: list[tuple[str, str]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 7) -> LanguageModel:
    """A model from (language, text) windows; each language gives the same share of every step's windows."""
    languages = sorted({lang for lang, _ in windows})
    model = LanguageModel.start(languages, hidden, seed)
    if len(languages) < 2:
        return model
    raw = {lang: [t.encode() for name, t in windows if name == lang] for lang in languages}
    rng = np.random.default_rng(seed)
    first = [np.zeros_like(p) for p in model.parameters()]
    second = [np.zeros_like(p) for p in model.parameters()]
    for step in range(1, steps + 1):
        labels = rng.integers(0, len(languages), BATCH)
        rows = np.full((BATCH, TRAIN_BYTES), 32, np.intp)
        for k, label in enumerate(labels):
            own = raw[languages[label]]
            text = own[rng.integers(len(own))]
            at = rng.integers(max(1, len(text) - TRAIN_BYTES + 1))
            cut = np.frombuffer(text[at : at + TRAIN_BYTES], np.uint8)
            rows[k, : len(cut)] = cut
        _, grads = model.loss(np.ascontiguousarray(rows.T), labels)
        rate = RATE * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for p, g, a, b in zip(model.parameters(), grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.005 * (g * g - b)
            p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.995**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """A model from the labelled documents that are not held out.

    Of each language the ``sample`` documents of least hash are taken.  Rows are first cut down by a hash
    bound that leaves a few times as many, so no language's rows are gathered in one task.
    """
    doc_id, text, label = (F.col(f"`{c}`") for c in (id_col, text_col, label_col))
    own = docs.where(doc_id.isNotNull() & ~held_out(doc_id) & label.isNotNull() & text.rlike(r"\p{L}"))
    own = own.select(label.cast("string").alias("label"), text.alias("text"), F.xxhash64(doc_id.cast("string"), F.lit("learn")).alias("h"), doc_id.cast("string").alias("id"))
    counts = own.groupBy("label").count().orderBy(F.desc("count"), "label").collect()  # one for each language, as the model
    if not counts:
        return LanguageModel.start([])
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["label"], min(1.0, 4.0 * sample / r["count"] + 64.0 / r["count"]))))
    place = (F.col("h") + F.lit(2.0**63)) / F.lit(2.0**64)
    cut = own.where(place < share[F.col("label")])
    w = Window.partitionBy("label").orderBy("h", "id", "text")
    n = F.length("text")
    starts = [F.expr(f"substring(text, cast(floor(length(text) * {k} / {PER_DOCUMENT}) as int) + 1, {WINDOW_CHARS})") for k in range(PER_DOCUMENT)]
    few = cut.withColumn("k", F.row_number().over(w)).where(F.col("k") <= sample).select("label", "k", F.when(n > 0, F.array(*starts)).alias("windows"))
    rows = few.orderBy("label", "k").collect()
    return train([(r["label"], t) for r in rows for t in r["windows"] if t])


def predicted(model: LanguageModel, text_col: str = "text") -> Column:
    """A struct ``lang, score`` for the text column."""


    def run(texts: pd.Series) -> pd.DataFrame:
        names: list[str] = []
        scores: list[float] = []
        held, size = [], 0
        for t in [*texts, ...]:
            if t is not ...:
                held.append(t)
                size += len(t) if t else 0
            if t is ... or size >= SLICE_BYTES:
                a, b = model.predict(held)
                names += a
                scores += b
                held, size = [], 0
        return pd.DataFrame({"lang": names, "score": scores})

    return pandas_udf(run, "lang string, score double")(F.col(f"`{text_col}`").cast("string"))
