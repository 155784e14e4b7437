"""Personal data by base patterns and a semi-Markov conditional random field.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; what they find
stays.  The field looks for further spans of the same kinds that the patterns miss (written
without a plus, with other separators, with the sign spelled out).  It scores whole candidate
spans: the features of a span are its shape, its groups of digits, its separators, its sums
and what stands beside it.  Dynamic programming over spans of at most ``LONGEST`` tokens picks
boundaries and kinds together; a token outside all spans is a segment of its own.  A sign that is
spelled out is one token with its brackets and the spaces beside it, and an address of more
tokens, however many names and host labels it has, is a candidate as a whole.

The field is trained with numpy on the driver from at most ``SAMPLE`` documents (those of least
hash among the texts that hold a digit or an at sign) and at most ``PER_DOCUMENT`` places of each;
base spans are the labels, and rewritten copies of them, in forms the patterns do not know,
teach what else a span may look like; none is left out for its length.  Forms that patterns refuse (a card number that fails its
check sum, numbers and hexadecimal strings) are its counter-examples.

A candidate holds a digit or an at sign, written out or not, so only the neighbourhoods of
these are looked at, and the result is that of the whole text.  Texts are handled one at a time
inside Arrow tasks; time and memory are linear in a text's length.

Null and empty texts have no spans.  Rows with null ids and repeated rows give their own rows;
masking and detection add columns with names that are not taken; an empty table gives an empty
table.
"""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

KINDS = ("email", "ip", "card", "phone")
#: Documents that are learned from, and places of each.
SAMPLE, PER_DOCUMENT = 150, 6
#: Most tokens of a candidate other than a whole address.
LONGEST = 20
#: Training steps, step size, and pull towards zero.
STEPS, RATE, DECAY = 50, 0.3, 1e-3
#: How much more a span must score than no span.
MARGIN = 1.0

Span = tuple[str, int, int]

# fixed values: the base patterns; the classes are ASCII only
_AT = re.compile(r"@")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """What the patterns find, leftmost and non-overlapping for each kind, by kind and start."""
    out: list[Span] = []
    if "@" in text:
        free = 0  # where the last match ended
        for m in _AT.finditer(text):
            at = m.start()
            if at < free:
                continue
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            found = _DOMAIN.match(text, at) if start < at else None
            if found:
                out.append(("email", start, found.end()))
                free = found.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def shown(spans: list[Span]) -> str:
    """kind:start:end by kind as listed, then start, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


# a place: words with a trigger and the word on either side, within a line
_TRIGGER = re.compile(r"[0-9@]|[\[({<](?:at|dot)[\])}>]", re.IGNORECASE)
_BREAK = re.compile(r"[ \n]")
_TOKEN = re.compile(r" ?[\[({<](?:at|dot)[\])}>] ?|[^\W\d_]+|[0-9]+|\s|.", re.DOTALL | re.IGNORECASE)
# an address with its signs written out or not, as long as it goes on
_SIGN = r"[\[({<]%s[\])}>]"
_DOT = rf"(?:\.| ?{_SIGN % 'dot'} ?)"
_ADDRESS = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|{_SIGN % 'at'}) ?[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)+", re.IGNORECASE | re.ASCII)


def places(text: str) -> list[tuple[int, int]]:
    """Neighbourhoods of all triggers: runs of words with one, and the word before and behind, in order, apart."""
    out: list[list[int]] = []
    start = end = 0  # the last word with a trigger: nothing before it is searched again
    for m in _TRIGGER.finditer(text):
        if out and m.start() < end:
            continue
        before = max(text.rfind(" ", end, m.start()), text.rfind("\n", end, m.start()))
        last, start = start, before + 1 if before >= 0 else 0
        stop = _BREAK.search(text, m.end())
        end = stop.start() if stop else len(text)
        # the word before, and the word behind
        left = max(text.rfind(" ", last, max(start - 1, 0)), text.rfind("\n", last, max(start - 1, 0))) + 1 or last
        stop = _BREAK.search(text, end + 1)
        right = stop.start() if stop else len(text)
        if out and left <= out[-1][1]:
            out[-1][1] = right
        else:
            out.append([left, right])
    return [(a, b) for a, b in out]


def _bucket(n: int, *edges: int) -> int:
    return sum(n >= e for e in edges)


def features(text: str, start: int, end: int) -> list[str] | None:
    """Whole-span features of a candidate; None if it cannot be a span."""
    s = text[start:end]
    low = s.lower()
    digits = [c for c in s if "0" <= c <= "9"]
    at = "@" in s or re.search(r"[\[({<]at[\])}>]", low) is not None
    if not at and len(digits) < 4 or s[0] in " \n\t.,;:-)" or s[-1] in " \n\t(+[{<":
        return None
    if s[-1] in ".,;:!?-'\"" or s[0] in "'\"":
        return None
    before, behind = text[start - 1 : start], text[end : end + 1]
    out = [f"at{at}", f"digits{_bucket(len(digits), 1, 4, 7, 9, 10, 11, 13, 16, 17, 20)}"]
    out.append(f"cut{before.isalnum() or before in '@.+-_' and before != ''}{behind.isalnum() or behind in '@-_' and behind != ''}")
    letters = sum(c.isalpha() for c in s)
    out.append(f"letters{_bucket(letters, 1, 4, 12)}{at}")
    if at:
        host = re.split(r"@|[\[({<]at[\])}>]", low)[-1]
        dots = host.count(".") + len(re.findall(r"[\[({<]dot[\])}>]", host))
        name = re.split(r"@|[\[({<]at[\])}>]", low)[0]
        out += [f"host{_bucket(dots, 1, 2, 4)}", f"hostend{host[-1:].isalpha()}", f"name{bool(name.strip())}{' ' in name.strip()}", f"ats{_bucket(low.count('@') + len(re.findall(r'[(<{[]at[])}>]', low)), 1, 2)}", f"hostspace{bool(re.search(r'[a-z0-9] [a-z0-9]', host.strip()))}"]
        return out
    groups = re.findall(r"[0-9]+", s)
    marks = "".join(sorted(set(re.sub(r"[0-9A-Za-z]", "", s))))
    sizes = [len(g) for g in groups]
    out.append(f"marks{marks}" if len(marks) < 4 else "marks*")
    out.append(f"groups{_bucket(len(groups), 1, 2, 3, 4, 5, 6)}")
    out.append(f"sizes{'.'.join(map(str, sizes))}" if len(sizes) < 6 and max(sizes) < 6 else f"size{_bucket(max(sizes), 6, 9, 13, 17)}")
    octets = len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups)
    out.append(f"octets{octets}{len(marks) == 1}")
    # a chance digit string passes the sum in one case out of ten, so it counts only with a card's number of digits
    card = 13 <= len(digits) <= 19
    out.append(f"sum{card and luhn(''.join(digits))}{card}")
    out.append(f"opens{s[0] if s[0] in '+(' else ''}{letters > 0}")
    out.append(f"mixed{letters > 0 and re.search(r'[0-9][A-Za-z]|[A-Za-z][0-9]', s) is not None}")
    if letters:
        out.append("words")
    return out


#: Shapes whose scores a field keeps (about 300 bytes each).
SHAPES = 50_000
_SHAPE = str.maketrans("123456789", "000000000")


class SpanField:
    """Weights of (kind, feature); a token outside spans scores nothing."""

    def __init__(self, weights: dict[str, list[float]], margin: float = MARGIN):
        self.weights, self.margin = weights, margin
        self._shapes: dict[str, tuple[int, int]] = {}
        self._scores: dict[tuple, list[float] | None] = {}

    def score(self, names: list[str]) -> list[float]:
        total = [0.0] * len(KINDS)
        for name in names:
            own = self.weights.get(name)
            if own is None:  # never seen in training: no evidence for a span
                own = _UNSEEN
            for k, w in enumerate(own):
                total[k] += w
        return total

    def scored(self, text: str, start: int, end: int) -> list[float] | None:
        """Scores of a candidate; None if it cannot be a span.  Spans without a sign score alike if their shapes and sums are alike."""
        s = text[start:end]
        if s[-1] in " \n\t(+[{<.,;:!?-'\"" or s[0] in " \n\t.,;:-)'\"":
            return None
        if "@" in s or "at" in s or "AT" in s or "At" in s or "aT" in s:
            names = features(text, start, end)
            return None if names is None else self.score(names)
        shape = s.translate(_SHAPE)
        known = self._shapes.get(shape)
        if known is None:
            if len(self._scores) > SHAPES or len(self._shapes) > SHAPES:
                self._shapes.clear()
                self._scores.clear()
            known = self._shapes[shape] = (shape.count("0"), len(re.findall("0+", shape)))
        digits, groups = known
        if digits < 4:
            return None
        exact = luhn("".join(re.findall("[0-9]", s))) if 13 <= digits <= 19 else None
        octets = all(len(g) < 4 and int(g) < 256 for g in re.findall("[0-9]+", s)) if groups == 4 else None
        before, behind = text[start - 1 : start], text[end : end + 1]
        key = (shape, exact, octets, before.isalnum() or before in "@.+-_" and before != "", behind.isalnum() or behind in "@-_" and behind != "")
        if key not in self._scores:
            names = features(text, start, end)
            self._scores[key] = None if names is None else self.score(names)
        return self._scores[key]

    def _run(self, text: str, bounds: list[int], low: int, high: int, longer: list[tuple[int, int]]) -> list[Span]:
        """The best-scoring segmentation of the tokens from ``low`` to ``high``."""
        n = high - low
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        by_end: dict[int, list] = {}
        for i, j in longer:
            by_end.setdefault(j - low, []).append((i - low, self.scored(text, bounds[i], bounds[j])))
        for i in range(n):
            if text[bounds[low + i]] in " \n\t.,;:-)":
                continue
            for j in range(i + 1, min(i + LONGEST, n) + 1):
                if text[bounds[low + j] - 1] == "\n":
                    break
                own = self.scored(text, bounds[low + i], bounds[low + j])
                if own is not None and max(own) > self.margin:
                    by_end.setdefault(j, []).append((i, own))
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i, own in sorted(by_end.get(j, ()), key=lambda c: c[0]):
                for k, s in enumerate(own or ()):
                    if best[i] + s - self.margin > best[j]:
                        best[j], back[j] = best[i] + s - self.margin, (i, k)
        out, j = [], n
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                out.append((KINDS[k], bounds[low + i], bounds[low + j]))
                j = i
        return out[::-1]

    def best(self, text: str, start: int, end: int, taken: list[tuple[int, int]]) -> list[Span]:
        """The best-scoring segmentation of a place, without spans that touch what is taken (disjoint, in order)."""
        bounds = [start, *(m.end() for m in _TOKEN.finditer(text, start, end))]
        place = {b: k for k, b in enumerate(bounds)}
        longer = []
        for m in _ADDRESS.finditer(text, start, end):
            i, j = place.get(m.start()), place.get(m.end())
            if i is not None and j is not None and j - i > LONGEST:
                longer.append((i, j))
        # what is taken parts the place
        out: list[Span] = []
        low = k = at = 0
        n = len(bounds) - 1
        for t in range(n + 1):
            while k < len(taken) and t < n and taken[k][1] <= bounds[t]:
                k += 1
            if t == n or k < len(taken) and taken[k][0] < bounds[t + 1]:
                if t > low:
                    own = []
                    while at < len(longer) and longer[at][0] < t:
                        if longer[at][0] >= low and longer[at][1] <= t:
                            own.append(longer[at])
                        at += 1
                    out += self._run(text, bounds, low, t, own)
                low = t + 1
        return out

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        """Base spans and what the field adds outside them."""
        if not self.weights or not _TRIGGER.search(text):
            return base
        taken: list[list[int]] = []
        for a, b in sorted((a, b) for _, a, b in base):
            if taken and a < taken[-1][1]:
                taken[-1][1] = max(taken[-1][1], b)
            else:
                taken.append([a, b])
        out = list(base)
        k = 0
        for start, end in places(text):
            while k < len(taken) and taken[k][1] <= start:
                k += 1
            stop = k
            while stop < len(taken) and taken[stop][0] < end:
                stop += 1
            out += self.best(text, start, end, taken[k:stop])
        return out


_UNSEEN = [-1.0] * len(KINDS)


def candidates_of(text: str, start: int, end: int, known: list[Span] = ()) -> tuple[list[int], list[tuple[int, int, list[str]]]]:
    """Token bounds of a place, and its candidate spans with their features; whole addresses and known spans may be longer than the others."""
    bounds = [start, *(m.end() for m in _TOKEN.finditer(text, start, end))]
    out = []
    for i in range(len(bounds) - 1):
        if text[bounds[i]] in " \n\t.,;:-)":
            continue
        for j in range(i + 1, min(i + LONGEST, len(bounds) - 1) + 1):
            if text[bounds[j] - 1] == "\n":
                break
            names = features(text, bounds[i], bounds[j])
            if names is not None:
                out.append((i, j, names))
    place = {b: k for k, b in enumerate(bounds)}
    longer = {(m.start(), m.end()) for m in _ADDRESS.finditer(text, start, end)} | {(a, b) for _, a, b in known}
    for a, b in sorted(longer):
        if a in place and b in place and place[b] - place[a] > LONGEST:
            names = features(text, a, b)
            if names is not None:
                out.append((place[a], place[b], names))
    return bounds, out


def rewritten(kind: str, span: str, draw: random.Random) -> str:
    """A form of a base span that the base patterns do not know."""
    digits = re.sub(r"[^0-9]", "", span)
    if kind == "email":
        name, _, host = span.partition("@")
        at, dot = draw.choice([(" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" @ ", "."), (" [at] ", ".")])
        return name + at + host.replace(".", dot)
    if kind == "ip":
        return draw.choice(["[.]", "(.)"]).join(span.split("."))
    if kind == "card":
        return draw.choice([".", "  ", " - "]).join(digits[k : k + 4] for k in range(0, len(digits), 4))
    ten = digits[-10:].rjust(10, "5")
    return draw.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "({}){}-{}", "1-{}-{}-{}", "1 ({}) {}-{}"]).format(ten[:3], ten[3:6], ten[6:])


#: Examples to start from (fixed values, reserved for documentation), used beside what the sample holds.
EXAMPLES = [("email", "ann.lee@mail.example.com"), ("email", "j_roe7@example.org"), ("email", "max-k.poe21@a.b.dept.mail2.example.co.uk"), ("ip", "192.0.2.17"), ("ip", "198.51.100.203"), ("card", "4111111111111111"), ("card", "5500005555555559"), ("phone", "+1 (212) 555-0147"), ("phone", "+44 20 7946 0958")]


def train(found: list[tuple[str, list[Span]]], steps: int = STEPS, seed: int = 3) -> SpanField:
    """A field from places: their text and the base spans in it.

    The likelihood of each place's labelling is raised by gradient steps; the expected features come from
    the forward-backward sums over all its segmentations.
    """
    draw = random.Random(seed)
    around = [t for t, s in found if not s] or ["the 12 of"]
    examples = [(t, s) for t, s in found]
    copies = [(k, t[a:b]) for t, s in found for k, a, b in s]
    for kind, span in EXAMPLES * 6 + draw.sample(copies, min(len(copies), 300)):
        for form in (span, rewritten(kind, span, draw)):
            left, right = draw.choice(["of ", "and ", "", "call ", "la "]), draw.choice([" the", ".", "", ", and", " de"])
            examples.append((left + form + right, [(kind, len(left), len(left) + len(form))]))
    for _ in range(120):  # numbers that are no personal data
        n = draw.choice([1, 2, 4, 5, 6, 8, 13, 16, 20])
        digits = "".join(draw.choice("0123456789") for _ in range(n))
        form = draw.choice([digits, digits[:4] + "-" + digits[4:6] + "-" + digits[6:8], digits[:1] + "." + digits[1:3], '"' + "".join(draw.choice("0123456789abcdef") for _ in range(40)) + '"'])
        if not base_spans(form):
            examples.append((draw.choice(["of ", "= ", ""]) + form + draw.choice([" the", "."]), []))
    examples += [(t, []) for t in around[:100]]
    number: dict[str, int] = {}
    data = []
    for text, spans in examples:
        bounds, candidates = candidates_of(text, 0, len(text), spans)
        place = {b: k for k, b in enumerate(bounds)}
        gold = {(place[a], place[b]): KINDS.index(k) for k, a, b in spans if a in place and b in place}
        if len(gold) < len(spans):
            continue  # it begins or ends inside a token
        inside, last = set(), -1
        for a, b in sorted(gold):
            if a < last:
                break
            last = b
            inside.add((a, b))
        gold = {k: gold[k] for k in inside}
        rows = [(i, j, [number.setdefault(x, len(number)) for x in names]) for i, j, names in candidates]
        if set(gold) <= {(i, j) for i, j, _ in rows}:
            data.append((len(bounds) - 1, rows, gold))
    w = np.zeros((len(number), len(KINDS)))
    flat = [f for _, rows, _ in data for _, _, f in rows]
    width = max((len(f) for f in flat), default=1)
    index = np.zeros((len(flat), width), np.intp)
    used = np.zeros((len(flat), width))
    for k, f in enumerate(flat):
        index[k, : len(f)] = f
        used[k, : len(f)] = 1
    momentum = np.zeros_like(w)
    for step in range(steps):
        scores = (w[index] * used[:, :, None]).sum(axis=1)
        delta = np.zeros_like(scores)
        at = 0
        for n, rows, gold in data:
            own = scores[at : at + len(rows)]
            weight = np.exp(np.minimum(own, 30.0))
            total = weight.sum(axis=1)
            ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
            ahead[0] = behind[n] = 1.0
            ends: dict[int, list] = {}
            starts: dict[int, list] = {}
            for r, (i, j, _) in enumerate(rows):
                ends.setdefault(j, []).append((i, total[r]))
                starts.setdefault(i, []).append((j, total[r]))
            for j in range(1, n + 1):
                ahead[j] = ahead[j - 1] + sum(ahead[i] * t for i, t in ends.get(j, ()))
            for i in range(n - 1, -1, -1):
                behind[i] = behind[i + 1] + sum(behind[j] * t for j, t in starts.get(i, ()))
            for r, (i, j, _) in enumerate(rows):
                delta[at + r] -= weight[r] * (ahead[i] * behind[j] / ahead[n])
                if (i, j) in gold:
                    delta[at + r, gold[i, j]] += 1
            at += len(rows)
        grad = np.zeros_like(w)
        np.add.at(grad, index.ravel(), (delta[:, None, :] * used[:, :, None]).reshape(-1, len(KINDS)))
        grad -= DECAY * len(data) * w
        momentum += grad * grad
        w += RATE * grad / np.sqrt(momentum + 1e-8)
    return SpanField({name: [float(x) for x in w[k]] for name, k in number.items()})


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> SpanField:
    """A field from the ``sample`` documents of least hash among those that hold a trigger."""
    text = F.col(f"`{text_col}`").cast("string")

    @pandas_udf("array<string>")
    def taken(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            base, rows = base_spans(t), []
            for a, b in places(t)[:PER_DOCUMENT]:
                if b - a <= 400:
                    own = [(k, x - a, y - a) for k, x, y in base if a <= x and y <= b]
                    rows.append(f"{shown(own)}\n{t[a:b]}")
            out.append(rows)
        return pd.Series(out)

    rows = docs.where(text.rlike("[0-9@]")).select(F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.lit("learn")).alias("h"), text.alias("t"))
    # only hashes are ordered; then one row of each hash up to the bound is looked at
    bound = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if bound is None:
        return train([])
    few = rows.where(F.col("h") <= bound).groupBy("h").agg(F.min("t").alias("t")).select(taken("t").alias("places")).collect()
    found = []
    for r in few:
        for place in r["places"]:
            spans, _, t = place.partition("\n")
            found.append((t, [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)]))
    return train(sorted(found))


_FOUND = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string"


def detected(field: SpanField, text_col: str = "text") -> Column:
    """A struct of base counts by kind, base spans and all spans (``shown``; code points, end exclusive)."""

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base = base_spans(t or "")
            kinds = [k for k, _, _ in base]
            rows.append((*(kinds.count(k) for k in KINDS), shown(base), shown(field.spans(t or "", base))))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    return pandas_udf(run, _FOUND)(F.col(f"`{text_col}`").cast("string"))


def masked(field: SpanField, text_col: str = "text") -> Column:
    """The text with every span replaced by its kind in angle brackets; spans that overlap become one, named by the first."""

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if not t:
                out.append(t)
                continue
            parts, end = [], 0
            for k, a, b in sorted(field.spans(t, base_spans(t)), key=lambda s: (s[1], -s[2])):
                if a >= end:
                    parts += [t[end:a], f"<{k}>"]
                end = max(end, b)
            out.append("".join([*parts, t[end:]]) if parts else t)
        return pd.Series(out, dtype=object)

    return pandas_udf(run, "string")(F.col(f"`{text_col}`").cast("string"))
