"""Quality rules as weak supervision (DataFrame operations only).

Each rule looks at a few counts of a text and casts its vote, good or bad, or abstains.  How
often each rule's votes are right is estimated without labels, by expectation maximisation
over the counts of vote patterns; a text's posterior probability of being good replaces the
demand that all rules pass.  An accuracy is one half at least, so no vote turns into its
opposite.  Rules speak of visible defects, or of prose without them, and abstain otherwise:
the absence of one defect is no sign of quality, and counted as a vote it would outvote them.

The counts are array and string expressions on the row, so a very long text stays in its row
and no word is shuffled.  Words in repeated three-word windows are found by sorting: two arrays
of numbers hold different parts of each window's 64-bit hash above its position, and a window
counts as repeated if it has an equal neighbour in both.  Vote patterns number two to the
power of the number of rules at most, whatever the table's size; only their estimates reach the
driver.

Null text has no words, fails the base check and is not kept.  Rows with null ids and repeated
rows give their own rows; column names of the input are avoided; an empty table gives an empty
table (and the starting estimates).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm.common import fresh, written

SYMBOLS = "#*$%&|<>"
#: Fewest words, and largest share (in hundredths) of words in repeated windows, that the base check accepts.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A text is kept if its posterior probability reaches this.
KEEP_FROM = 0.5
#: Steps of the estimation, the change at which it ends, and the bounds of an estimated accuracy.
STEPS, SETTLED, LEAST, MOST = 50, 1e-6, 0.5, 0.99
#: Where the estimation starts: share of good texts, accuracy of a vote.
START_GOOD, START_ACCURACY = 0.8, 0.9

_SPACE = "\t\n\x0b\x0c\r "

#: Rules by name: a vote (-1 bad, 1 good) and the SQL condition over the counts on which it is cast; else the rule abstains.
RULES: dict[str, tuple[int, str]] = {
    "symbols": (-1, "n_symbols * 10 > n_words"),
    "marks": (-1, "n_marks * 8 > word_chars"),
    "separators": (-1, "n_separators * 10 > n_words"),
    "shouting": (-1, "n_upper * 2 > word_chars"),
    "exclaiming": (-1, "n_exclaim * 4 > n_words"),
    "repetition": (-1, "n_repeat_words * 100 > 30 * n_words"),
    "lines": (-1, "n_dup_lines * 10 > 3 * n_lines"),
    "word_length": (-1, "word_chars > 12 * n_words or word_chars < 2 * n_words"),
    "prose": (1, "n_upper between 1 and word_chars / 8 and n_stops between 1 and n_words and n_symbols * 50 <= n_words and n_exclaim * 20 <= n_words"),
    "varied": (1, "n_words >= 50 and n_repeat_words * 100 <= 15 * n_words and n_dup_lines * 10 <= n_lines and n_symbols * 50 <= n_words"),
}


def _taken(text: Column, chars: str) -> Column:
    """How many of the characters the text has."""
    rest = text
    for c in chars:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.length(text) - F.length(rest)).cast("long")


def _matched(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def with_counts(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The columns of ``docs`` (or those to ``carry``) with the counts as further ones, and their names there (other than wanted, if taken)."""
    wanted = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim", "n_stops", "n_marks", "n_separators"]
    name = {c: fresh(docs, c) for c in [*wanted, "_words", "_lines", "_bits", "_high", "_low", "_again", "_spaced"]}
    keep = [F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    line = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.select(*keep, F.translate(text, _SPACE, " " * len(_SPACE)).alias(name["_spaced"]), line.alias(name["_lines"]))
    spaced = F.col(f"`{name['_spaced']}`")
    step = step.select(
        *keep,
        F.array_remove(F.split(spaced, " "), "").alias(name["_words"]),
        F.col(f"`{name['_lines']}`"),
        F.length(F.replace(spaced, F.lit(" "), F.lit(""))).cast("long").alias(name["word_chars"]),
        _taken(spaced, SYMBOLS).alias(name["n_symbols"]),
        _matched(spaced, "[A-Z\u00c0-\u00d6\u00d8-\u00de]+").alias(name["n_upper"]),
        _taken(spaced, "!").alias(name["n_exclaim"]),
        _taken(spaced, ".!?").alias(name["n_stops"]),
        _matched(spaced, r"[!-@\[-`{-~]+").alias(name["n_marks"]),
        ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" | "), F.lit("")))) / 3).cast("long").alias(name["n_separators"]),
    )
    counts = [name[c] for c in ("word_chars", "n_symbols", "n_upper", "n_exclaim", "n_stops", "n_marks", "n_separators")]
    words, n = F.col(name["_words"]), F.size(name["_words"])
    step = step.select(
        *keep,
        *counts,
        n.cast("long").alias(name["n_words"]),
        F.size(name["_lines"]).cast("long").alias(name["n_lines"]),
        (F.size(name["_lines"]) - F.size(F.array_distinct(name["_lines"]))).cast("long").alias(name["n_dup_lines"]),
        # positions take this many low bits
        F.length(F.bin(n.cast("long"))).alias(name["_bits"]),
        F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda w, k: F.xxhash64(w, F.get(words, k + 1), F.get(words, k + 2))).alias(name["_words"]),
    )
    counts += [name[c] for c in ("n_words", "n_lines", "n_dup_lines")]
    bits, hashes = name["_bits"], name["_words"]
    # a text whose windows all differ needs no search
    found = F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.col(hashes)).otherwise(F.lit([]).cast("array<bigint>"))
    step = step.select(*keep, *counts, bits, found.alias(hashes))
    step = step.select(
        *keep,
        *counts,
        bits,
        F.expr(f"sort_array(transform(`{hashes}`, (h, k) -> shiftleft(shiftright(h, `{bits}`), `{bits}`) | cast(k as bigint)))").alias(name["_high"]),
        F.expr(f"sort_array(transform(`{hashes}`, (h, k) -> shiftleft(h, `{bits}`) | cast(k as bigint)))").alias(name["_low"]),
    )

    def repeated(column: str) -> str:
        """Positions of the windows that share their hash part with a neighbour."""
        c = f"`{column}`"
        same = f"shiftright(x, `{bits}`) = shiftright(get({c}, k {{}} 1), `{bits}`)"
        found = f"filter({c}, (x, k) -> coalesce({same.format('-')}, false) or coalesce({same.format('+')}, false))"
        return f"transform({found}, x -> x & (shiftleft(1L, `{bits}`) - 1L))"

    step = step.select(*keep, *counts, F.expr(f"sort_array(array_intersect({repeated(name['_high'])}, {repeated(name['_low'])}))").alias(name["_again"]))
    again = f"`{name['_again']}`"
    covered = f"aggregate(transform({again}, (p, k) -> least(3L, coalesce(get({again}, k + 1) - p, 3L))), 0L, (s, x) -> s + x)"
    step = step.select(*keep, *counts, F.expr(covered).alias(name["n_repeat_words"]))
    return step, {c: name[c] for c in wanted}


def _vote(rule: tuple[int, str], name: dict[str, str]) -> Column:
    import re

    vote, when = rule
    return F.when(F.expr(re.sub(r"\b[a-z_]+\b", lambda m: f"`{name[m[0]]}`" if m[0] in name else m[0], when)), F.lit(vote)).otherwise(F.lit(0))


@dataclass(frozen=True)
class Estimates:
    """Share of good texts, and the probability that a vote of each rule is right."""

    good: float
    accuracy: dict[str, float]


START = Estimates(START_GOOD, dict.fromkeys(RULES, START_ACCURACY))


def posterior(estimates: Estimates, votes: dict[str, Column]) -> Column:
    """Probability that a text with these votes is good: votes are independent, given whether it is; abstaining says nothing."""
    # the numbers come as one array, so Spark compiles the expression once for all steps of the estimation
    given = F.lit([math.log(p / (1 - p)) for p in (estimates.good, *estimates.accuracy.values())])
    odds = given[0]
    for k, rule in enumerate(estimates.accuracy):
        odds = odds + votes[rule] * given[k + 1]
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def estimate(patterns: DataFrame, steps: int = STEPS) -> Estimates:
    """Estimates from ``patterns``: a vote column per rule and n, how many texts voted so."""
    now = START
    for _ in range(steps):
        p = posterior(now, {r: F.col(r) for r in RULES})
        sums = [F.sum("n"), F.sum(p * F.col("n"))]
        for r in RULES:
            right = F.when(F.col(r) > 0, p).when(F.col(r) < 0, 1 - p).otherwise(F.lit(0.0))
            sums += [F.sum(right * F.col("n")), F.sum(F.abs(r) * F.col("n"))]
        row = patterns.agg(*sums).first()
        if not row[0]:
            return now
        accuracy = {r: min(max((row[2 + 2 * k] + START_ACCURACY) / (row[3 + 2 * k] + 1), LEAST), MOST) for k, r in enumerate(RULES)}
        after = Estimates(min(max(row[1] / row[0], 0.05), 0.95), accuracy)
        moved = abs(after.good - now.good) + sum(abs(accuracy[r] - now.accuracy[r]) for r in RULES)
        now = after
        if moved < SETTLED:
            break
    return now


def judge_quality(spark: SparkSession, docs: DataFrame, text_col: str = "text", keep_from: float = KEEP_FROM, carry: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` (or its columns to ``carry``) with counts, base_failed, quality (the posterior) and kept; and the names these columns have there."""
    counted, name = with_counts(docs, text_col, carry)
    counted = written(spark, counted)
    votes = {r: _vote(rule, name) for r, rule in RULES.items()}
    patterns = counted.select(*(v.alias(r) for r, v in votes.items())).groupBy(*RULES).agg(F.count("*").alias("n")).coalesce(1).checkpoint()
    estimates = estimate(patterns)
    name |= {c: fresh(counted, c) for c in ("base_failed", "quality", "kept")}
    n, again = F.col(f"`{name['n_words']}`"), F.col(f"`{name['n_repeat_words']}`")
    failed = (n < LEAST_WORDS) | (again * 100 > n * MOST_REPEATED)
    out = counted.withColumn(name["base_failed"], failed).withColumn(name["quality"], posterior(estimates, votes))
    return out.withColumn(name["kept"], ~F.col(f"`{name['base_failed']}`") & (F.col(f"`{name['quality']}`") >= keep_from)), name
