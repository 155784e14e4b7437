"""Text column functions: middle truncation, byte-bounded truncation, prefix trim,
NUL handling and the reserved-mark predicate.  All native Catalyst expressions.

Lengths are in code points (Spark ``length``), byte sizes via ``octet_length``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusforge.functions._util import as_col

# Fixed values that must equal the reference: the ellipsis used as the cut
# marker, the reserved unknown mark, and the byte bound for vocabulary text.
ELLIPSIS = "…"
RESERVED_MARK = "▅"
MAX_SENTENCE_BYTES = 32 * 1024


def _digits(x: Column) -> Column:
    return F.length(x.cast("string"))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable.

    Spark does not share common subexpressions inside higher-order lambdas; a
    one-element ``transform`` binds the value instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strim(text, size, n=None) -> Column:
    """Cut the middle out of ``text`` so it is ``size`` code points long, marking ``…cut…``.

    ``n`` may carry an already computed ``length(text)``.
    """
    t = as_col(text)
    s = as_col(size)
    n = F.length(t) if n is None else n
    cut0 = n - s + 2
    cut = cut0 + _digits(cut0 + _digits(cut0))
    sep_len = _digits(cut) + 2
    off = F.floor((s - sep_len + 1) / 2).cast("int")
    marked = F.concat(t.substr(F.lit(1), off), F.lit(ELLIPSIS), cut.cast("string"), F.lit(ELLIPSIS), t.substr(off + cut + 1, n))
    cut_short = n - s + 1
    off_short = F.floor(s / 2).cast("int")
    short = F.concat(t.substr(F.lit(1), off_short), F.lit(ELLIPSIS), t.substr(off_short + cut_short + 1, n))
    return (
        F.when(s <= 0, F.lit(""))
        .when(n <= s, t)
        .when(s >= sep_len + 2, marked)
        .otherwise(short)
    )


def btrim(text, size: int, mode: str = "compat", rounds: int = 24) -> Column:
    """Byte-bounded middle truncation.

    ``compat`` repeats ``s -= utf8_bytes(strim(text, s)) - size`` until the result
    fits, exactly like the reference loop.  While ``s >= len(text)`` every round
    subtracts the same excess, so that stretch is jumped in closed form; the rest
    runs as a bounded native ``aggregate`` that raises if it has not converged.
    ``tight`` keeps the largest ``s`` whose strim fits (binary search).
    """
    t = as_col(text)
    if mode == "tight":
        return _btrim_tight(t, int(size))
    if mode != "compat":
        raise ValueError(f"unknown btrim mode {mode!r}")
    size_c = F.lit(int(size))

    def trim_long(r):
        tt, n, nbytes = r["t"], r["n"], r["b"]
        e = nbytes - size_c
        # closed-form start: s = size - ceil((size - n + 1) / e) * e when size >= n, else size
        jumps = F.ceil((size_c - n + 1) / F.greatest(e, F.lit(1)))
        s0 = F.when((size_c >= n) & (e > 0), size_c - jumps * e).otherwise(size_c).cast("int")

        def step(acc, _i):
            def advance(u):
                ex = F.octet_length(u) - size_c
                return F.when(ex > 0, F.struct((acc["s"] - ex).cast("int").alias("s"), F.lit(None).cast("string").alias("out"), F.lit(False).alias("done"))).otherwise(
                    F.struct(acc["s"].alias("s"), u.alias("out"), F.lit(True).alias("done"))
                )

            return F.when(acc["done"], acc).otherwise(let(strim(tt, acc["s"], n), advance))

        init = F.struct(s0.alias("s"), F.lit(None).cast("string").alias("out"), F.lit(False).alias("done"))
        loop = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), init, step)
        return F.when(loop["done"], loop["out"]).otherwise(
            F.raise_error(F.lit(f"btrim did not converge in {rounds} rounds")).cast("string")
        )

    bound = F.struct(t.alias("t"), F.length(t).alias("n"), F.octet_length(t).alias("b"))
    return F.when(t.isNull(), F.lit(None).cast("string")).when(F.octet_length(t) <= size_c, t).otherwise(let(bound, trim_long))


def _btrim_tight(t: Column, size: int) -> Column:
    """Largest s with octet_length(strim(t, s)) <= size, by a 20-step binary search."""
    size_c = F.lit(size)
    n = F.length(t)

    def step(acc, _i):
        mid = F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
        fits = F.octet_length(strim(t, mid)) <= size_c
        return F.when(acc["lo"] >= acc["hi"], acc).otherwise(
            F.when(fits, F.struct(mid.alias("lo"), acc["hi"].alias("hi")))
            .otherwise(F.struct(acc["lo"].alias("lo"), (mid - 1).alias("hi")))
        )

    init = F.struct(F.lit(0).alias("lo"), F.least(n, size_c).cast("int").alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(40)), init, step)
    return F.when(F.octet_length(t) <= size_c, t).otherwise(strim(t, found["lo"]))


def prefix_trim(text, max_length: int, avg_token_len) -> Column:
    """Keep the first ``ceil(max_length * avg_token_len)`` code points (length hint before encoding)."""
    k = F.ceil(F.lit(float(max_length)) * as_col(avg_token_len)).cast("int")
    t = as_col(text)
    return t.substr(F.lit(1), k)


def strip_trailing_nul(text) -> Column:
    return F.rtrim(as_col(text), F.lit("\u0000"))


def has_interior_nul(text) -> Column:
    """True when NUL remains after trailing NULs are stripped."""
    return F.contains(strip_trailing_nul(text), F.lit("\u0000"))


def has_reserved_mark(text) -> Column:
    return F.contains(as_col(text), F.lit(RESERVED_MARK))
