"""DuckDB expression text for oracle SQL (the oracle side of native Spark expressions)."""

from __future__ import annotations


def strim_sql(t: str, s: str) -> str:
    n = f"length({t})"
    cut0 = f"({n} - ({s}) + 2)"
    cut = f"({cut0} + length(CAST({cut0} + length(CAST({cut0} AS VARCHAR)) AS VARCHAR)))"
    sep = f"('…' || CAST({cut} AS VARCHAR) || '…')"
    off = f"CAST(floor((({s}) - length({sep}) + 1) / 2.0) AS BIGINT)"
    marked = f"(substr({t}, 1, {off}) || {sep} || substr({t}, {off} + {cut} + 1))"
    cut_s = f"({n} - ({s}) + 1)"
    off_s = f"CAST(floor(({s}) / 2.0) AS BIGINT)"
    short = f"(substr({t}, 1, {off_s}) || '…' || substr({t}, {off_s} + {cut_s} + 1))"
    return (
        f"(CASE WHEN ({s}) <= 0 THEN '' WHEN {n} <= ({s}) THEN {t} "
        f"WHEN ({s}) >= length({sep}) + 2 THEN {marked} ELSE {short} END)"
    )


def btrim_recursive_sql(source: str, key: str, text: str, size: int) -> str:
    """Recursive CTE running the reference loop literally; yields (key, text)."""
    st = strim_sql(f"d.{text}", "r.s")
    return f"""
WITH RECURSIVE d AS ({source}),
r(k, s, out, done) AS (
  SELECT {key}, {size}, NULL::VARCHAR, false FROM d
  UNION ALL
  SELECT r.k,
    CASE WHEN strlen(x.u) > {size} THEN r.s - (strlen(x.u) - {size}) ELSE r.s END,
    CASE WHEN strlen(x.u) <= {size} THEN x.u END,
    strlen(x.u) <= {size}
  FROM r JOIN d ON d.{key} = r.k, LATERAL (SELECT {st} AS u) x
  WHERE NOT r.done
)
SELECT k AS {key}, out AS {text} FROM r WHERE done
"""
