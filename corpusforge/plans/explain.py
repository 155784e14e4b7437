"""Summarize the executed plan of every registered query: shuffles, broadcasts,
Python nodes, scans and their read schemas.  ``python -m corpusforge.plans.explain``."""

from __future__ import annotations

import re
import sys

SKIP = {"vocab_learn", "vocab_learn_html", "vocab_triage", "text_classifier", "stream_trials"}


def summarize(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    shuffles = [re.sub(r"#\d+L?", "", l.split("Exchange ", 1)[1].split(", [plan_id")[0]) for l in lines
                if "Exchange " in l and "BroadcastExchange" not in l]
    return {
        "shuffles": shuffles,
        "broadcasts": sum("BroadcastExchange" in l for l in lines),
        "python": sorted({m for l in lines for m in re.findall(r"(ArrowEvalPython|BatchEvalPython|MapInPandas|MapInArrow|FlatMapGroupsInArrow|FlatMapCoGroupsInArrow|PythonDataSourceScan)", l)}),
        "scans": sorted({re.sub(r"#\d+L?", "", m) for l in lines for m in re.findall(r"ReadSchema: (struct<[^>]*>?)", l)}),
    }


def main(argv=None) -> int:
    argv = argv if argv is not None else sys.argv[1:]
    sf = argv[0] if argv else "/root/testdata/sf0.001"
    from corpusforge.plans.catalog import all_queries
    from corpusforge.session import local_session

    spark = local_session()
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the static plan; AQE only coalesces/converts at run time
    out = ["| query | shuffles | broadcasts | Python nodes | scan read schemas |", "| --- | --- | --- | --- | --- |"]
    for name, q in sorted(all_queries().items()):
        if name in SKIP or name.startswith("stream_"):
            continue
        s = summarize(q.build(spark, sf))
        out.append(f"| {name} | {len(s['shuffles'])}: {'; '.join(s['shuffles']) or '-'} | {s['broadcasts']} | "
                   f"{', '.join(s['python']) or '-'} | {'; '.join(s['scans'])[:160]} |")
    print("\n".join(out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
