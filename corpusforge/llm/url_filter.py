"""URL rules with redirect equivalence (DataFrame operations only).

A rule has a host, a path prefix and a verdict; it fits its host and all subdomains if the
URL's path starts with its path, and the longest fitting rule decides (allow, if two of the
same length disagree).  A URL without a rule takes part in its equivalence class: redirect
and canonical-link edges join URLs, and over the connected components a block spreads to all
aliases, unless the class also holds a URL that a rule allows.  Without any of these a URL is
allowed.

Rules are matched by equality: each distinct host is expanded to its suffixes, each distinct
host and path to the prefixes whose lengths the rules of that suffix have.  Nothing is grouped
by page, so a host, or one URL, with a third of all rows is aggregated before it is shuffled
and joined by a join that Spark can split; rules are joined, never collected.

Null URLs and URLs without ``://`` have an empty host and path, fit no rule and are allowed.
Repeated rows and null page ids give their own rows.  Of the pages only the named columns are
read, so further columns cannot clash; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm.common import written
from corpusforge.llm.components import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """A URL as a node of the redirect graph: without its fragment, host in lower case."""
    scheme = F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), host_of(url), rest))


def _let(value: Column, then) -> Column:
    """``then(value)``, with ``value`` worked out once."""
    return F.transform(F.array(value), then)[0]


def _without_dots(path: Column) -> Column:
    """A path from the root without its ``.`` and ``..`` segments."""
    none = F.array().cast("array<string>")

    def step(out: Column, part: Column) -> Column:
        shorter = F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))
        return F.when(part == "..", shorter).when(part == ".", out).otherwise(F.concat(out, F.array(part)))

    kept = F.aggregate(F.slice(F.split(path, "/", -1), 2, 1 << 30), none, step)
    ends = F.concat(kept, F.when(path.rlike(r"/\.{1,2}\z"), F.array(F.lit(""))).otherwise(none))
    return F.when(path.rlike(r"/\.{1,2}(/|\z)"), F.concat(F.lit("/"), F.array_join(ends, "/"))).otherwise(path)


def resolved(base: Column, to: Column) -> Column:
    """The URL that a reference on the page ``base`` names, without its fragment; null if it names no ``://`` URL."""
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    own = F.when(path_of(base) == "", "/").otherwise(path_of(base))
    query = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1)
    whole = F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.startswith("//"), F.concat(scheme, to))
    # root, path and query of the target
    place = F.struct(F.regexp_extract(whole, r"(?s)^(.*?://[^/?#]*)", 1).alias("root"), path_of(whole).alias("path"), F.regexp_extract(whole, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1).alias("query"))
    path, rest = F.regexp_extract(to, r"(?s)^([^?#]*)", 1), F.regexp_extract(to, r"(?s)^[^?#]*(\?[^#]*)", 1)
    below = F.when(path.startswith("/"), path).when(path != "", F.concat(F.regexp_extract(own, r"(?s)^(.*/)", 1), path)).otherwise(own)
    near = F.struct(root.alias("root"), below.alias("path"), F.when((path == "") & (rest == ""), query).otherwise(rest).alias("query"))
    target = F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://|^//"), place).when(~to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), near)
    return _let(F.when(base.contains("://"), target), lambda t: F.concat(t["root"], _let(t["path"], _without_dots), t["query"]))


def html_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges ``a, b`` from pages to all their canonical links and targets of refreshes; relative ones start from the page's URL."""
    url, html = F.col(f"`{url_col}`"), F.col(f"`{html_col}`")
    quoted = r"[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"

    def all_of(tag: str, target: str) -> Column:
        return F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, target, 1))

    canonical = all_of(r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", rf"(?i)<link\b{quoted}")
    refresh = all_of(r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", r"(?i)\bcontent\s*=\s*[\"']?\s*\d+\s*;\s*url\s*=\s*[\"']?([^\"'\s>]+)")
    links = pages.select(url.alias("a"), F.explode(F.concat(canonical, refresh)).alias("to")).where("to <> ''")
    # exploded, so that a later filter does not work it out again
    target = _let(resolved(F.col("a"), F.regexp_replace("to", "&amp;", "&")), node_of)
    links = links.select(node_of(F.col("a")).alias("a"), F.explode(F.array(target)).alias("b"))
    return links.where("a is not null and b is not null and a <> b")


def rule_for(spark: SparkSession, places: DataFrame, rules: DataFrame) -> DataFrame:
    """The deciding rule of each distinct ``host, path`` of ``places`` that has one: adds ``rule, verdict``."""
    places = places.select("host", "path").distinct()
    lengths = rules.groupBy(F.col("host").alias("suffix")).agg(F.collect_set(F.length("path")).alias("lengths"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda k: F.array_join(F.slice("labels", k, F.size("labels")), "."))
    hosts = places.select("host").distinct().select("host", labels.alias("labels")).select("host", F.explode(suffixes).alias("suffix"))
    hosts = written(spark, hosts.join(lengths, "suffix"))  # a table, so that a join with a hot host can be split
    wanted = places.join(hosts, "host").select("host", "path", "suffix", F.explode("lengths").alias("n")).where("length(path) >= n")
    wanted = wanted.select("host", "path", "suffix", F.expr("substring(path, 1, n)").alias("prefix"))
    rule = rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), F.concat("host", "path").alias("rule"), "verdict")
    fitting = wanted.join(rule, ["suffix", "prefix"])
    best = F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "allow").alias("allows"), "rule", "verdict")).alias("best")
    return fitting.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict")


def judge_urls(spark: SparkSession, pages: DataFrame, rules: DataFrame, links: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: the id, host, path, rule (or null), verdict.

    ``rules`` has host, path, verdict (``allow`` or ``block``); ``links`` has a, b: nodes (``node_of``)
    of redirects and canonical links, from the pages (``html_links``) or from a crawl's log.
    """
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    classes = written(spark, connected_components(spark, links))
    members = classes.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    ruled = written(spark, rule_for(spark, rows.select("host", "path").union(members.select("host", "path")), rules))
    decided = members.join(ruled, ["host", "path"]).groupBy("component").agg(F.max(F.col("verdict") == "allow").alias("allows"), F.max(F.col("verdict") == "block").alias("blocks"))
    spread = written(spark, classes.join(decided.where("blocks and not allows"), "component").select("node", F.lit("block").alias("spread")))
    out = rows.join(ruled, ["host", "path"], "left").join(spread, "node", "left")
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", "spread", F.lit("allow")).alias("verdict"))
