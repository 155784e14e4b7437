"""Main text of pages by nearest-URL page differencing.

A page becomes its blocks of text in page order, one line each.  Within each host, pages are
ordered by URL path, and a page is set against the neighbour whose path agrees longer with its
own (the one before, on a tie): their lines are aligned by longest common subsequence, and the
lines that both share are deleted: what two pages of a site have in common is its frame.  A
page with the very same lines is a copy and shows nothing about the frame; the neighbours are
the next pages before and behind that are none.

Markup says more where there is some.  Blocks in elements whose name, role or class says menu,
header, footer, sidebar, notice, advert, form or comments are frame whatever the neighbour has;
a class that only holds such a word among others (``has-sidebar``) does not decide alone, see ``_decide``.
Blocks of an ``article`` or ``main`` element stay even if the neighbour repeats them (copies of an
article are articles), and with such an element nothing outside it is main text.

Of alignments of the same length any may be taken, so of equal lines of a page, of which the neighbour
has fewer, it is not fixed which are deleted; how many are is.

Pages in order of host, path, URL, id and hash are cut into contiguous runs of about the same weight,
so a host with a third of all pages is spread over many tasks.  A first pass, without the html in its
shuffle, finds where runs start and the nearest pages outside each run that are no copies of its ends;
these are handed to the run as well, so cuts change no text.  Inside a task rows stream in order, and
two pages and a run of copies are held at a time.

Null html is empty and gives an empty text; null URLs share an empty host.  Rows with null ids and
repeated rows give their own rows.  Only the id, URL and html columns are read, so further columns
cannot clash; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegralType, StringType

from corpusforge.llm.common import written
from corpusforge.llm.url_filter import host_of, path_of

#: Runs for each shuffle partition.
RUNS = 4

# fixed values of the HTML standard: elements without content, with raw text, and inside a line of text
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are frame by their name, roles and class or id words that say so.
FRAME_NAMES = frozenset("nav footer aside form head script style noscript template dialog menu button select svg math object canvas audio video".split())
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form".split())
FRAME_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices popup modal newsletter subscribe subscription sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social related recommended comment comments disqus replies widget widgets toolbar pagination pager skip".split())
MAIN_NAMES = frozenset(("article", "main"))

# a quote opens a value only behind an equals sign; one that nothing closes is taken as a character
_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[\"']?))*+)>|[!?/][^>]*>)")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[a-z0-9]+")

FRAME, OTHER, MAIN = 0, 1, 2
WEAK, STRONG, CERTAIN = 1, 2, 3


def _says_frame(name: str, attributes: str, in_main: bool) -> int:
    """How surely an element says that it is frame: by its name or role, by a whole class or id, or by a word of one (0: not at all)."""
    if name in FRAME_NAMES or name == "header" and not in_main:
        return CERTAIN
    if name in ("html", "body") or not attributes.strip():
        return 0
    sure = 0
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "role" and value.strip() in FRAME_ROLES:
            return CERTAIN
        if key in ("class", "id"):
            for each in value.split():
                words = _WORD.findall(each)
                if words and FRAME_WORDS.issuperset(words):
                    sure = STRONG
                elif not FRAME_WORDS.isdisjoint(words) and name not in MAIN_NAMES:
                    sure = max(sure, WEAK)
    return sure


class _Claim:
    """An element whose class or id says frame: what it holds decides whether that stands."""

    __slots__ = ("sure", "around", "holds_article", "holds_main", "chars", "stands", "framed")

    def __init__(self, sure: int, around: _Claim | None):
        self.sure, self.around = sure, around
        self.holds_article, self.holds_main, self.chars, self.stands, self.framed = False, False, 0, True, True


class _Main:
    """An article or main element with its own claim and the main element around it."""

    __slots__ = ("claim", "around")

    def __init__(self, claim: _Claim | None, around: _Main | None):
        self.claim, self.around = claim, around


def _decide(lines: list[tuple], claims: list[_Claim]) -> list[tuple[str, int]]:
    """A word of a class stands for frame unless the element holds an article or most of the text, a whole class unless it holds a
    main element; if that leaves nothing, no element with most of the text is frame."""
    half = sum(len(x) for x, frame, _, _ in lines if not frame) / 2
    for c in reversed(claims):
        if c.around is not None:
            c.around.chars += c.chars
            c.around.holds_article |= c.holds_article
            c.around.holds_main |= c.holds_main

    def places() -> list[int]:
        for c in claims:
            c.framed = c.stands or c.around is not None and c.around.framed
        out = []
        for _, frame, claim, main in lines:
            if frame or claim is not None and claim.framed:
                out.append(FRAME)
                continue
            while main is not None and main.claim is not None and main.claim.stands:
                main = main.around
            out.append(OTHER if main is None else MAIN)
        return out

    for c in claims:
        c.stands = not c.holds_main and (c.sure == STRONG or not c.holds_article and c.chars <= half)
    found = places()
    if claims and max(found, default=FRAME) == FRAME:
        for c in claims:
            c.stands = c.stands and c.chars <= half
        found = places()
    return [(x[0], p) for x, p in zip(lines, found, strict=True)]


def blocks(source: str | None) -> list[tuple[str, int]]:
    """Lines of a page in order, each with its place: in the frame, in a main element, or elsewhere."""
    lines: list[tuple] = []  # text, certain frame, innermost claim and main element around it
    text: list[str] = []
    # open elements: name, certain frame, its claim, main element
    stack: list[tuple[str, bool, _Claim | None, bool]] = []
    claims: list[_Claim] = []
    claim: _Claim | None = None
    main: _Main | None = None
    frame = 0
    source = source or ""

    def close() -> None:
        if text:
            # markup inside a line joins its pieces without a space
            line = " ".join(references.unescape("".join(text)).split())
            text.clear()
            if line:
                lines.append((line, frame > 0, claim, main))
                if not frame and claim is not None:
                    claim.chars += len(line)

    def pop() -> None:
        nonlocal frame, claim, main
        _, f, c, m = stack.pop()
        frame -= f
        if c is not None:
            claim = c.around
        if m:
            main = main.around

    at, end = 0, len(source)
    while at < end:
        tag = _TAG.search(source, at)
        if tag is None:
            text.append(source[at:])
            break
        if tag.start() > at:
            text.append(source[at : tag.start()])
        at = tag.end()
        if tag[1]:
            stop = source.find("-->", tag.end() - 2)
            at = end if stop < 0 else stop + 3
            continue
        if not tag[3]:
            continue
        name = tag[3].lower()
        if name not in INLINE:
            close()
        if tag[2]:
            if any(s[0] == name for s in stack):
                if any(s[0] == name and (s[1] or s[2]) for s in stack):
                    close()
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in RAW:
            close()
            stop = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(source, at)
            at = end if stop is None else stop.end()
            continue
        if name == "body":
            while stack and any(s[0] == "head" for s in stack):
                pop()
        if name in VOID:
            continue
        # a paragraph or list item ends where the next block starts
        if name not in INLINE and stack and stack[-1][0] in ("p", "li") and (stack[-1][0] == "p" or name == "li"):
            pop()
        says = _says_frame(name, tag[4], main is not None)
        is_main = name in MAIN_NAMES or bool(re.search(r"\brole\s*=\s*[\"']?main\b", tag[4]))
        if says:
            close()
        if says or name not in INLINE:
            if is_main and not frame and claim is not None:
                claim.holds_article = True
                claim.holds_main |= name != "article"
            own = _Claim(says, claim) if says in (WEAK, STRONG) else None
            stack.append((name, says == CERTAIN, own, is_main))
            frame += says == CERTAIN
            if own is not None:
                claims.append(own)
                claim = own
            if is_main:
                main = _Main(own, main)
    close()
    return _decide(lines, claims)


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence, in both lists."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < min(len(a), len(b)) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    head = [(k, k) for k in range(start)]
    tail = [(len(a) - k, len(b) - k) for k in range(stop, 0, -1)]
    in_b, in_a = set(b[start : len(b) - stop]), set(a[start : len(a) - stop])
    left = [k for k in range(start, len(a) - stop) if a[k] in in_b]
    right = [k for k in range(start, len(b) - stop) if b[k] in in_a]
    middle = _subsequence([a[k] for k in left], [b[k] for k in right])
    return head + [(left[i], right[j]) for i, j in middle] + tail


#: Bits of the table of one bit-parallel alignment; longer lists are halved.
TABLE_BITS = 1 << 26


def _rows(a: list, b: list):
    """Bit-parallel rows: a zero at bit j of row i if b's element j lengthens the common subsequence with a's first i elements."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _subsequence(a: list, b: list) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) == 1 or len(b) == 1 or len(a) * len(b) <= TABLE_BITS:
        rows = [(1 << len(b)) - 1, *_rows(a, b)]
        i, j, out = len(a), len(b), []
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
            elif not rows[i - 1] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return out[::-1]
    half = len(a) // 2
    *_, ahead = _rows(a[:half], b)
    *_, behind = _rows(a[half:][::-1], b[::-1])
    n = len(b)
    # lengths of the best alignment of the first half with b[:j] and of the second with b[j:]
    first = [0]
    for c in bin(ahead | 1 << n)[:2:-1]:
        first.append(first[-1] + (c == "0"))
    second = [0]
    for c in bin(behind | 1 << n)[:2:-1]:
        second.append(second[-1] + (c == "0"))
    cut = max(range(n + 1), key=lambda j: first[j] + second[n - j])
    return _subsequence(a[:half], b[:cut]) + [(half + i, cut + j) for i, j in _subsequence(a[half:], b[cut:])]


def _agreeing(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class _Page:
    __slots__ = ("page_id", "url", "group", "path", "own", "lines", "places")

    def __init__(self, page_id, url, group, path, own, source):
        self.page_id, self.url, self.group, self.path, self.own = page_id, url, group, path, own
        found = blocks(source)
        self.lines, self.places = [x for x, _ in found], [p for _, p in found]

    def row(self, before: _Page | None, behind: _Page | None) -> tuple:
        near = [p for p in (before, behind) if p is not None and p.group == self.group]
        near.sort(key=lambda p: -_agreeing(p.path, self.path))
        shared = {i for i, _ in common(self.lines, near[0].lines)} if near else set()
        wanted = MAIN if MAIN in self.places else OTHER
        kept = [x for k, (x, p) in enumerate(zip(self.lines, self.places, strict=True)) if p == wanted and (p == MAIN or k not in shared)]
        text = "\n".join(kept)
        return self.page_id, self.url, text, len(text), len(self.lines), len(shared)


_KEY = ["_host", "_path", "_url", "_order", "_hash"]


def _sortable(key: tuple) -> tuple:
    """Orders as Spark does: nulls first."""
    return tuple((x is not None, x) for x in key)


def _cuts(slim: DataFrame, tasks: int) -> list[dict]:
    """The runs in order: first and last key, lines of both, and the keys next to the first and last run of copies inside."""
    total = slim.agg(F.count("*").alias("n"), F.sum("_chars").alias("chars")).first()
    if not total["n"]:
        return []
    # half by pages, half by characters
    page = max(total["chars"] / total["n"], 1.0)
    most = 2 * page * total["n"] / (RUNS * tasks)
    order = slim.schema["_order"].dataType
    key = pa.struct([("_host", pa.string()), ("_path", pa.string()), ("_url", pa.string()), ("_order", to_arrow_type(order)), ("_hash", pa.int64())])
    kinds = {"first": key, "head": pa.binary(), "after": key, "last": key, "tail": pa.binary(), "ahead": key}

    def summed(batches):
        now, weight = None, 0.0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own, lines = {k: row[k] for k in _KEY}, row["_lines"]
                if now is not None and weight + page + row["_chars"] > most and own != now["last"]:
                    out.append(now)
                    now = None
                if now is None:
                    now, weight = {"first": own, "head": lines, "after": None, "last": own, "tail": lines, "ahead": None}, 0.0
                weight += page + row["_chars"]
                if (own["_host"], lines) != (now["last"]["_host"], now["tail"]):
                    now["after"] = now["after"] or own
                    now["ahead"] = now["last"]
                now["last"], now["tail"] = own, lines
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))
        if now is not None:
            yield pa.RecordBatch.from_pylist([now], pa.schema(kinds))

    struct = f"struct<_host string, _path string, _url string, _order {order.simpleString()}, _hash long>"
    ranged = slim.repartitionByRange(tasks, *_KEY).sortWithinPartitions(*_KEY)
    found = ranged.mapInArrow(summed, f"first {struct}, head binary, after {struct}, last {struct}, tail binary, ahead {struct}")
    rows = [r.asDict() for r in found.collect()]  # bounded: a few for each partition
    return sorted(rows, key=lambda r: _sortable(r["first"]))


def _borders(runs: list[dict]) -> dict[tuple, list[int]]:
    """Keys of pages that are handed to further runs, and these runs."""
    out: dict[tuple, list[int]] = {}
    for step, near, near_lines, far, far_lines, inside in ((1, "first", "head", "last", "tail", "ahead"), (-1, "last", "tail", "first", "head", "after")):
        known = None  # the border of the run passed last
        passed = None
        for k in range(len(runs))[::step]:
            own, border = runs[k], None
            if passed is not None:
                if (passed[far][0], passed[far_lines]) != (own[near][0], own[near_lines]):
                    border = passed[far]
                else:  # copies go on beyond the cut, perhaps over whole runs
                    border = passed[inside] or known
                if border is not None and border[0] != own[near][0]:
                    border = None
            if border is not None:
                out.setdefault(tuple(border), []).append(k)
            known, passed = border, own
    return out


def main_text(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: the id, url, text, n_chars, and of the method n_lines and n_shared (lines that the neighbour has too)."""
    url = F.col(f"`{url_col}`").cast("string")
    rows = pages.select(F.col(f"`{id_col}`").alias("_id"), url.alias("_url"), F.col(f"`{html_col}`").cast("string").alias("_html"), host_of(url).alias("_host"), path_of(url).alias("_path"))
    # pages of one URL are ordered by id, and pages of one id by their html
    order = F.col("_id") if isinstance(rows.schema["_id"].dataType, (IntegralType, StringType)) else F.col("_id").cast("string")
    rows = rows.withColumn("_order", order).withColumn("_hash", F.xxhash64("_html"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def digest(batches):
        for batch in batches:
            found = [hashlib.blake2b("\n".join(x for x, _ in blocks(t.as_py())).encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.binary())], names=[*batch.schema.names[1:], "_lines"])

    slim = rows.select("_html", *_KEY, F.coalesce(F.length("_html"), F.lit(0)).cast("long").alias("_chars"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[1:])
    runs = _cuts(written(spark, slim.mapInArrow(digest, f"{kinds}, _lines binary")), tasks)
    starts = [_sortable(r["first"]) for r in runs]
    borders = _borders(runs)

    @F.arrow_udf("array<int>")
    def dealt(host: pa.Array, path: pa.Array, url: pa.Array, order: pa.Array, hash: pa.Array) -> pa.Array:
        out = []
        for key in zip(*(x.to_pylist() for x in (host, path, url, order, hash)), strict=True):
            out.append([max(bisect_right(starts, _sortable(key)) - 1, 0), *borders.get(key, ())])
        return pa.array(out, pa.list_(pa.int32()))

    # a page's own run comes first
    spread = rows.withColumn("_runs", dealt(*_KEY)).select("*", F.posexplode("_runs").alias("_place", "_run"))
    ordered = spread.repartitionById(tasks, F.col("_run") % tasks).sortWithinPartitions("_run", *_KEY)

    def run(batches):
        before = None
        copies: list[_Page] = []  # a run of pages with the same lines
        out: list[tuple] = []

        def batch_of():
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [kind, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["_id", "_url", "text", "n_chars", "n_lines", "n_shared"])

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for page_id, url_, source, host, path, run_, place in zip(*(batch.column(k) for k in range(7)), strict=True):
                behind = _Page(page_id.as_py(), url_.as_py(), (host.as_py(), run_.as_py()), path.as_py(), place.as_py() == 0, source.as_py())
                if copies and (behind.group != copies[0].group or behind.lines != copies[0].lines):
                    out += [p.row(before, behind) for p in copies if p.own]
                    before = copies[-1]
                    copies = []
                if copies:
                    behind.lines = copies[0].lines
                copies.append(behind)
            yield batch_of()
            out.clear()
        if copies:
            out += [p.row(before, None) for p in copies if p.own]
            yield batch_of()

    ordered = ordered.select("_id", "_url", "_html", "_host", "_path", "_run", "_place")
    out = ordered.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, _url string, text string, n_chars long, n_lines long, n_shared long")
    return out.withColumnsRenamed({"_id": id_col, "_url": url_col})
