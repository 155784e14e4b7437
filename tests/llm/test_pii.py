import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corpusforge.llm.pii import KINDS, LONGEST, SpanField, base_spans, candidates_of, detected, features, learn, luhn, masked, places, shown, train

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    """The base patterns as they are written."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@pytest.fixture(scope="module")
def field():
    return train([("the 12 of", []), ("due 2024-01-15 at", [])])


def test_base_spans_match_the_patterns():
    draw = random.Random(1)
    bits = ["1", "2", "0", "9", "45", "255", "256", "4111111111111111", "+", "@", ".", "-", " ", "(", ")", "a", "b_", "%", "é", "٣", "\n", "x@y.z", "1.2.3.4", "+1 (212) 555-0147"]
    for _ in range(30000):
        text = "".join(draw.choice(bits) for _ in range(draw.randint(1, 16)))
        assert base_spans(text) == brute(text)
    assert base_spans("7" * 300000) == [] and base_spans("x" * 300000 + "@") == []
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_finds_forms_the_patterns_miss_and_leaves_numbers_alone(field):
    for text, want in [
        ("call (212) 555-0147.", ("phone", "(212) 555-0147")),
        ("call 212-555-0147 now", ("phone", "212-555-0147")),
        ("write bob [at] example [dot] com today", ("email", "bob [at] example [dot] com")),
        ("card 4111.1111.1111.1111 ok", ("card", "4111.1111.1111.1111")),
    ]:
        assert base_spans(text) == []
        assert [(k, text[a:b]) for k, a, b in field.spans(text, [])] == [want]
    for text in ("on 2024-01-15 at 12:30", "version 2.0.1 of 1,234,567.89", "order 1234567890123", 'token = "1eb9c654e721b4f812088970e66a6345cee33dd6"', "3. one\n4. two", ""):
        assert field.spans(text, base_spans(text)) == []


def test_spelled_out_addresses_are_found_whole(field):
    """Dotted names, several host labels, and more tokens than other candidates may have."""
    for address in ("ann.lee@mail.example.com", "name.17@mail3.example.com", "j_roe7@example.org", "ann.b.lee-smith+news_2024@a.b-c.mail3.dept.example.co.uk", ".".join("abcdefghijkl") + "@" + ".".join(f"x{k}" for k in range(9)) + ".example.com"):
        name, host = address.split("@")
        for at, dot in ((" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(AT)", "."), (" [at] ", ".")):
            form = name + at + host.replace(".", dot)
            text = f"write {form} today"
            assert base_spans(text) == []
            assert [(k, text[a:b]) for k, a, b in field.spans(text, [])] == [("email", form)]


def test_long_examples_are_learned_from():
    """A base span of more tokens than candidates have is a candidate where it is known."""
    card = "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"
    base = base_spans(card)
    bounds, candidates = candidates_of(card, 0, len(card), base)
    assert base == [("card", 0, len(card))] and len(bounds) - 1 > LONGEST
    assert (0, len(bounds) - 1) in {(i, j) for i, j, _ in candidates}
    for text in ("a." * 2000, "a@b." * 500, "a [at] " * 500, "x" * 300000 + " (at) b"):
        assert candidates_of(text, 0, len(text), [])


def test_best_segmentation_is_the_best_of_all(field):
    """Dynamic programming against the enumeration of all sets of spans that do not overlap."""

    def all_best(bounds, candidates):
        options = [(i, j, k, s - field.margin) for i, j, names in candidates for k, s in enumerate(field.score(names))]

        def best(at):
            if at >= len(bounds) - 1:
                return 0.0
            return max([best(at + 1)] + [s + best(j) for i, j, k, s in options if i == at and s > 0])

        return best(0)

    for text in ("a 212-555-0147 b", "x (at) y.example.org 212.555.0147", "+1 212 4111.1111.1111.1111"):
        bounds, candidates = candidates_of(text, 0, len(text))
        place = {b: k for k, b in enumerate(bounds)}
        found = field.best(text, 0, len(text), [])
        scores = {(i, j): field.score(names) for i, j, names in candidates}
        got = sum(scores[place[a], place[b]][KINDS.index(kind)] - field.margin for kind, a, b in found)
        assert math.isclose(got, all_best(bounds, candidates), rel_tol=1e-9, abs_tol=1e-9)
        assert all(place[b] - place[a] <= LONGEST for _, a, b in found)


def test_places_cover_all_triggers_apart():
    draw = random.Random(2)
    for _ in range(3000):
        text = "".join(draw.choice(["a", "bc", " ", "  ", "\n", "1", "@", "[at]", ".", "x"]) for _ in range(draw.randint(0, 30)))
        found = places(text)
        assert all(a < b for a, b in found) and all(x[1] < y[0] or x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))
        for m in re.finditer(r"[0-9@]|\[at\]", text):
            assert any(a <= m.start() and m.end() <= b for a, b in found)


def test_query_and_edges(spark, field):
    rows = [(1, None), (2, ""), (3, "mail a.b@c.de, +1 (212) 555-0147; 4111 1111 1111 1111 at 10.0.0.1"), (3, "no data"), (None, "x@y.zz é x@y.zz"), (4, "1 " * 3000), (5, "+1 (843) 555-7672 170.106.4.1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("x"))
    out = docs.select("doc_id", "text", detected(field).alias("p"), masked(field).alias("m")).collect()
    assert len(out) == len(rows)
    for r in out:
        base = brute(r.text or "")
        assert r.p.base == shown(base)
        assert [r.p.n_email, r.p.n_ip, r.p.n_card, r.p.n_phone] == [sum(k == x for k, _, _ in base) for x in KINDS]
        assert set(r.p.base.split(",")) <= set(r.p.spans.split(",")) or not r.p.base
    by = {(r.doc_id, r.text): r for r in out}
    assert by[1, None].m is None and by[2, ""].m == ""
    assert by[3, rows[2][1]].m == "mail <email>, <phone>; <card> at <ip>"
    assert by[None, rows[4][1]].m == "<email> é <email>"
    learned = learn(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert isinstance(learned, SpanField) and learned.weights
    assert learn(docs.limit(0)).weights
    assert docs.limit(0).select(detected(field).alias("p")).count() == 0


def test_long_texts_take_linear_time(field):
    """A megabyte of numbers on one line, taken or not, and of log lines."""
    draw = random.Random(2)
    phones = " ".join(f"+1 ({draw.randrange(200, 999)}) 555-{draw.randrange(10000):04d}" for _ in range(55_000))
    numbers = " ".join(f"{draw.randrange(200, 999)}-{draw.randrange(10000):04d}" for _ in range(110_000))
    log = "\n".join(f"2024-01-{k % 18 + 10} 12:{k % 49 + 10}:07 INFO 10.{k % 256}.1.7 GET /a/{draw.randrange(10**6)} 200 user{k % 99}@ex.org" for k in range(14_000))
    for text in (phones, numbers, log):
        assert len(text) > 900_000
        start = time.process_time()
        base = base_spans(text)
        found = field.spans(text, base)
        assert time.process_time() - start < 30
        assert set(base) <= set(found)
        part = text[: text.rindex(" ", 0, 3000)]
        assert {s for s in found if s[2] < 2900} == {s for s in field.spans(part, base_spans(part)) if s[2] < 2900}


def test_shapes_score_as_their_spans(field):
    """Scores that are kept by shape are those of the features; a small bound on kept shapes changes nothing."""
    draw = random.Random(6)
    for _ in range(3000):
        text = "".join(draw.choice(["1", "29", "256", "4111", "0", "-", ".", " ", "(", ")", "+", "a", "at", "@", "é"]) for _ in range(draw.randint(1, 14)))
        a = draw.randrange(len(text))
        b = draw.randrange(a + 1, len(text) + 1)
        names = features(text, a, b)
        assert field.scored(text, a, b) == (None if names is None else field.score(names))
