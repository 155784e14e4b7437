"""Golden values (FIXTURES.md section 4)."""

import math

import numpy as np

import pytest
from pyspark.sql import functions as F

from corpusforge.functions.arrays import argmax
from corpusforge.functions.charset import resolve_text
from corpusforge.functions.html import content_type_charset, fetch_time_seconds, is_root_page, looks_like_html, parse_warc_date
from corpusforge.functions.student_t import t_cdf
from corpusforge.functions.text import btrim, strim
from corpusforge.operators import batching as B
from corpusforge.operators import metrics as M
from corpusforge.operators import split as S
from corpusforge.operators import trials as TR
from corpusforge.operators.vocab import VocabSpec, audit_specials

ALPHA = "abcdefghijklmnopqrstuvwxyz"


def one(spark, col, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).collect()[0]["r"]


@pytest.mark.parametrize("size,want", [(10, "abc…20…xyz"), (20, "abcdefghi…9…stuvwxyz"), (3, "a…z"), (2, "a…"),
                                       (1, "…"), (0, ""), (26, ALPHA)])
def test_strim(spark, size, want):
    assert one(spark, strim(F.col("v"), size), ALPHA) == want


def test_strim_long(spark):
    assert one(spark, strim(F.col("v"), 10), "x" * 106) == "xxx…101…xx"


@pytest.mark.parametrize("text,size,want", [
    (ALPHA, 20, "abcdef…14…uvwxyz"), (ALPHA, 26, ALPHA), ("é" * 30, 30, ""), ("é" * 20, 30, "ééé…14…ééé"),
    (ALPHA * 4, 30, "abcdefghijk…82…pqrstuvwxyz"), ("漢" * 100, 30, ""),
])
def test_btrim(spark, text, size, want):
    assert one(spark, btrim(F.col("v"), size), text) == want


def test_metrics_golden(spark):
    df = spark.createDataFrame([([2.0, 0.0], 0), ([0.0, 1.0], 1), ([1.0, 0.0], 1)], "scores array<double>, ref int")
    r = M.evaluate(df).collect()[0]
    assert round(r["acc"], 6) == 0.666667
    assert round(r["mcc"], 6) == 0.5
    assert round(r["rpb"], 6) == 0.371179
    hard = {(x["ref"], x["pred"]): x["weight"] for x in M.confusion(df, width=2).collect()}
    assert hard == {(0, 0): 1.0, (0, 1): 0.0, (1, 0): 1.0, (1, 1): 1.0}
    soft = {(x["ref"], x["pred"]): round(x["weight"], 6) for x in M.confusion(df, soft=True).collect()}
    assert soft == {(0, 0): 0.880797, (0, 1): 0.119203, (1, 0): 1.0, (1, 1): 1.0}


def test_mcc_single_class_is_zero(spark):
    df = spark.createDataFrame([([1.0, 0.0], 0), ([3.0, 0.0], 0)], "scores array<double>, ref int")
    assert M.evaluate(df).collect()[0]["mcc"] == 0.0


def test_argmax_first_max(spark):
    assert one(spark, argmax(F.col("v")), [1.0, 3.0, 3.0], "v array<double>") == 1


@pytest.mark.parametrize("body,want", [("\n <HTML>", True), ("<!-- x", True), ("<p >", True), ("<a href>", True),
                                       ("<!--x", False), ("<hr>", False), ("%PDF-1.4", False), ("plain", False), ("", False)])
def test_sniff(spark, body, want):
    assert one(spark, looks_like_html(F.col("v")), body.encode(), "v binary") is want


@pytest.mark.parametrize("url,want", [("http://a.com", True), ("https://a.com/", True), ("https://a.com?q=1", True),
                                      ("http://a.com:80/", True), ("HTTP://a.com/", False), ("https://a.com/x", False),
                                      ("https://a.com//", False), ("https://a.com/\n", False), (None, False)])
def test_root_page(spark, url, want):
    assert one(spark, is_root_page(F.col("v")), url) is want


def test_fetch_time_and_date(spark):
    got = [one(spark, fetch_time_seconds(F.col("v")), v) for v in ("fetchTimeMs: 1500\r\n", "fetchTimeMs: 0\r\n", "x: 1\r\n", "fetchTimeMs: \r\n")]
    assert got == [1.5, 0.0, None, None]
    d = one(spark, parse_warc_date(F.col("v")), "2017-03-23T12:34:56Z")
    assert str(d) == "2017-03-23 12:34:56"


def test_content_type_charset(spark):
    assert one(spark, content_type_charset(F.col("v")), 'text/html; charset="ISO-8859-1"') == "ISO-8859-1"
    assert one(spark, content_type_charset(F.col("v")), "text/html; Charset=utf-8; x=y") == "utf-8"
    assert one(spark, content_type_charset(F.col("v")), "text/html") is None


def _resolve(spark, body: bytes, ctype, scoring="compat"):
    df = spark.createDataFrame([(body, ctype)], "b binary, c string")
    return df.select(resolve_text(F.col("b"), F.col("c"), scoring).alias("r")).collect()[0]["r"]


def test_charset_goldens(spark):
    r = _resolve(spark, "é".encode(), "text/html; charset=ISO-8859-1")
    assert r["text"] == "Ã©" and r["charset"] == "iso8859-1"
    r = _resolve(spark, "é".encode(), "text/html; charset=ISO-8859-1", "fewest_replacements")
    assert r["text"] == "é"
    assert _resolve(spark, b"A\xffB", None)["text"] == "A�B"
    assert _resolve(spark, b"\xed\xa0\x80", None)["text"] == "�" * 3
    bom = _resolve(spark, b"\xef\xbb\xbfhi", None)
    assert bom["text"] == "﻿hi" and bom["charset"] == "utf-8"
    le = _resolve(spark, b"\xff\xfeh\x00i\x00", None)
    assert le["charset"] in ("utf-8", "utf-16-le")
    unknown = _resolve(spark, b"abc", "text/html; charset=x-nope")
    assert unknown["charset"] == "utf-8" and unknown["score"] == -3.0


def test_charset_score_values(spark):
    from corpusforge.functions.charset import decode_score

    assert one(spark, decode_score(F.col("v")), "abcd") == -4.0
    assert one(spark, decode_score(F.col("v")), "ab�") == 0.0
    assert one(spark, decode_score(F.col("v")), "abcdefg��") == pytest.approx(3.0)


def test_packing_golden(spark):
    rows = [(0, 0, 1, [1, 2, 3]), (0, 0, 2, [4, 5, 6, 7]), (0, 0, 3, [8, 9]), (0, 1, 1, [1, 2]), (0, 2, 1, [])]
    df = spark.createDataFrame(rows, "bucket int, batch int, rn int, input_ids array<int>")
    df = df.withColumn("attention_mask", F.transform("input_ids", lambda _x: F.lit(1)))
    out = {(r["batch"], r["block"]): r["input_ids"] for r in B.pack_blocks(df, 4).collect()}
    assert out == {(0, 0): [1, 2, 3, 4], (0, 1): [5, 6, 7, 8], (1, 0): [1, 2]}


def test_auto_split_counts(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    counts = {r["split"]: r["count"] for r in S.auto_split(df, "k").groupBy("split").count().collect()}
    assert counts == {"train": 875, "validation": 62, "test": 63}


def test_asof_golden(spark):
    rows = [("c", 1, 1, 1.0, 0.1), ("c", 1, 2, 2.0, 0.2), ("c", 1, 3, 5.0, 0.5), ("c", 2, 4, 2.0, 0.3), ("c", 2, 5, 3.0, 0.4)]
    s = spark.createDataFrame(rows, "cohort string, trial_id long, seq long, t double, metric double")
    got = {r["trial_id"]: (r["x"], r["metric"]) for r in TR.common_snapshot(s).collect()}
    assert got == {1: (3.0, 0.5), 2: (3.0, 0.4)}
    roster = spark.createDataFrame([("c", 1), ("c", 2), ("c", 3)], "cohort string, trial_id long")
    assert TR.common_snapshot(s, roster).count() == 0


def test_student_t_cdf():
    assert abs(t_cdf(1, 1) - 0.75) < 1e-9
    assert abs(t_cdf(math.sqrt(2), 2) - 0.853553) < 1e-6
    assert t_cdf(0, 7) == 0.5


def test_vocab_spec():
    s = VocabSpec.parse("cc-html8K,sw=f,sd=t")
    assert s.size == 8192 and not s.split_by_whitespace and s.split_digits
    with pytest.raises(ValueError):
        VocabSpec.parse("cc-html8K,sd=t,sw=f")


def test_specials_audit(spark):
    voc = spark.createDataFrame(
        [(0, "<unk>", 0.0, "UNKNOWN"), (1, "<s>", 0.0, "CONTROL"), (2, "</s>", 0.0, "CONTROL"), (3, "<pad>", 0.0, "CONTROL"), (4, "a", -1.0, "NORMAL")],
        "id int, piece string, score float, type string",
    )
    report, out = audit_specials(voc)
    st = {r["piece"]: r["status"] for r in report.collect()}
    assert st["<pad>"] == "ok" and st["<mask>"] == "appended"
    assert out.where("piece = '<mask>'").collect()[0]["id"] == 5
    bad = voc.where("piece != '<s>'")
    with pytest.raises(ValueError):
        audit_specials(bad)


def test_final_metrics_status(spark):
    log = spark.createDataFrame(
        [(1, 1, 1.0, None), (1, 2, 0.5, None), (1, 2, None, 0.7), (2, 3, 0.4, None), (3, 2, 0.3, None), (3, 2, 0.2, None)],
        "run_id long, step int, train_loss double, eval_loss double",
    )
    got = {r["run_id"]: (r["train_status"], r["eval_status"], r["eval_loss"]) for r in TR.final_metrics(log).collect()}
    assert got == {1: ("ok", "ok", 0.7), 2: ("ok", "missing", None), 3: ("ambiguous", "missing", None)}


def fitted(values):
    """Maximum likelihood by a fine scan of the degrees of freedom, for comparison."""
    y = np.array(values)

    def profile(nu):
        mu, sd = np.median(y), y.std()
        for _ in range(500):
            w = (nu + 1) / (nu + ((y - mu) / sd) ** 2)
            mu = (w * y).sum() / w.sum()
            sd = math.sqrt((w * (y - mu) ** 2).sum() / len(y))
        z = (y - mu) / sd
        one = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - math.log(sd)
        return len(y) * one - (nu + 1) / 2 * np.log1p(z * z / nu).sum(), mu, sd

    best = max(np.exp(np.linspace(math.log(0.05), math.log(1e6), 400)), key=lambda nu: profile(nu)[0])
    return best, *profile(best)[1:]


def test_t_fit_is_the_likeliest_at_any_size(spark):
    rng = np.random.default_rng(8)
    cohorts = {"heavy": rng.standard_t(2.5, 60) * 3 + 5, "light": rng.normal(1, 0.1, 300), "few": np.array([1.0, 2.0, 4.0])}
    rows = [(c, k, k, 1.0, float(v)) for c, vs in cohorts.items() for k, v in enumerate(vs)]
    rows += [("two", 1, 1, 1.0, 1.0), ("two", 2, 2, 1.0, 2.0), ("flat", 1, 1, 1.0, 3.0), ("flat", 2, 2, 1.0, 3.0), ("flat", 3, 3, 1.0, 3.0), ("heavy", 99, 1, 1.0, float("nan"))]
    series = spark.createDataFrame(rows, "cohort string, trial_id long, seq long, t double, metric double")
    got = {(r.cohort, r.trial_id): r for r in TR.flag_outliers(series).collect()}
    assert len(got) == len(rows)
    for c in ("heavy", "light"):
        want = t_cdf(cohorts[c], *fitted(cohorts[c]))
        for k, p in enumerate(want):
            assert abs(got[c, k].p - p) < 2e-3
            assert got[c, k].outlier == (got[c, k].p <= 0.15)
    assert got["heavy", 99].p is None and got["two", 1].p is None and not got["flat", 2].outlier


def test_one_hot(spark):
    from corpusforge.functions.arrays import one_hot

    assert one(spark, one_hot(F.col("v"), 4), 2, "v int") == [0.0, 0.0, 1.0, 0.0]


@pytest.mark.parametrize("head,want", [
    ('<meta charset="utf-8">', "utf-8"),
    ("<meta charset=windows-1251 >", "windows-1251"),
    ('<meta http-equiv="Content-Type" content="text/html; charset=ISO-8859-2">', "ISO-8859-2"),
    ('<meta content="text/html; charset=koi8-r" http-equiv=content-type>', "koi8-r"),
    ('<meta name="x" content="charset=big5">', None),          # no http-equiv: content is ignored
    ('<!-- <meta charset="gbk"> --><meta charset="utf-8">', "utf-8"),
    ('<meta name="a"><meta charset="euc-jp">', "euc-jp"),
    ("<html><body>no meta</body></html>", None),
])
def test_prescan(spark, head, want):
    from corpusforge.functions.charset import prescan_label

    assert one(spark, prescan_label(F.col("v")), head.encode(), "v binary") == want


def test_asof_roster_active(spark):
    rows = [("c", 1, 1, 1.0, 0.1), ("c", 1, 2, 5.0, 0.5), ("c", 2, 3, 3.0, 0.4), ("c", 3, 4, 0.5, 9.0)]
    s = spark.createDataFrame(rows, "cohort string, trial_id long, seq long, t double, metric double")
    roster = spark.createDataFrame([("c", 1, True), ("c", 2, True), ("c", 3, False)], "cohort string, trial_id long, active boolean")
    got = {r["trial_id"]: (r["x"], r["metric"]) for r in TR.common_snapshot(s, roster).collect()}
    assert got == {1: (3.0, 0.5), 2: (3.0, 0.4)}  # trial 3 left the cohort, so x is not pulled down to 0.5


def test_final_metrics_strict_fails_on_ambiguous_run(spark):
    log = spark.createDataFrame([(3, 2, 0.3, None), (3, 2, 0.2, None)], "run_id long, step int, train_loss double, eval_loss double")
    with pytest.raises(Exception, match="no single final train row"):
        TR.final_metrics(log, strict=True).collect()


def test_digamma_and_trigamma_are_derivatives():
    from corpusforge.functions.student_t import digamma, trigamma

    for x in (0.03, 0.5, 1.0, 7.9, 8.1, 1e4):
        h = 1e-5 * max(x, 1e-1)
        assert digamma(x)[0] == pytest.approx((math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), rel=1e-5, abs=1e-5)
        assert trigamma(x)[0] == pytest.approx((digamma(x + h)[0] - digamma(x - h)[0]) / (2 * h), rel=1e-5)
    assert digamma(1.0)[0] == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert trigamma(1.0)[0] == pytest.approx(math.pi**2 / 6, abs=1e-12)


def reference_fit(y):
    """Likeliest t by a simplex search from several starts, on plain sums."""
    def cost(v):
        mu, s, t = v
        if not math.log(0.05) <= t <= math.log(1e6):
            return math.inf
        nu, sd = math.exp(t), math.exp(s)
        z = (y - mu) / sd
        one = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - s
        return -(len(y) * one - (nu + 1) / 2 * np.log1p(z * z / nu).sum())

    best = None
    for nu0 in (1.0, 5.0, 50.0):
        points = [np.array([np.median(y), math.log(y.std()), math.log(nu0)])]
        for round_ in range(6):
            size = 0.3 * 0.1**round_
            points = [points[0]] + [points[0] + size * e * [y.std(), 1, 1] for e in np.eye(3)]
            values = [cost(p) for p in points]
            for _ in range(400):
                order = np.argsort(values)
                points, values = [points[k] for k in order], [values[k] for k in order]
                mid = sum(points[:3]) / 3
                away = 2 * mid - points[3]
                f = cost(away)
                if f < values[0]:
                    far = 3 * mid - 2 * points[3]
                    g = cost(far)
                    points[3], values[3] = (far, g) if g < f else (away, f)
                elif f < values[2]:
                    points[3], values[3] = away, f
                else:
                    near = (mid + points[3]) / 2
                    g = cost(near)
                    if g < values[3]:
                        points[3], values[3] = near, g
                    else:
                        points = [points[0]] + [(points[0] + p) / 2 for p in points[1:]]
                        values = [values[0]] + [cost(p) for p in points[1:]]
        if best is None or min(values) < best[0]:
            best = (min(values), points[int(np.argmin(values))])
    mu, s, t = best[1]
    return math.exp(t), mu, math.exp(s)


def test_p_equals_a_reference_optimizer(spark):
    rng = np.random.default_rng(21)
    cohorts = {"t3": rng.standard_t(3, 400) * 2 - 1, "cauchy": rng.standard_cauchy(900), "t8": 5 + 0.01 * rng.standard_t(8, 3000), "ties": np.round(rng.standard_t(4, 500), 1)}
    rows = [(c, k, k, 1.0, float(v)) for c, vs in cohorts.items() for k, v in enumerate(vs)]
    series = spark.createDataFrame(rows, "cohort string, trial_id long, seq long, t double, metric double").repartition(6)
    flags = TR.flag_outliers(series)
    assert flags.columns == ["cohort", "trial_id", "metric", "p", "outlier", "status"]
    got = {(r.cohort, r.trial_id): r for r in flags.collect()}
    for c, vs in cohorts.items():
        want = t_cdf(vs, *reference_fit(vs))
        for k, p in enumerate(want):
            assert got[c, k].status == "converged" and abs(got[c, k].p - p) < 1e-6


def test_fit_states_and_a_large_cohort(spark):
    rng = np.random.default_rng(3)
    rows = [("flat", k, k, 1.0, 1.0) for k in range(9)] + [("two", k, k, 1.0, float(k)) for k in range(2)]
    rows += [("uniform", k, k, 1.0, float(v)) for k, v in enumerate(rng.random(200))]
    rows += [("spike", k, k, 1.0, float(max(0, k - 40))) for k in range(80)]
    series = spark.createDataFrame(rows, "cohort string, trial_id long, seq long, t double, metric double")
    status = {r.cohort: r.status for r in TR.flag_outliers(series).select("cohort", "status").distinct().collect()}
    assert status["flat"] == status["two"] == "no fit" and status["uniform"] == "boundary" and status["spike"] in ("no fit", "unconverged", "boundary", "converged")
    many = spark.range(400_000).select(F.lit("all").alias("cohort"), (F.tan((F.rand(5) - 0.5) * math.pi) * 3 + 1).alias("metric")).checkpoint()
    summary = TR._summary(many)
    assert summary.agg(F.sum("n")).first()[0] == 400_000 and summary.count() < 12_000
    fit = TR.fit_cohorts(many).first()
    assert fit.status == "converged" and fit.nu == pytest.approx(1, abs=0.02) and fit.loc == pytest.approx(1, abs=0.05) and fit.scale == pytest.approx(3, abs=0.05)


def test_softmax_cost_grows_with_the_length(spark):
    import time

    from corpusforge.functions.arrays import softmax

    def seconds(width):
        rows = spark.range(4000).select(F.transform(F.sequence(F.lit(1), F.lit(width)), lambda k: F.sin(k + F.col("id"))).alias("v")).checkpoint()
        run = rows.select(F.aggregate(softmax("v"), F.lit(0.0), lambda a, b: a + b).alias("s")).agg(F.sum("s"))
        run.collect()
        best = math.inf
        for _ in range(3):
            t = time.perf_counter()
            assert run.first()[0] == pytest.approx(4000)
            best = min(best, time.perf_counter() - t)
        return best

    assert seconds(128) < 10 * max(seconds(16), 0.05)
