import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagelattice.functions import numbers as N
from pagelattice.functions import predicates as P
from pagelattice.functions import stats as S
from pagelattice.functions import text as T


@pytest.mark.parametrize(
    "text, value, unit, state",
    [
        ("1,234.50 EUR", 1234.5, "EUR", "read"),
        ("€ 1.234,50", 1234.5, "EUR", "read"),
        ("-12 %", -12.0, "%", "read"),
        ("1 234 567", 1234567.0, None, "read"),
        ("12,34,567", 1234567.0, None, "read"),
        ("1.234", None, None, "unsettled"),
        ("¥1,234", 1234.0, "JPY", "read"),
        ("0.123", 0.123, None, "read"),
        ("99,-", 99.0, None, "read"),
        ("3'000.5", 3000.5, None, "read"),
        ("from 5", None, None, "no_number"),
        ("1,2,3", None, None, "no_number"),
        ("", None, None, "no_number"),
        (None, None, None, "no_number"),
        ("9" * 70, None, None, "no_number"),
    ],
)
def test_numbers(text, value, unit, state):
    v, u, _, s = N.read_number(text)
    assert (v, s) == (value, state) and (u == unit or state == "no_number")


def test_language_settles_only_without_currency():
    assert N.read_number("1.234", decimal=".")[0] == 1.234
    assert N.read_number("1.234", decimal=",")[0] == 1234.0
    assert N.read_number("$1.234", decimal=".")[3] == "unsettled"


def test_upper_bound_is_the_binomial_one():
    for k, n in ((0, 10), (3, 20), (19, 20)):
        p = S._upper(k, n)
        assert abs(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) - 0.05) < 1e-6
    assert S._upper(5, 5) == 1.0 and S._upper(0, 0) is None


def test_medians_and_poison(spark):
    df = spark.createDataFrame([("a", x, None if x == 3 else 1.0) for x in (5, 1, 4, 3)] + [("b", 7, 2.0)], "k string, v int, c double")
    rows = {r.k: r for r in df.groupBy("k").agg(S.upper_median("v").alias("u"), S.lower_median("v").alias("l"), S.median(F.col("v")).alias("m"), S.p95("v").alias("p"), S.poisoning_sum(F.col("c")).alias("s"), S.known_subtotal(F.col("c")).alias("t")).collect()}
    assert (rows["a"].u, rows["a"].l, rows["a"].m, rows["a"].p) == (4, 3, 3.5, 5) and rows["a"].s is None and rows["a"].t == (3.0, True)
    assert (rows["b"].u, rows["b"].l, rows["b"].p, rows["b"].s) == (7, 7, 7, 2.0)


def test_text(spark):
    df = spark.createDataFrame([("日本 abcd😀",), ("n/a.",), ("\xa0Keine  Angabe\t",), (None,), ("x​y",)], "t string")
    rows = df.select(T.utf16_length(F.col("t")).alias("n"), T.estimate_tokens(F.col("t")).alias("k"), T.states_absence(F.col("t")).alias("a"), T.visible(F.col("t")).alias("v")).collect()
    assert (rows[0].n, rows[0].k) == (9, 4) and [r.a for r in rows] == [False, True, True, False, False] and rows[4].v == "xy"
    r = spark.range(1).select(T.round_half_up(F.lit(0.285)).alias("x")).first()
    assert r.x == math.floor(0.285 * 100 + 0.5) / 100


def test_retry_after(spark):
    now = F.lit(datetime(2026, 1, 1)).cast("timestamp")
    df = spark.createDataFrame([("120",), ("Thu, 01 Jan 2026 00:01:00 GMT",), ("Wed, 31 Dec 2025 00:00:00 GMT",), ("later",), (None,)], "v string")
    assert [r.x for r in df.select(T.retry_after_ms(F.col("v"), now).alias("x")).collect()] == [120000, 60000, 0, None, None]


def test_contract(spark):
    df = spark.createDataFrame([("success", "# A\n\n| a |\n| --- |\n| 1 |"), ("success", "no"), ("failed", "# A"), ("empty_verified", ""), ("success", None)], "s string, m string")
    c = {"checks": [{"type": "markdownIncludes", "text": "# A"}, {"type": "minTables", "min": 1}, {"type": "markdownMatches", "pattern": "^# "}], "emptyOk": True}
    rows = df.select(P.verify(c, F.col("m"), F.col("s")).alias("v")).collect()
    assert [(r.v.passed, r.v.reason) for r in rows] == [(True, None), (False, "check_failed"), (None, "page_not_read"), (True, "empty"), (None, "undecided")]
    with pytest.raises(ValueError):
        P.verify({"checks": [{"type": "nothing"}]}, F.lit(""))


def test_record_checks(spark):
    df = spark.createDataFrame([([{"a": "1", "b": "x"}, {"a": "2", "b": "y"}],), ([{"a": "1", "b": ""}, {"a": "1", "b": "y"}],), ([],)], "r array<map<string,string>>")
    c = {"checks": [{"type": "listRecordsMin", "min": 2}, {"type": "recordFields", "fields": ["a", "b"], "uniqueBy": "a"}, {"type": "tableRowsMin", "min": 2, "columns": ["a"]}]}
    v = P.verify(c, F.lit("x"), tables=F.col("r"), records=F.col("r"))
    assert [r.p for r in df.select(v["passed"].alias("p")).collect()] == [True, False, False]


def test_gates(spark):
    rows = [(429, {}, "x"), (200, {}, "Just a moment"), (200, {}, "just a moment " + "y" * 5000), (403, {}, ""), (None, {}, "captcha"), (200, {"cf-mitigated": "challenge"}, None), (401, {}, None)]
    df = spark.createDataFrame(rows, "s int, h map<string,string>, b string")
    assert [r.g for r in df.select(P.gate(F.col("s"), F.col("h"), F.col("b"))["reason"].alias("g")).collect()] == ["rate_limit", "challenge", None, None, None, "challenge", "login_wall"]


def test_readings_of_the_two_readers_are_equal(spark):
    """The expressions of the JVM against the plain reader, over forms put together at random."""
    import random

    rng = random.Random(5)
    pieces = ["$", "€", "USD", "eur", "kr", "JPY", "%", " ", "\u00a0", "-", "+", "\u2212", "1", "0", "12", "123", "1234", "000", ",", ".", "'", "\u2019", "x", "\u2013", "zł", "CA"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(9))) for _ in range(6000)]
    texts += ["1,234.56", "1.234,56 €", "12,34,567.89", "12,34,567", "1'234.5", "1 234,5", "1.234", "0.123", "¥1,234", "5,-", "5.–", "1" * 19, "9" * 70, "", None, " 7 ", "12.3.4", "1,2,3"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for decimal in (None, ".", ","):
        got = {r.i: tuple(r.r) for r in N.with_readings(df, "t", "r", decimal).collect()}
        for i, t in enumerate(texts):
            assert got[i] == N.read_number(t, decimal), (t, decimal)
