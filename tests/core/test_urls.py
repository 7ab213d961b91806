import pytest
from pyspark.sql import functions as F

from pagelattice.functions import urls as U


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://User:pw@WWW.Example.test:80/a/B?b=2&a=1&utm_source=x#f", "http://www.example.test/a/B?a=1&b=2"),
        ("https://example.test", "https://example.test/"),
        ("https://example.test:8443/?GCLID=1", "https://example.test:8443/"),
        ("https://example.test/?a=2&a=1&b", "https://example.test/?a=2&a=1&b="),
        ("https://example.test/a%20b c?q=x y", "https://example.test/a%20b%20c?q=x+y"),
        ("ftp://example.test/", None),
        ("mailto:a@b.test", None),
        ("not a url", None),
        ("", None),
        (None, None),
    ],
)
def test_canonical(spark, url, want):
    assert one(spark, U.canonical_url(F.col("u")), u=url) == want


@pytest.mark.parametrize(
    "url, key",
    [
        ("https://www.a.test/x/", "a.test/x"),
        ("http://a.test/", "a.test/"),
        ("https://a.test/x/index.html", "a.test/x"),
        ("https://a.test/index.php?q=1", "a.test/?q=1"),
        ("https://a.test:81/x", "a.test:81/x"),
    ],
)
def test_visit_key(spark, url, key):
    assert one(spark, U.visit_key(F.col("u")), u=url) == key


def test_private_hosts(spark):
    for h, private in {"127.0.0.1": True, "10.2.3.4": True, "172.20.1.1": True, "172.40.1.1": False, "a.local": True, "[::1]": True, "example.test": False}.items():
        assert one(spark, U.is_private_host(F.col("h")), h=h) is private


def test_redirects(spark):
    r = U.redirected_off_page(F.col("a"), F.col("b"))
    assert one(spark, r, a="https://a.test/x/y", b="https://a.test/") is True
    assert one(spark, r, a="https://a.test/x", b="http://www.a.test/x/") is False
    assert one(spark, r, a=None, b="https://a.test/") is False


def test_file_names(spark):
    f = U.response_file_name(F.col("u"), F.col("d"))
    assert one(spark, f, u="https://a.test/p/x%20y.pdf?z=1", d=None) == "x y.pdf"
    assert one(spark, f, u="https://a.test/", d='attachment; filename="a b.csv"') == "a b.csv"
    assert one(spark, f, u="https://a.test/", d="attachment; filename=x; filename*=UTF-8''%C3%A9.txt") == "é.txt"
    assert one(spark, f, u="https://a.test/", d=None) == "file"
    assert one(spark, U.amazon_asin(F.col("u")), u="https://shop.test/x/dp/B00abcdefg?y") == "B00ABCDEFG"


def test_undecided_and_unsafe(spark):
    assert one(spark, U.path_allowed(F.col("p"), ["^/a"]), p=None) is None
    assert U.unsafe_regex("(a+)+") and U.unsafe_regex("(a|b)*") and U.unsafe_regex("(") and U.unsafe_regex("x" * 600) and U.unsafe_regex(r"(a)\1")
    assert U.unsafe_regex(r"^/prices/\d+$") is None
