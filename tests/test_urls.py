import pytest
from pyspark.sql import functions as F

from webloom.functions import patterns, urls


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://Www.X.com", "http://www.x.com/"),
        ("http://x.com/a/./b/../c", "http://x.com/a/c"),
        ("http://x.com//a///b/", "http://x.com/a/b/"),
        ("http://x.com/a/..", "http://x.com/"),
        ("http://x.com/../../a/b/..", "http://x.com/a/"),
        ("http://x.com/é b#top", "http://x.com/%C3%A9%20b"),
        ("http://x.com/foo./bar", "http://x.com/foo./bar"),
        ("http://x.com/p?a=1&amp;b=c d#f", "http://x.com/p?a=1&b=c+d"),
        ("http://x.com:8080/", "http://x.com:8080/"),
        ("mailto:a@b.c", None),
        ("http://a_b.com/", None),
        ("http://x.com?q", None),
        (None, None),
        ("", None),
    ],
)
def test_normalized(spark, url, want):
    got = one(spark, urls.normalized(F.col("u")), u=url)
    assert got == want
    if got:
        assert one(spark, urls.normalized(F.col("u")), u=got) == got


@pytest.mark.parametrize(
    ("link", "want"),
    [
        ("/r", "http://x.com/r"),
        ("s.html", "http://x.com/d/s.html"),
        ("../t", "http://x.com/t"),
        ("?q=1", "http://x.com/d/?q=1"),
        ("//other.com/p", "http://x.com/other.com/p"),
        ("https://y.com/z", "https://y.com/z"),
        ("javascript:void(0)", None),
        ("host:8080/x", None),
    ],
)
def test_resolved(spark, link, want):
    assert one(spark, urls.resolved(F.col("b"), F.col("l")), b="http://x.com/d/e.html?k=1", l=link) == want


def test_resolved_by_the_standard(spark):
    for link, want in (("//other.com/p", "http://other.com/p"), ("?q=1", "http://x.com/d/e.html?q=1")):
        assert one(spark, urls.resolved(F.col("b"), F.col("l"), True), b="http://x.com/d/e.html?k=1", l=link) == want


@pytest.mark.parametrize(("text", "want"), [("x.com", "http://x.com"), ("ftp.x.com/a", "ftp://ftp.x.com/a"), ("/tmp/a", "file:///tmp/a"), ("./a", "file://./a"), ("https:b", "https:b")])
def test_guess_scheme(spark, text, want):
    assert one(spark, urls.guess_scheme(F.col("u")), u=text) == want


def test_parts(spark):
    u = "http://www.X.com/a/b.c/File.HTML?x=/y.z#f"
    pick = {urls.extension: "html", urls.directory: "/a/b.c/", urls.file_part: "File.HTML?x=/y.z", urls.is_dynamic: True, urls.download_name: "File.HTML"}
    for f, want in pick.items():
        assert one(spark, f(F.col("u")), u=u) == want
    assert one(spark, urls.host_key(urls.host(F.col("u"))), u=u) == "x.com"
    assert one(spark, urls.download_name(F.col("u")), u="http://x.com/d/") == "index.html"
    a, b = "http://x.com/A", "https://X.com/a"
    assert one(spark, urls.dedup_key(F.col("u")), u=a) == one(spark, urls.dedup_key(F.col("u")), u=b)
    assert one(spark, urls.is_external(F.col("a"), F.col("b")), a=a, b=b)
    assert not one(spark, urls.is_external(F.col("a"), F.col("b")), a=a, b="http://www.x.com/")
    assert one(spark, urls.search_url("http://s.com/?q={}&n=1", F.col("w")), w="a b") == "http://s.com/?q=a+b&n=1"


@pytest.mark.parametrize(
    ("pattern", "url", "want"),
    [
        ("FILE<*.html>", "http://x.com/a.html", True),
        ("*.html", "http://x.com/a.htm", False),
        ("PATH(/a/*)", "http://x.com/a/b", True),
        ("HOST{*x.com} PATH</b*>", "http://www.x.com/a", False),
        ("FULL<*://*com/*z>", "http://x.com/yz", True),
        ("FILE|a*b|", "http://x.com/a.b", True),
        ("FILE<a[?]c>", "http://x.com/abc", True),
        ("FILE<a[?]c>", "http://x.com/abbc", False),
        ("FILE<*>", "http://x.com/", True),
        ("FILE<ab>", "http://x.com/ab", True),
    ],
)
def test_patterns(spark, pattern, url, want):
    assert one(spark, patterns.matches(F.col("u"), pattern), u=url) is want


@pytest.mark.parametrize("pattern", ["", "FILE<a", "FILE<a> b", "FILE<[!]>", "PATH"])
def test_malformed_patterns(pattern, spark):
    with pytest.raises(ValueError):
        patterns.matches(F.col("u"), pattern)
