import datetime
import os
import random
import subprocess
import sys
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from webloom import engine
from webloom.engine import Engine, attributes_of, run_chain
from webloom.functions import extract, urls, xmlconv
from webloom.operators import commands, filetypes, frontier, rules, store
from webloom.operators.filetypes import PENDING, Crawler, FileType
from webloom.plans import config
from webloom.session import cut
from webloom.sources import pages
from webloom.streaming import jobs


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("x")).first().x


TYPES = [FileType("html", ("html",), ("text/html",), "html"), FileType("pic", ("png",), ("image/",)), FileType("wiki", expr="PATH</wiki/*>")]


@pytest.mark.parametrize(
    ("policies", "url", "want"),
    [
        ({}, "http://x.com/a.html", "html"),
        ({}, "http://x.com/a.xyz", PENDING),
        ({"unknown_url": "discard"}, "http://x.com/a.xyz", None),
        ({"unknown_url": "@pic"}, "http://x.com/a.xyz", "pic"),
        ({}, "http://x.com/wiki/a.xyz", "wiki"),
        ({"dir_url": "@html"}, "http://x.com/d/", "html"),
        ({}, "http://x.com/wiki/d/", "wiki"),
        ({"extless_url": "discard"}, "http://x.com/d", None),
        ({"dynamic_url": "@html"}, "http://x.com/d?x", "html"),
        ({"dynamic_url": "discard"}, "http://x.com/wiki/d?x", "wiki"),
        ({"dynamic_url": "discard"}, "http://x.com/a.png?x", "pic"),
        ({}, "http://x.com/a.png?x", PENDING),
        ({}, "ftp://x.com/d/", None),
        ({"ftp_dir_url": "@html"}, "ftp://x.com/d/", "html"),
        ({}, "ftp://x.com/a.png", "pic"),
    ],
)
def test_classify(spark, policies, url, want):
    assert one(spark, filetypes.classify(F.col("v"), Crawler("c", **policies), TYPES), url) == want


def test_mime_lookup_and_route(spark):
    df = spark.createDataFrame([("http://x.com/a",), ("http://x.com/b",)], "url string")
    mime = spark.createDataFrame([("http://x.com/a", "IMAGE/png; q=1")], "url string, content_type string")
    assert [(r.url, r.filetype) for r in filetypes.sort_urls(df, "url", Crawler("c"), TYPES, mime).collect()] == [("http://x.com/a", "pic")]
    assert filetypes.sort_urls(df, "url", Crawler("c"), TYPES).count() == 0
    for kind, external, c, want in (("pic", True, Crawler("c"), "target"), ("html", False, Crawler("c"), "frontier"), ("html", True, Crawler("c"), "drop"), ("html", True, Crawler("c", external=True), "pending"), ("html", True, Crawler("c", external_peek=1), "peek"), (None, False, Crawler("c"), "drop")):
        assert one(spark, filetypes.route(F.col("v"), F.lit(external), c, TYPES), kind) == want


def test_robots(spark):
    body = "Disallow: /first\nUser-agent: bot\r\nDisallow: /x # c\nAllow: /x/ok\nDisallow:\nuser-agent: other\ndisallow: /"
    got = [(r.allow, r.prefix) for r in one(spark, rules.robots_rules(F.col("v"), "MyBot/2"), body)]
    assert got == [(False, "/first"), (False, "/x"), (True, "/x/ok")]
    for path, want in (("/x/1", False), ("/x/ok/1", True), ("/y", True), ("/first", False)):
        assert one(spark, rules.allowed(F.lit(path), rules.robots_rules(F.col("v"), "MyBot/2")), body) is want
    assert one(spark, rules.allowed(F.lit("/a"), rules.robots_rules(F.col("v"), "b")), None) is True


def test_jail(spark):
    for url, want in (("http://x.com/dir/a", True), ("http://x.com/dir2/a", False), ("http://y.com/dir/a", False), ("http://www.x.com/DIR/", True)):
        assert one(spark, rules.in_jail(F.col("v"), F.lit("http://x.com/dir/index.html")), url) is want


def test_links(spark):
    html = """<a href="/a"><A HREF='b.html'>x<img src=c.png><script src="no.js">var x='<a href="no">'</script><a href="#top"><style>p{background:url(s.png)}</style><a class=x href="">"""
    assert one(spark, extract.html_links(F.col("v")), html) == ["/a", "b.html", "c.png"]
    assert one(spark, extract.style_links(F.col("v")), html) == ["s.png"]
    assert one(spark, extract.css_links(F.col("v")), "a{x:url( 'q.png' )} @import url(\"w.css\"); url z;") == ["q.png", "w.css", "z"]
    assert one(spark, extract.text_links(F.col("v")), "see http://x.com/a?b=1, ftp://y.org/z") == ["http://x.com/a?b=1", "ftp://y.org/z"]
    assert one(spark, extract.html_links(F.col("v")), None) is None
    curie = '<html xmlns:w="http://w.org/"><a href="[w:Cat]"><a href="[z:Dog]">'
    assert one(spark, extract.prefixed_links(F.col("v"), extract.html_links(F.col("v"))), curie) == ["http://w.org/Cat", "[z:Dog]"]


def test_texts(spark):
    assert one(spark, extract.decode_entities(F.col("v")), "a &amp; &eacute;&unknown; &lt; &#65; &") == "a & é&unknown; &lt; &#65; &"
    assert one(spark, extract.charset(F.lit("text/html; charset=ISO-8859-1"), F.col("v")), "") == "iso-8859-1"
    assert one(spark, extract.charset(F.lit(None).cast("string"), F.col("v")), '<meta charset="windows-1252">') == "windows-1252"
    for name, body, want in (("utf-8", "é".encode(), "é"), ("iso-8859-1", b"\xe9", "é"), ("windows-1252", b"\x80", "€"), ("nonsense", b"a", "a"), ("utf-8", b"\xff", "�")):
        assert one(spark, extract.to_utf8(F.col("v"), F.lit(name)), bytearray(body), "binary") == want
    assert [tuple(m) for m in one(spark, extract.meta(F.col("v")), "<meta content='x y' lang=de name=q><meta name=r content>")] == [("q", "x y")]
    assert [tuple(m) for m in one(spark, extract.meta(F.col("v")), '<meta name="a" content="1"><meta charset="x"><META NAME=\'b\' CONTENT=\'2\'>')] == [("a", "1"), ("b", "2")]
    assert one(spark, extract.title(F.col("v")), "<TITLE lang=x>T</title>") == "T"


@pytest.mark.parametrize(
    ("line", "name", "is_dir", "size", "mtime"),
    [
        ("-rw-rw-r--   2 web      staff       7310 Mar 14  2003 two words", "two words", False, 7310, datetime.datetime(2003, 3, 14)),
        ("drwxr-x---   9 web                  4096 Nov  2  2004 logs", "logs", True, 4096, datetime.datetime(2004, 11, 2)),
        ("lrwxrwxrwx   1 web      staff         11 Jun 30  2020 now -> logs/latest", "now", False, 11, datetime.datetime(2020, 6, 30)),
        ("-rw-r--r--   1 a b 9 Dec 31 10:20 f", "f", False, 9, datetime.datetime(2025, 12, 31, 10, 20)),
        ("+i77.31,m1000000000,/,\tattic", "attic", True, None, datetime.datetime(2001, 9, 9, 1, 46, 40)),
        ("11-03-01  12:40AM       <DIR>          photos", "photos", True, None, datetime.datetime(2001, 11, 3, 0, 40)),
        ("02-28-1999  03:05PM                 1204 a b.txt", "a b.txt", False, 1204, datetime.datetime(1999, 2, 28, 15, 5)),
        ("PAPERS.DIR;1          4  7-MAR-1998 08:30 [ME] (RWE,RE,,)", "PAPERS", True, None, datetime.datetime(1998, 3, 7, 8, 30)),
        ("SUM.TXT;12  213/216  19-JAN-1997 13:05:12  [ME,US]   (RWED,,,)", "SUM.TXT", False, None, datetime.datetime(1997, 1, 19, 13, 5)),
        ("total 12", None, None, None, None),
        ("", None, None, None, None),
    ],
)
def test_ftp_listing(spark, line, name, is_dir, size, mtime):
    r = one(spark, extract.list_entry(F.col("v")), line)
    assert (r.name, r.is_dir, r.size, r.mtime) == (name, is_dir, size, mtime)


def test_xml(spark):
    import xml.etree.ElementTree as ET

    for html in ("", "x", "<p>a<b>c</p>d</i>", "<!DOCTYPE x><!-- c --><HTML><Body a=1 a=2 b c='\"<&'>&auml;<br><script>a<b&&c</script>", "<a><<b>", "<html>x</html>tail<p>", "<p/>\x00", "<div xmlns:x='y' x=\"<>\">"):
        ET.fromstring(xmlconv.convert(html)[0])
    assert xmlconv.convert("<P>a<BR>b &auml;<i>c</p>") == ("<html><p>a<br/>b &amp;auml;<i>c</i></p></html>", 2, 0)
    assert xmlconv.convert(None)[0] is None
    assert one(spark, F.xpath(xmlconv.to_xml(F.col("v"))["xml"], F.lit("//a[@class='l']/@href")), "<a class=l href=x><a href=y>") == ["x"]


def test_xml_of_provided_pages(spark):
    """Every provided page becomes XML with the text and links that another parser finds."""
    import xml.etree.ElementTree as ET
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=False)
            self.hrefs, self.opened = [], 0

        def handle_starttag(self, tag, attrs):
            self.hrefs += [v for k, v in attrs if k == "href" and tag == "a"]

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html", xmlconv.to_xml(F.col("html")).alias("x")).collect()
    for r in rows:
        reader = Reader()
        reader.feed(r.html)
        tree = ET.fromstring(r.x.xml)
        found = [a.get("href") for a in tree.iter("a")]
        import html as escapes

        assert [escapes.unescape(h) for h in found] == reader.hrefs
        assert r.x.unclosed >= 0 and r.x.stray >= 0
    assert len(rows) > 40


def test_frontier_and_redirects(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", None), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("a",), (None,)], "page string")
    assert {tuple(r) for r in frontier.expand(seeds, links, 0).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert frontier.expand(seeds, links, 1).count() == 1
    assert frontier.expand(seeds, links, 2).count() == 3
    hops = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "src string, dst string")
    got = frontier.follow_redirects(spark.createDataFrame([("a",), ("q",), ("x",)], "url string"), hops)
    assert {tuple(r) for r in got.collect()} == {("a", "c"), ("q", "q"), ("x", None)}


def test_store(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "id int, v string, date int")
    new = spark.createDataFrame([(2, "c", 6, 1), (3, "d", 1, 2), (None, "e", 1, 2)], "id int, v string, date int, extra int")
    assert {tuple(r) for r in store.upsert(old, new, "id").collect()} == {(1, "a", 5, None), (2, "c", 6, 1), (3, "d", 1, 2)}
    assert store.insert_ignore(old, old.union(old), ["id"]).count() == 2
    ids = store.with_ids(spark.range(100).select((F.col("id") * 7 % 100).alias("k")), "k", 10).collect()
    assert all(r.id == r.k + 11 for r in ids) and len(ids) == 100
    names = store.filenames(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "i int, name string"), "name", "i")
    assert {r.saved_as for r in names.collect()} == {"a", "a-1", "b"}
    many = store.filenames(spark.range(60).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, "x").alias("name")), "name", "i")
    assert {r.i: r.saved_as for r in many.collect()} == {i: None if i % 3 else "x" if i == 0 else f"x-{i // 3}" for i in range(60)}
    assert one(spark, store.sanitized(F.col("v")), "a-b c_1") == "a_b_c_1"
    assert [one(spark, store.leading_int(F.col("v")), x) for x in (" 12x", "x", "-3")] == [12, 0, -3]
    assert store.schema_for(FileType("t", attributes=("title TEXT",))).names == ["id", "url_hash", "date", "title"]


CONFIG = """
# comment
filetype["html"] { extensions = {"html", "htm"}; parser = "html"; }
filetype["php" copy "html"] { extensions = {"php"}; } /* more */
crawler["a"] { filetypes = {"html"}; depth_limit = 3; external = true; dir_url = "@html"; }
extend: crawler["a"] { external = false; }
crawler["b" copy "a"];
override: filetype["php"] { mimetypes = {"text/php"}; }
slave { listen = "x"; }
"""


def test_config(tmp_path):
    c = config.loads(CONFIG)
    assert c.filetypes["html"].extensions == ("html", "htm") and c.filetypes["php"] == FileType("php", mimetypes=("text/php",))
    assert c.crawlers["a"].depth_limit == 3 and c.crawlers["a"].external is False
    assert c.crawlers["b"].depth_limit == 3 and c.crawlers["b"].name == "b" and c.scopes["slave"] == {"listen": "x"}
    (tmp_path / "base.conf").write_text('filetype["t"] {}')
    (tmp_path / "main.conf").write_text('include "base.conf"; include "base.conf"; crawler["c"] {filetypes = "t";}')
    assert config.load(str(tmp_path / "main.conf")).crawlers["c"].filetypes == ("t",)


@pytest.mark.parametrize("text", ['filetype["a"] {', 'thing["a"] {}', 'extend: crawler["x"] {}', 'crawler["a"] { nope = 1; }', 'crawler["a"] { depth_limit = "x"; }', 'crawler["a" copy "b"] {}', "@", 'include "none.conf"'])
def test_config_errors(text):
    with pytest.raises(config.ConfigError, match="line|found"):
        config.loads(text)


def test_engine(spark):
    site = pages.provided(spark, [("http://x.com/", '<a href="a.html"><a href="pic.png"><a href="http://y.com/b.html">'), ("http://x.com/a.html", '<a href="/two.png"><a href="/">'), ("http://y.com/b.html", '<img src="z.png">')])
    seeds = spark.createDataFrame([("x.com",)], "url string")
    engine = Engine(spark)
    crawled, targets = engine.crawl(seeds, site, "image")
    assert {tuple(r) for r in crawled.collect()} == {("http://x.com/", 0)}
    assert {r.url for r in targets.collect()} == {"http://x.com/pic.png"}
    engine.config.crawlers["image"] = filetypes.replace(engine.config.crawlers["image"], depth_limit=0)
    crawled, targets = engine.crawl(seeds, site, "image")
    assert crawled.count() == 2 and {r.url for r in targets.collect()} == {"http://x.com/pic.png", "http://x.com/two.png"}
    row = run_chain(site, "html, entityconv xmlconv title").where("url = 'http://x.com/'").first()
    assert len(row.links) == 3 and row.html.startswith("<html>")
    with pytest.raises(ValueError):
        run_chain(site, "nothing")
    assert "image" in engine.explain("image")


@pytest.mark.parametrize("name", sorted(filetypes.default_config().crawlers))
def test_every_profile_runs(spark, name):
    """No chain of a profile raises, on a page and on null."""
    c = filetypes.default_config()
    page = "<title>T</title><meta content=b name=a><a href=x class=l><div class=video-long-title><a href=v title=t></div><ul class=mw-search-results><li><a href=w title=s></a></li></ul>"
    df = spark.createDataFrame([("http://x.com/", page), ("http://y.com/", None)], "url string, html string")
    for t in c.types_of(c.crawlers[name]):
        done = run_chain(df, t.parser)
        assert done.count() == 2
        first = done.where("html is not null").select(attributes_of(done, t).alias("a")).first().a
        assert bool(t.attributes) == (first is not None)
    found = Engine(spark).run(spark.createDataFrame([("x.com",)], "url string"), df, name)
    assert found.crawled.count() == (name not in ("ftp", "google", "wikipedia", "youtube"))


def site(spark, rows, kind="url string, html string, status int, location string, content_type string"):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], kind)


def crawled(spark, rows, seeds, config, name="c", **more):
    found = Engine(spark, config).run(spark.createDataFrame([(s,) for s in seeds], "url string"), site(spark, rows), name, **more)
    return {(r.url, r.depth) for r in found.crawled.collect()}, {(r.url, r.filetype) for r in found.targets.collect()}


BASE = """
filetype["html"] { extensions = {"html"}; mimetypes = {"text/html"}; parser = "html"; }
filetype["pic"] { extensions = {"png"}; mimetypes = {"image/"}; }
crawler["c"] { filetypes = {"html", "pic"}; dir_url = "@html"; extless_url = "lookup"; unknown_url = "discard"; dynamic_url = "discard"; depth_limit = 3; }
"""


def test_crawl_looks_types_up(spark):
    rows = [("http://x.com/", '<a href=a><a href=b><a href=c><a href="d.png?x">'), ("http://x.com/a", "<a href=e.html>", None, None, "text/html; charset=x"), ("http://x.com/b", "", None, None, "image/gif")]
    mime = spark.createDataFrame([("http://x.com/c", "IMAGE/webp")], "url string, content_type string")
    got = crawled(spark, rows, ["x.com"], config.loads(BASE), mime=mime)
    assert got == ({("http://x.com/", 0), ("http://x.com/a", 1)}, {("http://x.com/b", "pic"), ("http://x.com/c", "pic"), ("http://x.com/d.png?x", "pic")})


def test_crawl_follows_redirects(spark):
    rows = [
        ("http://x.com/", "<a href=m.html><a href=o.html><a href=l0.html>"),
        ("http://x.com/m.html", "<a href=no.png>", 302, "http://www.x.com/n.html"),
        ("http://www.x.com/n.html", "<a href=yes.png>"),
        ("http://x.com/o.html", None, 301, "http://y.com/p.html"),
        ("http://y.com/p.html", "<a href=far.png>"),
        *[(f"http://x.com/l{i}.html", None, 301, f"http://x.com/l{i + 1}.html") for i in range(30)],
    ]
    pages, targets = crawled(spark, rows, ["x.com"], config.loads(BASE))
    # the link's own level counts; another host is out of bounds, and chains break off
    assert ("http://www.x.com/n.html", 1) in pages and targets == {("http://www.x.com/yes.png", "pic")}
    assert {u for u, _ in pages if "/l" in u} == {f"http://x.com/l{i}.html" for i in range(20)}
    outside = config.loads(BASE + 'extend: crawler["c"] { external = true; }')
    pages, targets = crawled(spark, rows, ["x.com"], outside)
    assert ("http://y.com/p.html", 0) in pages and ("http://y.com/far.png", "pic") in targets


def test_crawl_peeks(spark):
    rows = [("http://x.com/", "<a href=http://y.com/a.html>"), ("http://y.com/a.html", "<a href=b.html><a href=http://z.com/q.html><a href=1.png>"), ("http://y.com/b.html", "<a href=c.html><a href=2.png>"), ("http://y.com/c.html", ""), ("http://z.com/q.html", "")]
    limit = BASE + 'extend: crawler["c"] { external_peek = 2; depth_limit = 1; }'
    pages, targets = crawled(spark, rows, ["x.com"], config.loads(limit))
    assert pages == {("http://x.com/", 0), ("http://y.com/a.html", 0), ("http://y.com/b.html", 1)}
    assert targets == {("http://y.com/1.png", "pic"), ("http://y.com/2.png", "pic")}
    pages, _ = crawled(spark, rows, ["x.com"], config.loads(limit + 'extend: crawler["c"] { external = true; }'))
    assert ("http://z.com/q.html", 0) in pages


def test_crawl_by_jail_and_robots(spark):
    rows = [("http://x.com/d/i.html", "<a href=a.html><a href=/e/b.html><a href=/d2/c.html>"), ("http://x.com/d/a.html", ""), ("http://x.com/e/b.html", ""), ("http://x.com/d2/c.html", ""), ("http://x.com/robots.txt", "User-agent: WEBLOOM\nDisallow: /d/a\n")]
    both = lambda extra: {u.rpartition("/")[2] for u, _ in crawled(spark, rows, ["http://x.com/d/i.html"], config.loads(BASE + f'extend: crawler["c"] {{ {extra} }}'))[0]}
    assert both("jail = false;") == {"i.html", "a.html", "b.html", "c.html"}
    assert both("jail = true;") == {"i.html", "a.html"}
    assert both("robotstxt = true;") == {"i.html", "b.html", "c.html"}
    assert both("jail = true; robotstxt = true;") == {"i.html"}


def test_crawl_switches_and_first_types(spark):
    text = BASE + """
filetype["gate"] { expr = "PATH</gate*>"; parser = "html"; crawler_switch = "inner"; }
filetype["css"] { extensions = {"css"}; parser = "css"; }
crawler["inner"] { filetypes = {"css", "pic"}; depth_limit = 3; unknown_url = "discard"; extless_url = "discard"; }
extend: crawler["c"] { filetypes = {"gate", "html", "pic"}; }
"""
    rows = [("http://x.com/", "<a href=/gate><a href=s.css>"), ("http://x.com/gate", "<a href=s.css><a href=h.html>"), ("http://x.com/s.css", "url(a.png)"), ("http://x.com/h.html", "")]
    pages, targets = crawled(spark, rows, ["x.com"], config.loads(text))
    assert pages == {("http://x.com/", 0), ("http://x.com/gate", 1), ("http://x.com/s.css", 2)} and targets == {("http://x.com/a.png", "pic")}
    # the first type is set whatever the URL is
    first = config.loads(BASE + 'filetype["list"] { parser = "text"; } extend: crawler["c"] { initial_filetype = "list"; }')
    pages, targets = crawled(spark, [("http://x.com/seeds.xyz", "see http://x.com/1.png now")], ["x.com/seeds.xyz"], first)
    assert pages == {("http://x.com/seeds.xyz", 0)} and targets == {("http://x.com/1.png", "pic")}


def test_crawl_with_own_functions(spark, tmp_path, monkeypatch):
    """Parsers, handlers and init functions of a module; attributes make a page a target."""
    (tmp_path / "ownparts.py").write_text(
        "from pyspark.sql import functions as F\n"
        "from webloom import engine\n"
        "engine.parser('own/size')(lambda df: df.withColumn('size', F.length('html')).withColumn('other', F.lit('x')))\n"
        "engine.handler('own/upper')(lambda df: df.withColumn('html', F.upper('html')))\n"
        "engine.init('own/start')(lambda x: F.concat(F.lit('http://x.com/'), x))\n"
        "engine.column_parser('own/rev', 'reversed', lambda s: s.str[::-1])\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    text = 'load_module "ownparts";' + BASE + """
extend: filetype["html"] { parser = "own.js/size, own.js/rev, html"; handler = "own/upper"; attributes = {"size INT", "reversed TEXT", "missing TEXT"}; }
extend: crawler["c"] { init = "own.js/start"; }
"""
    c = config.loads(text)
    found = Engine(spark, c).run(spark.createDataFrame([("p.html",)], "url string"), site(spark, [("http://x.com/p.html", "<a href=q.png>")]), "c")
    got = {r.url: r.attributes for r in found.targets.collect()}
    assert got == {"http://x.com/p.html": {"size": "14", "reversed": ">GNP.Q=FERH A<"}, "http://x.com/Q.PNG": None}
    rows = store.with_attributes(found.targets.withColumn("date", F.lit("2024-01-01").cast("timestamp")).where("attributes is not null"), c.filetypes["html"]).first()
    assert (rows.size, rows.reversed, rows.missing) == (14, ">GNP.Q=FERH A<", None)
    with pytest.raises(config.ConfigError):
        config.loads('load_module "no_such_module_here";')
    with pytest.raises(ValueError, match="handler"):
        c.filetypes["html"] = filetypes.replace(c.filetypes["html"], handler="nobody")
        Engine(spark, c).run(spark.createDataFrame([("p.html",)], "url string"), site(spark, []), "c")


def test_hooks(spark):
    told = []
    note = lambda name: lambda *what: told.append((name, *what))
    hooks = {n: note(n) for n in ("ready", "level", "idle", "cleanup")} | {"session_complete": lambda c: told.append(("complete", c.crawled.count()))}
    engine = Engine(spark, config.loads(BASE), hooks)
    seeds = spark.createDataFrame([("x.com",)], "url string")
    engine.run(seeds, site(spark, [("http://x.com/", "<a href=a.html>"), ("http://x.com/a.html", "")]), "c")
    assert told == [("ready",), ("level", 0, 0), ("level", 1, 1), ("idle",), ("complete", 2), ("cleanup",)]
    told.clear()
    with pytest.raises(ValueError):
        engine.run(seeds, site(spark, []), "nobody")
    assert told == [("cleanup",)]


def test_chain_parsers(spark):
    body = "<meta charset=iso-8859-1><p>gr\xfc\xdf".encode("latin-1")
    df = spark.createDataFrame([("http://x.com/", None, bytearray(body), None)], "url string, html string, body binary, content_type string")
    assert run_chain(df, "utf8conv").first().html.endswith("<p>grüß")
    assert run_chain(df.drop("body"), "utf8conv").first().html is None
    listing = "total 2\r\n-rw-r--r--   1 me us  31 Feb  9  2001 note one.txt\ndrwxr-xr-x   2 me us  512 Feb  9  2001 sub\nPAPERS.DIR;1   1  7-MAR-1998 08:30 [A] (R)\nSUM.TXT;3  213/216  19-JAN-1997 13:05:12  [A,B]   (R)"
    ftp = spark.createDataFrame([("ftp://x.com/", listing)], "url string, html string")
    assert run_chain(ftp, "ftp").first().links == ["note one.txt", "sub/", "PAPERS/", "SUM.TXT"]
    checked = run_chain(spark.createDataFrame([("<p>a<b>c</p></i>",)], "html string"), "xmlconv, validator").first()
    assert (checked.errors, checked.warnings) == (1, 2)
    got = crawled(spark, [("ftp://x.com/d/", listing), ("ftp://x.com/d/sub/", "")], ["ftp://x.com/d/"], config.loads('filetype["ftp"] { parser = "ftp"; } filetype["txt"] { extensions = {"txt"}; } crawler["c"] { ftp_dir_url = "@ftp"; depth_limit = 2; }'))
    assert got == ({("ftp://x.com/d/", 0), ("ftp://x.com/d/sub/", 1)}, {("ftp://x.com/d/note%20one.txt", "txt"), ("ftp://x.com/d/SUM.TXT", "txt")})


def test_commands(spark):
    users = store.inserted(store.empty(spark, "user"), user="a", level=8192, deleted=False, **{"pass": "x"})
    with pytest.raises(commands.Refused, match="200"):
        commands.user_add(users, 2, "b", "B", 1)
    with pytest.raises(commands.Refused, match="300"):
        commands.user_add(users, 1024, "a", "A", 1)
    users = commands.user_add(users, 1024, "b", "B", 1)
    assert [(r.id, r.user, r.level) for r in users.orderBy("id").collect()] == [(1, "a", 8192), (2, "b", 1)]
    assert commands.login(users, "a", "x").count() == 1 and commands.login(commands.user_delete(users, 1024, 1), "a", "x").count() == 0
    added = commands.add(store.empty(spark, "added"), 2, 2, "images x y", "2024-01-01 00:00:00")
    assert [(r.crawler, r.input, r.user_id) for r in added.collect()] == [("images", "x y", 2)]
    for bad in ("", "images"):
        with pytest.raises(commands.Refused, match="201"):
            commands.add(added, 2, 2, bad, "2024-01-01 00:00:00")
    with pytest.raises(commands.Refused):
        commands.list_users(users, 2)
    xml = commands.to_xml(spark.createDataFrame([(1, "a<&>")], "id int, name string"), "user", "list").first().xml
    assert xml == "<list><user><id>1</id><name>a&lt;&amp;&gt;</name></user></list>"
    assert len(spark.range(1).select(store.token(F.lit("10.0.0.1|7")).alias("t")).first().t) == 40
    kept = store.renewed(added, 1, "2024-02-01 00:00:00").first()
    assert kept.date == datetime.datetime(2024, 2, 29)


def test_sources(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("x.com\n\n# no\nhttp://y.com/a b\n")
    assert [r.url for r in pages.seeds(spark, str(tmp_path / "seeds.txt")).collect()] == ["http://x.com/", "http://y.com/a%20b"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"abc")
    assert [(bytes(r.body), r.length) for r in pages.files(spark, str(tmp_path / "in")).collect()] == [(b"abc", 3)]
    stored = pages.provided(spark, [("HTTP://X.com/A", "h")])
    assert [r.html for r in pages.fetched(spark.createDataFrame([("https://x.com/a",), ("http://x.com/b",)], "url string"), stored).collect()] == ["h"]
    pages.save(stored, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    long = "http://x.com/" + "a" * 70_000
    assert one(spark, F.length(urls.normalized(F.col("v"))), long) == len(long)
    assert one(spark, urls.dedup_key(F.col("v"), folded=True), "http://X.com/_~{a}") == 'x.com/"^[a]'


def test_queue_stream(spark, tmp_path):
    """Inputs that are due are taken once, and are due again four weeks later."""
    kind = "id int, user_id int, crawler string, input string, date timestamp"
    day = lambda n: datetime.datetime(2024, 1, n)
    clock, path, src = ["2024-01-05 00:00:00"], str(tmp_path / "q"), str(tmp_path / "src")
    spark.createDataFrame([(1, 1, "c", "a", day(1)), (2, 1, "c", "b", day(9))], kind).write.parquet(src)

    def run():
        q = spark.readStream.schema(kind).parquet(src).writeStream.foreachBatch(jobs.serve(path, lambda: clock[0])).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    assert [r.id for r in spark.read.parquet(path + "/taken/batch=0").collect()] == [1]
    clock[0] = "2024-01-10 00:00:00"
    spark.createDataFrame([(1, 1, "c", "again", day(2)), (3, 1, "c", "c", day(2))], kind).write.mode("append").parquet(src)
    run()
    assert {r.id for r in spark.read.parquet(path + "/taken/batch=1").collect()} == {2, 3}
    queue = {r.id: (r.input, r.date) for r in store.current(spark, path + "/queue").collect()}
    assert queue == {1: ("a", datetime.datetime(2024, 2, 2)), 2: ("b", datetime.datetime(2024, 2, 7)), 3: ("c", datetime.datetime(2024, 2, 7))}


def test_upload_stream(spark, tmp_path):
    path = str(tmp_path / "t")
    write = store.upload(path, "hash")
    assert store.current(spark, path) is None
    for k, rows in enumerate(([("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z")], [("a", 2, "z")])):
        write(spark.createDataFrame(rows, "hash string, date int, v string"), k)
    assert {tuple(r) for r in store.current(spark, path).collect()} == {("a", 2, "z"), ("b", 1, "y")}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("http://x.com/a", datetime.datetime(2024, 1, 1, 0, i)) for i in range(3)] + [("https://X.com/A", datetime.datetime(2024, 1, 1, 1))]
    spark.createDataFrame(rows, "url string, ts timestamp").write.parquet(src)
    stream = spark.readStream.schema("url string, ts timestamp").parquet(src)
    for date in (None, "ts"):
        q = jobs.new_urls(stream, "url", date).writeStream.format("memory").queryName(f"n{date}").option("checkpointLocation", str(tmp_path / f"c{date}")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(f"n{date}").count() == 1
    q = jobs.states(stream, "url", "ts", "url").writeStream.format("memory").queryName("st").outputMode("complete").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.events for r in spark.table("st").collect()} == {3, 1}


def test_entry_without_the_folder(tmp_path):
    """The entry point still works where the training-data operators have been removed."""
    import shutil

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{here}/webloom", tmp_path / "webloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'links_by_host' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def wild_site(spark, seed, n=24):
    """Pages of three hosts that link to any page in several forms; some have moved, one host has robots rules."""
    rng = random.Random(seed)
    at = lambda i, form: f"{('http', 'https')[form % 2]}://h{i % 3}.site/d{i % 2}/{'pP'[form // 2]}{i}.{('html', 'html', 'txt', 'css')[i % 4]}"
    any_page = lambda i: at(rng.choice((i + 1, i + 3, rng.randrange(n))) % n, rng.randrange(4))
    rows = []
    for i in range(n):
        links = [any_page(i) for _ in range(rng.randrange(2, 6))]
        moved = rng.random() < 0.1
        rows.append((at(i, 0), "see " + " ".join(f"<a href={x}>" for x in links) + f" {any_page(i)} url({any_page(i)}) <img src=i{i}.png>", 301 if moved else 200, any_page(i) if moved else None))
    rows.append(("http://h1.site/robots.txt", "User-agent: *\nDisallow: /d1/p1", 200, None))
    return spark.createDataFrame([(at(i, 3),) for i in range(5)], "url string"), spark.createDataFrame(rows, "url string, html string, status int, location string")


@pytest.mark.parametrize(("seed", "options", "wide"), [(4, {"external": True, "external_peek": 2, "depth_limit": 3, "robotstxt": True}, 12)])
def test_walk_is_as_levels(spark, monkeypatch, seed, options, wide):
    """What is walked in one task has the rows, depths and levels that joins have, wherever it begins and stops."""
    seeds, site = wild_site(spark, seed)
    conf = filetypes.default_config()
    conf.filetypes["txt"] = replace(conf.filetypes["txt"], crawler_switch="css")
    conf.crawlers["image"] = replace(conf.crawlers["image"], unknown_url="@css", **options)
    conf.crawlers["css"] = replace(conf.crawlers["css"], external=True, depth_limit=2)
    found = []
    for levels, most in ((10**6, 10**6), (1, wide)):
        monkeypatch.setattr(engine, "LEVELS", levels)
        monkeypatch.setattr(engine, "WIDE", most)
        told = []
        c = Engine(spark, conf, {"level": lambda *x: told.append(x)}).run(seeds, site, "image")  # noqa: B023
        found.append((sorted(map(tuple, c.crawled.collect())), sorted(map(repr, c.targets.collect())), told))
    assert found[0] == found[1]
    assert len(found[0][0]) > 5 and len(found[0][2]) > 2 and found[0][2][-1][0] == len(found[0][2]) - 1


def test_thin_levels_are_few_jobs(spark, monkeypatch):
    """A chain of pages over two hosts has a level for each, but doesn't need jobs for each."""
    rows = [(f"http://h{i % 2}.site/p{i}.html", f"<a href=http://h{(i + 1) % 2}.site/p{i + 1}.html>") for i in range(3000)]
    tables = []
    monkeypatch.setattr(engine, "cut", lambda df, name="t", **kw: tables.append(name) or (cut(df, name, **kw) if len(tables) < 100 else pytest.fail("a table for each level")))
    conf = filetypes.default_config()
    conf.crawlers["default"] = replace(conf.crawlers["default"], external=True)
    found = Engine(spark, conf).run(spark.createDataFrame(rows[:1], "url string, html string").select("url"), spark.createDataFrame(rows, "url string, html string"))
    assert found.crawled.count() == 3000 and {r.depth for r in found.crawled.select("depth").distinct().collect()} == {0}
