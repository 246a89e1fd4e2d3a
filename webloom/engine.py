"""The engine: a configuration, stored pages and a crawl over them.

A crawl first reduces the stored pages to a narrow table of links, one pass for each parser
chain that the configuration can reach, and classifies each link once for every crawler
that can meet it. The levels then join only these narrow rows, so no text is shuffled or
read again however deep the crawl goes. After some levels, those that are thin are walked in one
task over numbered links; where a level is wide, joins take over again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import extract, urls, xmlconv
from webloom.operators import filetypes, rules, store, walk
from webloom.operators.filetypes import PENDING, Config, Crawler, FileType
from webloom.session import cut

AGENT = "webloom"
#: Redirects that are followed in a row.
HOPS = 20
#: Levels by joins before the rest is walked in one task, if at most ``WIDE`` pages wait.
LEVELS = 8
WIDE = 1_000_000

Step = Callable[[DataFrame], DataFrame]
#: Parsers by name: (df with html and links) -> df; a chain runs them in order.
PARSERS: dict[str, Step] = {}
#: Handlers by name: they change a page before its chain runs.
HANDLERS: dict[str, Step] = {}
#: Init functions by name: an input to its URLs.
INITS: dict[str, Callable[[Column], Column]] = {}


def _register(table: dict, name: str):
    def add(f):
        table[name] = f
        return f

    return add


def parser(name: str):
    """Register a parser."""
    return _register(PARSERS, name)


def handler(name: str):
    """Register a handler."""
    return _register(HANDLERS, name)


def init(name: str):
    """Register an init function."""
    return _register(INITS, name)


def column_parser(name: str, attribute: str, f: Callable) -> None:
    """Register a Python function, run by ``pandas_udf``, as a parser that fills an attribute.

    ``f`` takes and returns a pandas Series of strings; the text goes to it in Arrow batches.
    """
    udf = F.pandas_udf(f, "string")
    PARSERS[name] = lambda df: df.withColumn(attribute, udf(F.col("html")))


def named(table: dict, name: str, what: str):
    """What a configuration names: ``parser``, or ``file.js/parser`` for one of a script."""
    plain = name.replace(".js/", "/")
    for known in (name, plain, plain.rpartition("/")[2]):
        if known in table:
            return table[known]
    raise ValueError(f"there is no {what} {name}")


def add_links(found) -> Step:
    """A parser that adds the links that ``found`` has of the text."""
    return lambda df: df.withColumn("links", F.concat("links", F.coalesce(found(F.col("html")), F.array().cast("array<string>"))))


def _xml(df: DataFrame) -> DataFrame:
    parts = df.withColumn("x", xmlconv.to_xml(F.col("html"))) if "x" not in df.columns else df
    return parts.withColumns({"html": F.col("x.xml"), "unclosed": F.col("x.unclosed"), "stray": F.col("x.stray")}).drop("x")


def _utf8(df: DataFrame) -> DataFrame:
    """The bytes of a page, where it has a ``body``, as text; else as it is."""
    if "body" not in df.columns:
        return df
    kind = F.col("content_type") if "content_type" in df.columns else F.lit(None).cast("string")
    head = F.decode(F.substring("body", 1, 4096), "iso-8859-1")
    return df.withColumn("html", F.coalesce(extract.to_utf8(F.col("body"), extract.charset(kind, head)), "html"))


def _validated(df: DataFrame) -> DataFrame:
    """Elements left open and stray end tags, as the conversion to XML found them."""
    df = df if "unclosed" in df.columns else _xml(df)
    return df.withColumns({"errors": F.col("stray"), "warnings": F.col("unclosed")})


def _anchors(df: DataFrame) -> DataFrame:
    return add_links(lambda h: F.xpath(h, F.lit("//a/@href")))(df)


PARSERS |= {
    "html": add_links(lambda h: F.concat(extract.prefixed_links(h, extract.html_links(h)), extract.style_links(h))),
    "css": add_links(extract.css_links),
    "text": add_links(extract.text_links),
    "ftp": add_links(extract.list_links),
    "utf8conv": _utf8,
    "entityconv": lambda df: df.withColumn("html", extract.decode_entities(F.col("html"))),
    "xmlconv": _xml,
    "title": lambda df: df.withColumn("title", extract.title(F.col("html"))),
    "meta": lambda df: df.withColumn("meta", extract.meta(F.col("html"))),
    "source": lambda df: df.withColumn("source", F.col("html")),
    "xmlsource": lambda df: _anchors(df.withColumn("source", F.col("html"))),
    "validator": _validated,
    # result pages of search engines, after xmlconv
    "google/parser": add_links(lambda h: F.xpath(h, F.lit("//a[@class='l']/@href"))),
    "wikipedia/parser": lambda df: df.withColumn("results", F.arrays_zip(*[F.xpath(F.col("html"), F.lit(f"//ul[@class='mw-search-results']/li/a/@{a}")).alias(a) for a in ("title", "href")])),
    "youtube/youtube": lambda df: df.withColumn("results", F.arrays_zip(*[F.xpath(F.col("html"), F.lit(f"//div[@class='video-long-title']/a[1]/@{a}")).alias(a) for a in ("title", "href")])),
}
HANDLERS["writefile"] = lambda df: df.withColumn("file", urls.download_name(F.col("url"))).withColumn("html", F.col("file"))
INITS |= {
    "default": urls.guess_scheme,
    "google/google_search_init": lambda q: urls.search_url("http://www.google.com/search?q={}&start=0", q),
    "wikipedia/wikipedia_search_init": lambda q: urls.search_url("http://en.wikipedia.org/w/index.php?search={}&fulltext=Advanced+search", q),
    "youtube/init": lambda q: urls.search_url("http://www.youtube.com/results?search_query={}&search_type=&aq=f", q),
}


def run_chain(df: DataFrame, chain: str) -> DataFrame:
    """Run parsers, named with blanks or commas between, on ``html``; links gather in ``links``."""
    if "links" not in df.columns:
        df = df.withColumn("links", F.array().cast("array<string>"))
    for name in chain.replace(",", " ").split():
        df = df.transform(named(PARSERS, name, "parser"))
    return df


def attributes_of(df: DataFrame, filetype: FileType) -> Column:
    """map of the attributes that a file type declares and the chain has set; null if none is set."""
    pairs = []
    for a in filetype.attributes:
        name = a.split()[0]
        if name in df.columns:
            plain = df.schema[name].dataType.typeName() in ("array", "struct", "map")
            pairs += [F.lit(name), F.to_json(name) if plain else F.col(name).cast("string")]
    if not pairs:
        return F.lit(None).cast("map<string,string>")
    found = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    return F.when(F.size(found) > 0, found)


#: Columns of what a level fetches.
ROWS = ["key", "url", "crawler", "filetype", "now", "work", "depth"]


def _union(levels: list[DataFrame]) -> DataFrame:
    rows = levels[0]
    for x in levels[1:]:
        rows = rows.unionByName(x)
    return rows


@dataclass
class Crawl:
    """What a crawl found: tables that are written already."""

    #: (url, depth, crawler, filetype) of the pages fetched
    crawled: DataFrame
    #: (url, filetype, attributes) of the URLs that match a type without a parser, and of pages with attributes
    targets: DataFrame


class Engine:
    """Crawls stored pages by the rules of a configuration."""

    def __init__(self, spark: SparkSession, config: Config | None = None, hooks: dict[str, Callable] | None = None):
        """``hooks`` by event: ``ready`` and ``idle`` before and after the levels and ``level``
        (number, depth) at each, ``session_complete`` with the crawl and ``cleanup`` at the end,
        whether it failed or not. They run on the driver."""
        self.spark, self.config = spark, config if config is not None else filetypes.default_config()
        self.hooks = hooks or {}

    def _tell(self, event: str, *what) -> None:
        if event in self.hooks:
            self.hooks[event](*what)

    def links(self, pages: DataFrame, crawler: str = "default") -> DataFrame:
        """(src, dst, filetype, external, route) of the links of all pages, by their URLs alone."""
        c = self.config.crawlers[crawler]
        types = self.config.types_of(c)
        found = pages.select(urls.normalized(F.col("url")).alias("src"), F.explode(extract.html_links(F.col("html"))).alias("link"))
        found = found.select("src", urls.resolved(F.col("src"), F.col("link")).alias("dst")).where("dst is not null")
        found = found.select("src", "dst", filetypes.classify(F.col("dst"), c, types).alias("filetype"), urls.is_external(F.col("src"), F.col("dst")).alias("external"))
        return found.withColumn("route", filetypes.route(F.col("filetype"), F.col("external"), c, types))

    def reachable(self, crawler: str) -> list[Crawler]:
        """The crawler and those that its file types can switch to."""
        found, todo = {}, [crawler]
        while todo:
            name = todo.pop()
            if name in found:
                continue
            if name not in self.config.crawlers:
                raise ValueError(f"there is no crawler {name}")
            found[name] = self.config.crawlers[name]
            todo += [t.crawler_switch for t in self.config.types_of(found[name]) if t.crawler_switch]
        return list(found.values())

    def crawl(self, seeds: DataFrame, pages: DataFrame, crawler: str = "default", mime: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(url, depth) of the crawled pages, and (url, filetype) of the targets, each once."""
        found = self.run(seeds, pages, crawler, mime)
        return found.crawled.select("url", "depth"), found.targets.select("url", "filetype")

    def run(self, seeds: DataFrame, pages: DataFrame, crawler: str = "default", mime: DataFrame | None = None) -> Crawl:
        """Crawl ``pages`` (url, html; content_type, status, location and body if known) from ``seeds`` (url).

        ``mime`` (url, content_type) settles URLs whose form doesn't tell their type; pages
        with a content type add to it. Robots rules are those of the stored ``/robots.txt``
        pages. Defined cases: a page stored twice counts once, the one with the smallest
        text; null URLs are left out; a page is fetched once, at the least depth of the
        round that found it first.
        """
        try:
            found = self._run(seeds, pages, crawler, mime)
            self._tell("session_complete", found)
            return found
        finally:
            self._tell("cleanup")

    def _run(self, seeds: DataFrame, pages: DataFrame, crawler: str, mime: DataFrame | None) -> Crawl:
        crawlers = self.reachable(crawler)
        stored = self._stored(pages)
        known = stored.where("content_type is not null").select("key", "content_type")
        if mime is not None:
            known = known.unionByName(mime.select(urls.dedup_key(urls.normalized(F.col("url"))).alias("key"), "content_type"))
        known = cut(known.groupBy("key").agg(F.min("content_type").alias("content_type")), "mime")
        facts, attributes = self._facts(stored, crawlers, known)
        typed = self._typed(facts, crawlers, known)
        self._tell("ready")
        rows = self._levels(seeds, stored, typed, crawlers, known)
        self._tell("idle")
        first = self.config.crawlers[crawler]
        return self._results(rows, stored, typed, attributes, first)

    def _stored(self, pages: DataFrame) -> DataFrame:
        """The pages by key, with null columns where they lack one; one of each key."""
        kinds = {"status": "int", "location": "string", "content_type": "string", "body": "binary"}
        have = [F.col(c).cast(k).alias(c) if c in pages.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()]
        rows = pages.select(urls.normalized(F.col("url")).alias("url"), "html", *have).withColumn("key", urls.dedup_key(F.col("url"))).where("key is not null")
        twice = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        if twice.isEmpty():
            return rows
        best = rows.groupBy("key").agg(F.min(F.struct("html", "url", *kinds)).alias("r"))
        return cut(best.select("key", "r.*"), "stored")

    def _class(self, df: DataFrame, url: str, crawler: Crawler, known: DataFrame) -> DataFrame:
        """``df`` with ``filetype`` as one crawler sees it, looked up where its form doesn't tell."""
        types = self.config.types_of(crawler)
        df = df.withColumn("filetype", filetypes.classify(F.col(url), crawler, types))
        named_by = known.select(F.col("key").alias("known_key"), filetypes.by_mime(F.col("content_type"), types).alias("known_type"))
        key = F.when(F.col("filetype") == PENDING, urls.dedup_key(F.col(url)))
        df = df.withColumn("wanted", key).join(named_by, F.col("wanted") == F.col("known_key"), "left")
        return df.withColumn("filetype", F.when(F.col("filetype") == PENDING, F.col("known_type")).otherwise(F.col("filetype"))).drop("wanted", "known_key", "known_type")

    def _chain(self, crawler: Crawler, t: FileType) -> tuple[str, str]:
        return t.handler or crawler.default_handler, t.parser

    def _facts(self, stored: DataFrame, crawlers: list[Crawler], known: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(src_key, src, work, link, hop) of all pages, and (key, filetype, attributes); ``work`` names handler and chain."""
        moved = (F.col("status") >= 300) & (F.col("status") < 400) & F.col("location").isNotNull()
        out: DataFrame | None = None
        attributes: DataFrame | None = None
        work: dict[tuple[str, str], list[FileType]] = {}
        for c in crawlers:
            first = [self.config.filetypes[c.initial_filetype]] if c.initial_filetype else []
            for t in self.config.types_of(c) + first:
                now = self.config.crawlers[t.crawler_switch] if t.crawler_switch else c
                if t.parser or t.handler:
                    work.setdefault(self._chain(now, t), [])
                    if t not in work[self._chain(now, t)]:
                        work[self._chain(now, t)].append(t)
        wanted = stored.where(~F.coalesce(moved, F.lit(False)))
        for (handle, chain), types in work.items():
            # pages that no crawler takes for one of these types needn't be parsed
            mine = wanted
            if not any(c.initial_filetype in {t.name for t in types} for c in crawlers):
                seen = None
                for c in crawlers:
                    names = [t.name for t in types if t in self.config.types_of(c)]
                    if names:
                        one = self._class(wanted.select("key", "url"), "url", c, known).where(F.col("filetype").isin(names)).select("key")
                        seen = one if seen is None else seen.union(one)
                mine = wanted.join(seen.distinct(), "key", "left_semi")
            if handle:
                mine = mine.transform(named(HANDLERS, handle, "handler"))
            done = run_chain(mine, chain)
            name = f"{handle}|{chain}"
            links = done.select(F.col("key").alias("src_key"), F.col("url").alias("src"), F.lit(name).alias("work"), F.explode("links").alias("link"), F.lit(False).alias("hop"))
            out = links if out is None else out.unionByName(links)
            for t in types:
                if t.attributes:
                    a = done.select("key", F.lit(t.name).alias("filetype"), attributes_of(done, t).alias("attributes")).where("attributes is not null")
                    attributes = a if attributes is None else attributes.unionByName(a)
        hops = stored.where(moved).select(F.col("key").alias("src_key"), F.col("url").alias("src"), F.lit(None).cast("string").alias("work"), F.col("location").alias("link"), F.lit(True).alias("hop"))
        out = hops if out is None else out.unionByName(hops)
        if attributes is None:
            attributes = self.spark.createDataFrame([], "key string, filetype string, attributes map<string,string>")
        return cut(out, "facts"), cut(attributes, "attributes")

    def _typed(self, facts: DataFrame, crawlers: list[Crawler], known: DataFrame) -> DataFrame:
        """(src_key, work, crawler, hop, url, key, filetype, external, route), each once."""
        dst = F.when(F.col("hop"), urls.normalized(F.col("link"))).otherwise(urls.resolved(F.col("src"), F.col("link")))
        found = facts.select("src_key", "src", "work", "hop", dst.alias("url")).where("url is not null").distinct()
        same_host = urls.host_key(urls.host(F.col("src"))) == urls.host_key(urls.host(F.col("url")))
        found = cut(found.withColumn("external", F.when(F.col("hop"), ~same_host).otherwise(urls.is_external(F.col("src"), F.col("url")))), "resolved")
        out: DataFrame | None = None
        for c in crawlers:
            one = self._class(found, "url", c, known).where("filetype is not null").withColumn("crawler", F.lit(c.name))
            # redirects to another host wait in the queue of hosts, even where there is peeking
            route = filetypes.route(F.col("filetype"), F.col("external"), c, self.config.types_of(c))
            far = F.lit("pending" if c.external else "drop")
            one = one.withColumn("route", F.when(F.col("hop") & F.col("external") & (route != "target"), far).otherwise(route)).where("route != 'drop'")
            if c.robotstxt:
                one = one.withColumn("host", urls.host_key(urls.host(F.col("url"))))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return cut(out.select("src_key", "work", "crawler", "hop", "url", urls.dedup_key(F.col("url")).alias("key"), "filetype", "external", "route"), "typed")

    def _allowed(self, rows: DataFrame, stored: DataFrame, crawlers: list[Crawler]) -> DataFrame:
        """Rows (url, crawler, jail) that jails and robots rules leave."""
        jailed, polite = ([c.name for c in crawlers if getattr(c, f)] for f in ("jail", "robotstxt"))
        if jailed:
            rows = rows.where(~F.col("crawler").isin(jailed) | F.lower(urls.path(F.col("url"))).startswith(F.lower(F.col("jail"))))
        return self._free(rows, stored, polite).where("free").drop("free")

    def _free(self, rows: DataFrame, stored: DataFrame, polite: list[str]) -> DataFrame:
        """Rows (url, crawler) with ``free``: whether the robots rules allow them."""
        if not polite:
            return rows.withColumn("free", F.lit(True))
        robots = stored.where(F.lower(urls.path(F.col("url"))) == "/robots.txt")
        robots = robots.groupBy(urls.host_key(urls.host(F.col("url"))).alias("robots_host")).agg(F.min("html").alias("robots"))
        rows = rows.withColumn("host", urls.host_key(urls.host(F.col("url")))).join(robots, F.col("host") == F.col("robots_host"), "left")
        free = rules.allowed(urls.path(F.col("url")), rules.robots_rules(F.col("robots"), AGENT))
        return rows.withColumn("free", F.coalesce(~F.col("crawler").isin(polite) | free, F.lit(False))).drop("host", "robots_host", "robots")

    def _start(self, seeds: DataFrame, crawler: Crawler, known: DataFrame) -> DataFrame:
        start = seeds.select(urls.normalized(named(INITS, crawler.init or "default", "init function")(F.col("url"))).alias("url")).where("url is not null").distinct()
        if crawler.initial_filetype:
            start = start.withColumn("filetype", F.lit(crawler.initial_filetype))
        else:
            start = self._class(start, "url", crawler, known).where("filetype is not null")
        return start.withColumn("crawler", F.lit(crawler.name))

    def _levels(self, seeds: DataFrame, stored: DataFrame, typed: DataFrame, crawlers: list[Crawler], known: DataFrame) -> DataFrame:
        """(key, url, crawler, filetype, work, depth) of everything that is due to be fetched, with the targets among the seeds."""
        first = crawlers[0]
        parsed = {(c.name, t.name): (t.crawler_switch or c.name, "|".join(self._chain(self.config.crawlers[t.crawler_switch] if t.crawler_switch else c, t))) for c in crawlers for t in self.config.types_of(c) if t.parser or t.handler}
        for c in crawlers:
            if c.initial_filetype:
                t = self.config.filetypes[c.initial_filetype]
                parsed.setdefault((c.name, t.name), (t.crawler_switch or c.name, "|".join(self._chain(c, t))))
        of = [(c, t, now, work, self.config.crawlers[now].depth_limit, self.config.crawlers[now].external_peek) for (c, t), (now, work) in parsed.items()]
        table = F.broadcast(self.spark.createDataFrame(of, "crawler string, filetype string, now string, work string, own_limit int, peek int")) if of else None
        start = self._start(seeds, first, known)
        level = start.select(urls.dedup_key(F.col("url")).alias("key"), "url", "crawler", "filetype", F.lit(0).alias("depth"), F.lit(first.depth_limit).alias("most"), F.lit(False).alias("peeking"), urls.directory(F.col("url")).alias("jail"), F.lit(0).alias("hops"))
        if table is None:
            return cut(level.withColumns({"now": F.col("crawler"), "work": F.lit(None).cast("string")}), "level")
        out: list[DataFrame] = []
        seen: DataFrame | None = None
        pool = level
        # how many levels there were, how many by joins, and after how many of those there is a walk; jails are kept by joins only
        n, joined, due = 0, 0, LEVELS
        may_walk = not any(c.jail for c in crawlers)
        while True:
            # least depths first, so redirects, which keep the depth, come before the next level
            pool = pool if seen is None else pool.join(seen, "key", "left_anti")
            pool = cut(pool.groupBy("key").agg(F.min(F.struct("depth", "peeking", "hops", "url", "crawler", "filetype", "most", "jail")).alias("b")).select("key", "b.*"), "pool")
            least, deepest, waiting = pool.agg(F.min("depth"), F.max("depth"), F.count("*")).first()
            if least is None:
                break
            if may_walk and joined >= due and waiting <= WIDE:
                rows, settled, pool, depths = self._walk(pool, seen, stored, typed, crawlers, of, table)
                for d in depths.toLocalIterator() if "level" in self.hooks else ():
                    self._tell("level", n, d.depth)
                    n += 1
                out.append(rows)
                seen = settled if seen is None else cut(seen.union(settled), "seen")
                due = 2 * max(joined, 1)
                continue
            level = cut(self._allowed(pool.where(F.col("depth") == least).join(table, ["crawler", "filetype"], "left"), stored, crawlers), "level")
            self._tell("level", n, least)
            n, joined = n + 1, joined + 1
            rest = pool.where(F.col("depth") > least) if deepest > least else None
            out.append(level.select(*ROWS))
            now = pool.where(F.col("depth") == least).select("key")  # those that rules forbid are settled too
            seen = now if seen is None else seen.union(now)
            if joined % 8 == 0:
                seen = cut(seen, "seen")
            if len(out) == 32:  # else the plan of all levels outgrows the driver
                out = [cut(_union(out), "levels")]
            here = level.where("work is not null").select(F.col("key").alias("src_key"), F.col("now").alias("crawler"), "work", "depth", "most", "peeking", "jail", "hops", "own_limit", "peek")
            step = here.withColumnRenamed("work", "own_work").join(typed, ["src_key", "crawler"]).where("route != 'target' and (hop or work = own_work)")
            inside, hop, far = F.col("route") == "frontier", F.col("hop"), F.col("route") == "pending"
            root = (F.col("route") == "peek") & ~F.col("peeking")
            # where a page is only peeked at, other hosts wait for their turn if the crawler goes there at all
            waits = far | ((F.col("route") == "peek") & F.col("peeking") & F.col("crawler").isin([c.name for c in crawlers if c.external]))
            depth = F.when(root | waits, 0).when(hop, F.col("depth")).otherwise(F.col("depth") + 1)
            most = F.when(root, F.col("peek")).when(waits, F.col("own_limit")).otherwise(F.col("most"))
            jail = F.when(root | waits, urls.directory(F.col("url"))).otherwise(F.col("jail"))
            step = step.where(inside | root | waits).select("key", "url", "crawler", "filetype", depth.alias("depth"), most.alias("most"), (root | (F.col("peeking") & ~waits)).alias("peeking"), jail.alias("jail"), F.when(hop, F.col("hops") + 1).otherwise(0).alias("hops"))
            step = step.where(f"(most = 0 or depth < most) and hops < {HOPS}")
            pool = step if rest is None else step.unionByName(rest.select(*step.columns))
        if not out:
            return cut(level.withColumns({"now": F.col("crawler"), "work": F.lit(None).cast("string")}), "level")
        return _union(out)

    def _walk(self, pool: DataFrame, seen: DataFrame | None, stored: DataFrame, typed: DataFrame, crawlers: list[Crawler], of: list[tuple], table: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """The levels from ``pool`` on in one task: their rows, the keys settled, what still waits, and the levels' depths."""
        polite = [c.name for c in crawlers if c.robotstxt]
        links = typed.where("route != 'target'")
        links = cut(self._free(links if seen is None else links.join(seen, "key", "left_anti"), stored, polite), "links")
        pool = cut(self._free(pool, stored, polite), "waiting")
        # pages and URLs by number: a page has the number of its first URL, so URLs of a page are in order
        both = links.select("key", "url").union(pool.select("key", "url")).distinct()
        names = store.with_ids(both.select(F.struct("key", "url").alias("name")), "name", -1).select("name.key", "name.url", F.col("id").alias("number"))
        names = cut(names, "names")
        pages = cut(names.groupBy("key").agg(F.min("number").alias("page")), "numbered")
        some = ["crawler", "work", "hop", "route", "filetype", "free"]
        pool = pool.withColumns({"work": F.lit(None).cast("string"), "hop": F.lit(False), "route": F.lit("")})
        combos = links.select(*some).union(pool.select(*some)).distinct().collect()
        states = sorted({(r.crawler, r.filetype) for r in combos})
        kinds = [walk.Kind(r.crawler, r.work, r.hop, r.route, states.index((r.crawler, r.filetype)), r.free) for r in combos]
        sign = F.concat_ws("\n", "crawler", F.coalesce("work", F.lit("")), F.col("hop").cast("string"), "route", "filetype", F.col("free").cast("string"))
        text = lambda r: "\n".join([r.crawler, r.work or "", str(r.hop).lower(), r.route, r.filetype, str(r.free).lower()])
        kind = F.broadcast(self.spark.createDataFrame([(text(r), i) for i, r in enumerate(combos)], "sign string, kind int"))
        numbered = lambda df: df.withColumn("sign", sign).join(kind, "sign").join(names, ["key", "url"]).join(pages, "key")
        none = [F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in walk.TAKES.split(", ")[4:])]
        by_source = numbered(links).join(pages.select(F.col("key").alias("src_key"), F.col("page").alias("src")), "src_key").select("src", "page", F.col("number").alias("url"), "kind", *none)
        first = numbered(pool).select(F.lit(-1).cast("long").alias("src"), "page", F.col("number").alias("url"), "kind", "depth", "peeking", "hops", "most")
        parsed = {(c, t): x for c, t, *x in of}
        run = walk.walk(names.count(), kinds, [parsed.get(s) for s in states], {c.name for c in crawlers if c.external}, HOPS, WIDE)
        found = cut(by_source.union(first).repartition(1).sortWithinPartitions("src").mapInArrow(run, walk.GIVES), "walked")
        depths = found.where("level >= 0").groupBy("level").agg(F.min("depth").alias("depth")).orderBy("level").select("depth")
        state = F.broadcast(self.spark.createDataFrame([(i, *s) for i, s in enumerate(states)], "state int, crawler string, filetype string"))
        back = found.withColumnRenamed("url", "number").join(names, "number").join(state, "state")
        settled = cut(back.where("level >= 0").select("key", "url", "crawler", "filetype", "depth", "free"), "settled")
        rows = cut(settled.where("free").join(table, ["crawler", "filetype"], "left").select(*ROWS), "level")
        left = back.where("level < 0").select("key", "depth", "peeking", "hops", "url", "crawler", "filetype", "most", F.lit("").alias("jail"))
        return rows, settled.select("key"), left, depths

    def _results(self, rows: DataFrame, stored: DataFrame, typed: DataFrame, attributes: DataFrame, first: Crawler) -> Crawl:
        fetched = cut(rows.where("work is not null").join(stored.select("key"), "key", "left_semi").select("key", "url", "depth", "crawler", F.col("now"), "work", "filetype"), "crawled")
        by_link = typed.where("route = 'target'").join(fetched.select(F.col("key").alias("src_key"), F.col("now").alias("crawler"), F.col("work").alias("own_work")), ["src_key", "crawler"]).where("hop or work = own_work").select("key", "url", "filetype")
        plain = by_link.union(rows.where("work is null").select("key", "url", "filetype")).withColumn("attributes", F.lit(None).cast("map<string,string>"))
        filled = fetched.join(attributes, ["key", "filetype"]).select("key", "url", "filetype", "attributes")
        best = plain.unionByName(filled).groupBy("key").agg(F.min_by(F.struct("url", "filetype", "attributes"), F.struct(F.col("attributes").isNull(), F.col("filetype"), F.col("url"))).alias("t"))
        return Crawl(fetched.select("url", "depth", F.col("now").alias("crawler"), "filetype"), cut(best.select("t.*"), "targets"))

    def explain(self, crawler: str = "default") -> str:
        """The compiled rules of a crawler."""
        c = self.config.crawlers[crawler]
        return "\n".join([repr(c), *map(repr, self.config.types_of(c))])
