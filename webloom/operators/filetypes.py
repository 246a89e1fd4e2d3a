"""File types, crawlers and the classification of URLs as one CASE expression.

A policy says what becomes of a URL that its form doesn't settle: ``"lookup"`` (ask for
the MIME type), ``"discard"`` or ``"@filetype"``. An unset policy is a lookup.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import patterns, urls

LOOKUP, DISCARD = "lookup", "discard"
#: The class of a URL that needs its MIME type.
PENDING = "?"


@dataclass(frozen=True)
class FileType:
    name: str
    extensions: tuple[str, ...] = ()
    mimetypes: tuple[str, ...] = ()
    parser: str = ""
    handler: str = ""
    expr: str = ""
    crawler_switch: str = ""
    attributes: tuple[str, ...] = ()
    ignore_host: bool = False


@dataclass(frozen=True)
class Crawler:
    name: str
    filetypes: tuple[str, ...] = ()
    dynamic_url: str = LOOKUP
    extless_url: str = LOOKUP
    unknown_url: str = LOOKUP
    dir_url: str = LOOKUP
    ftp_dir_url: str = DISCARD
    external: bool = False
    external_peek: int = 0
    depth_limit: int = 1
    initial_filetype: str = ""
    init: str = ""
    spread_workers: bool = False
    jail: bool = False
    robotstxt: bool = False
    default_handler: str = ""


@dataclass
class Config:
    filetypes: dict[str, FileType] = field(default_factory=dict)
    crawlers: dict[str, Crawler] = field(default_factory=dict)
    scopes: dict[str, dict] = field(default_factory=dict)

    def types_of(self, crawler: Crawler) -> list[FileType]:
        """The crawler's file types in order; all, if it lists none."""
        return [self.filetypes[n] for n in crawler.filetypes] if crawler.filetypes else list(self.filetypes.values())


HTML = FileType("html", ("html", "htm", "php", "asp", "aspx", "jsp", "cgi"), ("text/html", "application/xhtml+xml"), "html")
TEXT = FileType("txt", ("txt",), ("text/plain",), "text")
CSS = FileType("css", ("css",), ("text/css",), "css")
_TARGETS = {
    "archive": (("zip", "rar", "tar", "gz", "bz2", "7z"), ()),
    "audio": (("mp3", "ogg", "wav", "flac", "wma"), ("audio/",)),
    "image": (("jpg", "jpeg", "png", "gif", "bmp", "svg"), ("image/",)),
    "video": (("avi", "mpg", "mpeg", "mp4", "mov", "wmv"), ("video/",)),
    "feed": (("rss", "atom", "xml"), ("application/rss+xml", "application/atom+xml")),
}


def default_config() -> Config:
    """The base crawler and one profile for each kind of target."""
    out = Config({t.name: t for t in (HTML, TEXT, CSS)})
    base = Crawler("default", ("html", "txt"), dynamic_url="@html", extless_url="@html", dir_url="@html", unknown_url=DISCARD)
    out.crawlers["default"] = base
    for name, (ext, mime) in _TARGETS.items():
        out.filetypes[name] = FileType(name, ext, mime)
        out.crawlers[name] = replace(base, name=name, filetypes=("html", "txt", name))
    out.crawlers["css"] = replace(base, name="css", filetypes=("html", "css"))
    pages = {
        "title": ("xmlconv, title", ("title TEXT",)),
        "meta": ("xmlconv, meta", ("meta TEXT",)),
        "source": ("source", ("source BLOB",)),
        "xmlsource": ("xmlconv, xmlsource", ("source BLOB",)),
        "validate": ("xmlconv, validator", ("errors INT", "warnings INT")),
        "youtube": ("xmlconv, youtube/youtube", ("results TEXT",)),
    }
    for name, (parser, attributes) in pages.items():
        out.filetypes[name] = replace(HTML, name=name, parser=parser, attributes=attributes)
        out.crawlers[name] = replace(base, name=name, filetypes=(name,), dynamic_url=f"@{name}", extless_url=f"@{name}", dir_url=f"@{name}")
    out.crawlers["youtube"] = replace(out.crawlers["youtube"], init="youtube/init")
    # result pages of searches; every other URL that isn't dynamic is a result
    out.filetypes["result"] = FileType("result", expr="FULL<*>")
    for name, expr, attributes in (("google", "PATH</search?*q=*start=*>", ()), ("wikipedia", "PATH</w/index.php?search*>", ("results TEXT",))):
        out.filetypes[name] = replace(HTML, name=name, parser=f"xmlconv, {name}/parser", expr=expr, attributes=attributes)
        out.crawlers[name] = replace(base, name=name, filetypes=(name, "result"), dynamic_url=f"@{name}", extless_url=f"@{name}", dir_url=f"@{name}", init=f"{name}/{name}_search_init")
    out.filetypes["ftp"] = FileType("ftp", parser="ftp")
    out.crawlers["ftp"] = replace(base, name="ftp", filetypes=("ftp",), ftp_dir_url="@ftp", dir_url=DISCARD)
    return out


def _policy(policy: str) -> Column:
    return F.lit(PENDING if policy in (LOOKUP, "") else None if policy == DISCARD else policy.removeprefix("@")).cast("string")


def _first(types: list[FileType], test) -> Column:
    """Name of the first file type that passes."""
    out = F.coalesce(*[F.when(test(t), F.lit(t.name)) for t in types]) if types else F.lit(None)
    return out.cast("string")


def classify(url: Column, crawler: Crawler, types: list[FileType]) -> Column:
    """File type of each URL, ``PENDING`` where a lookup must tell, null where it is discarded."""
    # the parts are bound once; inlined, they would be parsed anew in every branch
    is_dir = urls.path(url).rlike(r"^[^?#]*/([?#].*)?$")
    parts = F.struct(url.alias("url"), urls.scheme(url).alias("scheme"), urls.extension(url).alias("ext"), urls.is_dynamic(url).alias("dynamic"), is_dir.alias("is_dir"))
    return F.transform(F.array(parts), lambda p: _class(p, crawler, types))[0]


def _class(parts: Column, crawler: Crawler, types: list[FileType]) -> Column:
    url, ext, dynamic, is_dir = (parts[x] for x in ("url", "ext", "dynamic", "is_dir"))
    matches = lambda t: patterns.matches(url, t.expr) if t.expr else F.lit(False)
    by_ext = _first([t for t in types if t.extensions], lambda t: ext.isin(*t.extensions) & (matches(t) if t.expr else F.lit(True)))
    any_expr = _first([t for t in types if t.expr], matches)
    bare_expr = _first([t for t in types if t.expr and not t.extensions], matches)
    dynamic_then = lambda rest: rest if crawler.dynamic_url == DISCARD else _policy(crawler.dynamic_url)
    ftp_dir = _policy(crawler.ftp_dir_url if crawler.ftp_dir_url.startswith("@") else DISCARD)
    return (
        F.when(parts["scheme"] == "ftp", F.when(is_dir, ftp_dir).otherwise(by_ext))
        .when((ext == "") & dynamic, dynamic_then(any_expr))
        .when(ext == "", F.coalesce(any_expr, F.when(is_dir, _policy(crawler.dir_url)).otherwise(_policy(crawler.extless_url))))
        .when(dynamic, dynamic_then(F.coalesce(by_ext, bare_expr)))
        .otherwise(F.coalesce(by_ext, bare_expr, _policy(crawler.unknown_url)))
    )


def by_mime(content_type: Column, types: list[FileType]) -> Column:
    """File type of a content type; parameters are cut, ``image/`` stands for all of a kind."""
    mime = F.trim(F.lower(F.substring_index(content_type, ";", 1)))
    full = [(m, t.name) for t in types for m in t.mimetypes]
    return F.coalesce(*[F.when(mime.startswith(m) if m.endswith("/") else mime == m, F.lit(n)) for m, n in full], F.lit(None).cast("string"))


def sort_urls(df: DataFrame, url: str, crawler: Crawler, types: list[FileType], mime: DataFrame | None = None) -> DataFrame:
    """Add ``filetype``; pending URLs are settled by ``mime`` (url, content_type), the others dropped."""
    df = df.withColumn("filetype", classify(F.col(url), crawler, types))
    if mime is None:
        return df.where(F.col("filetype").isNotNull() & (F.col("filetype") != PENDING))
    known = mime.select(F.col("url").alias("_url"), by_mime(F.col("content_type"), types).alias("_type"))
    df = df.join(known, df[url] == known["_url"], "left").withColumn("filetype", F.when(F.col("filetype") == PENDING, F.col("_type")).otherwise(F.col("filetype")))
    return df.drop("_url", "_type").where(F.col("filetype").isNotNull())


def route(filetype: Column, external: Column, crawler: Crawler, types: list[FileType]) -> Column:
    """What becomes of a classified link: target, frontier, peek, pending or drop."""
    named = {t.name: t for t in types}
    targets = [n for n, t in named.items() if not t.parser and not t.handler]
    anywhere = [n for n, t in named.items() if t.ignore_host]
    far = "peek" if crawler.external_peek else "pending" if crawler.external else "drop"
    inside = ~external | filetype.isin(*anywhere)
    return F.when(filetype.isNull(), F.lit("drop")).when(filetype.isin(*targets), F.lit("target")).when(inside, F.lit("frontier")).otherwise(F.lit(far))


def switched(filetype: Column, crawler: Column, types: list[FileType]) -> Column:
    """The crawler that goes on from a page of this type."""
    return F.coalesce(*[F.when(filetype == t.name, F.lit(t.crawler_switch)) for t in types if t.crawler_switch], crawler)
