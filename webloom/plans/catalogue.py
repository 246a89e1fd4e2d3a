"""Every registered query of the engine, with its DuckDB oracle."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.engine import Engine, run_chain
from webloom.functions import extract, patterns, urls, xmlconv
from webloom.operators import commands, filetypes, frontier, reports, rules, store
from webloom.plans import control
from webloom.session import is_folder, shared_dir, table
from webloom.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
_CONFIG = filetypes.default_config()
KINDS = ("default", "archive", "audio", "image", "video", "feed")
TAILS = ("", ".jpg", ".png", ".zip", ".css", ".rss")
ROBOTS = "User-agent: *\nDisallow: /de/ # german\nAllow: /de/1\n\nDisallow:\nUser-agent: other\nDisallow: /"



def _url() -> Column:
    return F.col("url")


# pieces of DuckDB SQL
_ABS = "(?i)^(https?|ftps?|file):/*([a-z0-9.:-]+)((?s:/.*)?)$"


def _host(u: str) -> str:
    return f"nullif(lower(regexp_extract({u}, '{_ABS}', 2)), '')"


def _scheme(u: str) -> str:
    return f"nullif(lower(regexp_extract({u}, '{_ABS}', 1)), '')"


def _path(u: str) -> str:
    return f"case when {_host(u)} is not null then coalesce(nullif(regexp_extract({u}, '{_ABS}', 3), ''), '/') end"


def _bare(p: str) -> str:
    return f"regexp_extract({p}, '^([^?#]*)', 1)"


def _ext(u: str) -> str:
    return f"lower(regexp_extract({_bare(_path(u))}, '/[^/]*\\.([^./]+)$', 1))"


def _key(h: str) -> str:
    return f"case when length({h}) > 4 then regexp_replace({h}, '^www\\.', '') else {h} end"


def _normal_path(raw: str) -> str:
    before = f"regexp_extract({raw}, '(?s)^([^?#]*)', 1)"
    runs = f"regexp_extract_all({before}, '([!-\\x7f]+|[^!-\\x7f]+)', 1)"
    enc = f"array_to_string(list_transform({runs}, lambda x: case when regexp_matches(x, '^[!-\\x7f]') then x else url_encode(x) end), '')"
    parts = f"list_filter(string_split({enc}, '/'), lambda x: x <> '' and x <> '.')"
    fold = f"list_reduce(list_transform({parts}, lambda x: [x]), lambda acc, x: case when x[1] = '..' then acc[1:greatest(len(acc) - 1, 0)] else list_concat(acc, x) end, []::varchar[])"
    query = f"regexp_extract(regexp_extract({raw}, '(?s)^([^#]*)', 1), '(?s)^[^?]*(\\?.*)$', 1)"
    return f"'/' || array_to_string({fold}, '/') || case when len({fold}) > 0 and regexp_matches({before}, '(^|/)\\.{{0,2}}$') then '/' else '' end || replace(replace({query}, '&amp;', '&'), ' ', '+')"


def _normalized(u: str) -> str:
    return f"{_scheme(u)} || '://' || {_host(u)} || {_normal_path(_path(u))}"


def _classify(u: str, name: str) -> str:
    crawler = _CONFIG.crawlers[name]
    cases = "".join(f" when {_ext(u)} in ({', '.join(repr(e) for e in t.extensions)}) then '{t.name}'" for t in _CONFIG.types_of(crawler) if t.extensions)
    return f"case when {u} like '%?%' or {_ext(u)} = '' then 'html'{cases} end"


# tags are cut at their ends first, then searched for the first of either attribute: another way than the engine's one pattern
_BODIES = "(?is)" + "|".join(f"<{t}[^>]*>.*?</{t}[ ]*>" for t in ("script", "style", "textarea"))
LINKS = f"""
tags as (select page_id, url, unnest(string_split(regexp_replace(html, '{_BODIES}', '<raw>', 'g'), '<')) as tag from pages),
heads as (select page_id, url, string_split(tag, '>')[1] as head from tags where regexp_matches(tag, '^[A-Za-z]') and contains(tag, '>')),
firsts as (select page_id, url, regexp_extract(head, '(?i)[ ](?:href|src)[ ]*=[ ]*(.*)$', 1) as tail from heads),
links as (select page_id, url, case when tail[1] in ('"', chr(39)) then string_split(tail, tail[1])[2] else string_split(tail, ' ')[1] end as link from firsts where tail <> ''),
anchored as (select * from links where link <> '' and link[1] <> '#')
"""
_RESOLVED = "{s} || '://' || {h} || {p}".format(s=_scheme("url"), h=_host("url"), p=_normal_path(f"case when link like '/%' then link else regexp_extract({_bare(_path('url'))}, '^(.*/)', 1) || link end"))


def _pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages")


def _links(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("page_id", "url", F.explode(extract.html_links(F.col("html"))).alias("link"))


def _tailed(s: SparkSession, d: str) -> DataFrame:
    """URLs with the extensions that the data lack."""
    tails = F.array(*[F.lit(t) for t in TAILS])
    return _pages(s, d).select("page_id", F.concat(urls.origin(_url()), F.regexp_extract(F.regexp_extract(urls.path(_url()), r"^([^?#]*)", 1), r"^(.*?)/?$", 1), F.element_at(tails, (F.pmod("page_id", F.lit(len(TAILS))) + 1).cast("int"))).alias("url"))


_TAILED = f"""tailed as (select page_id, {_scheme('url')} || '://' || {_host('url')} || regexp_extract({_bare(_path('url'))}, '^(.*?)/?$', 1) || [{', '.join(repr(t) for t in TAILS)}][(page_id % {len(TAILS)} + 1)::integer] as url from pages)"""

_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql:
        _ORACLE[name] = sql


_add(
    "links_by_host",
    lambda s, d: _links(s, d).groupBy(urls.host_key(urls.host(_url())).alias("host")).agg(F.count("*").alias("links"), F.countDistinct("link").alias("distinct_links")),
    f"with {LINKS} select {_key(_host('url'))} as host, count(*) as links, count(distinct link) as distinct_links from anchored group by 1",
)
_add(
    "url_parts",
    lambda s, d: _pages(s, d).select("page_id", urls.scheme(_url()).alias("scheme"), urls.host(_url()).alias("host"), urls.path(_url()).alias("path"), urls.directory(_url()).alias("directory"), urls.file_part(_url()).alias("file"), urls.extension(_url()).alias("ext"), urls.is_dynamic(_url()).alias("dynamic")),
    f"select page_id, {_scheme('url')} as scheme, {_host('url')} as host, {_path('url')} as path, regexp_extract({_bare(_path('url'))}, '^(.*/)', 1) as directory, regexp_extract(regexp_extract({_path('url')}, '^([^#]*)', 1), '^[^?]*/([^/?]*(?:\\?.*)?)$', 1) as file, {_ext('url')} as ext, regexp_extract(url, '^([^#]*)', 1) like '%?%' as dynamic from pages",
)
_add("url_normalized", lambda s, d: _pages(s, d).select("page_id", urls.normalized(F.concat(_url(), F.lit("/a/../é b/./c"))).alias("normal")), f"select page_id, {_normalized('u')} as normal from (select page_id, url || '/a/../é b/./c' as u from pages)")
_add("url_dedup_key", lambda s, d: _pages(s, d).select("page_id", urls.dedup_key(urls.normalized(_url())).alias("key")), f"select page_id, lower(regexp_extract({_normalized('url')}, '(?s)^[^:]*://(.*)$', 1)) as key from pages")
_guess = "case page_id % 3 when 0 then url when 1 then regexp_replace(url, '^https?://', '') else '/' || cast(page_id as string) end"
_add(
    "url_guess_scheme",
    lambda s, d: _pages(s, d).select("page_id", urls.guess_scheme(F.expr(_guess)).alias("guessed")),
    f"select page_id, case when regexp_matches(u, '^[A-Za-z0-9]*:') then u when regexp_matches(u, '^\\.?/') then 'file://' || u when lower(u) like 'ftp.%' then 'ftp://' || u else 'http://' || u end as guessed from (select page_id, {_guess} as u from pages)",
)
_add("resolved_links", lambda s, d: _links(s, d).select("page_id", "link", urls.resolved(_url(), F.col("link")).alias("resolved")), f"with {LINKS} select page_id, link, {_RESOLVED} as resolved from anchored")
_add(
    "edges_internal_external",
    lambda s, d: _links(s, d).select("page_id", urls.resolved(_url(), F.when(F.pmod("page_id", F.lit(2)) == 0, F.col("link")).otherwise(F.concat(F.lit("http://other.example.com"), F.col("link")))).alias("dst"), _url()).groupBy(urls.is_external(_url(), F.col("dst")).alias("external")).agg(F.count("*").alias("edges"), F.countDistinct("dst").alias("targets")),
    f"with {LINKS}, e as (select page_id % 2 = 1 as external, case when page_id % 2 = 0 then {_RESOLVED} else 'http://other.example.com' || {_normal_path('link')} end as dst from anchored) select external, count(*) as edges, count(distinct dst) as targets from e group by external",
)
for _kind in KINDS:
    _add(
        f"targets_{_kind}",
        lambda s, d, k=_kind: _tailed(s, d).select("page_id", "url", filetypes.classify(_url(), _CONFIG.crawlers[k], _CONFIG.types_of(_CONFIG.crawlers[k])).alias("filetype")).where("filetype is not null"),
        f"with {_TAILED} select * from (select page_id, url, {_classify('url', _kind)} as filetype from tailed) where filetype is not null",
    )
_add(
    "filetype_counts",
    lambda s, d: _tailed(s, d).groupBy(filetypes.classify(_url(), _CONFIG.crawlers["image"], _CONFIG.types_of(_CONFIG.crawlers["image"])).alias("filetype")).agg(F.count("*").alias("matches")),
    f"with {_TAILED} select {_classify('url', 'image')} as filetype, count(*) as matches from tailed group by 1",
)
_mime = "case page_id % 5 when 0 then 'text/html; charset=utf-8' when 1 then 'IMAGE/png' when 2 then 'audio/ogg' when 3 then 'text/plain' else 'application/x-unknown' end"
_add("mime_class", lambda s, d: _pages(s, d).select("page_id", filetypes.by_mime(F.expr(_mime), [filetypes.HTML, filetypes.TEXT, _CONFIG.filetypes["image"], _CONFIG.filetypes["audio"]]).alias("filetype")), "select page_id, case page_id % 5 when 0 then 'html' when 1 then 'image' when 2 then 'audio' when 3 then 'txt' end as filetype from pages")
for _name, _pattern, _sql in (
    ("path", "PATH</de/*>", f"{_path('url')} like '/de/%'"),
    ("host", "HOST<*.example.com>", f"{_host('url')} like '%.example.com'"),
    ("file", "*.html", f"regexp_extract(regexp_extract({_path('url')}, '^([^#]*)', 1), '^[^?]*/([^/?]*(?:\\?.*)?)$', 1) like '%.html'"),
    ("full", "FULL(http*://*example*/en/*) HOST<*net>", f"url like 'http%://%example%/en/%' and {_host('url')} like '%net'"),
):
    _add(f"pattern_{_name}", lambda s, d, p=_pattern: _pages(s, d).where(patterns.matches(_url(), p)).select("page_id", "url"), f"select page_id, url from pages where {_sql}")
#: Robots files by page_id % 4: rules for others, an allowed part, comments and an empty rule, none at all.
_ROBOTS = ["User-agent: other\nDisallow: /", ROBOTS, "# all\nDisallow: /en/ # here\nUser-Agent: WEB\ndisallow: /fr", ""]
_add(
    "robots_allowed",
    lambda s, d: _pages(s, d).select("page_id", rules.allowed(urls.path(_url()), rules.robots_rules(F.element_at(F.array(*[F.lit(x) for x in _ROBOTS]), (F.col("page_id") % 4 + 1).cast("int")), "webloom/1")).alias("allowed")),
    f"select page_id, case page_id % 4 when 1 then p like '/de/1%' or not p like '/de/%' when 2 then not (p like '/en/%' or p like '/fr%') else true end as allowed from (select page_id, {_path('url')} as p from pages)",
)
_add("jail_filter", lambda s, d: _pages(s, d).where(rules.in_jail(_url(), F.concat(urls.origin(_url()), F.lit("/EN/index.html")))).select("page_id"), f"select page_id from pages where lower({_path('url')}) like '/en/%'")
#: All URLs of a host in one text, in forms that follow one another.
def _css() -> Column:
    form = lambda words, i: F.element_at(F.array(*[F.lit(x) for x in words]), i % 4 + 1)
    before, after = ('a{background:url("', "b{background:url('", "c{background: url( ", "@import url "), ('")} ', "')} ", " )} ", "; ")
    return F.array_join(F.transform("urls", lambda u, i: F.concat(form(before, i), u, form(after, i))), "")


def _by_host(s: SparkSession, d: str) -> DataFrame:
    clean = F.regexp_replace(_url(), r"[#;'\"() ].*$", "")
    return _pages(s, d).groupBy(urls.host_key(urls.host(_url())).alias("host")).agg(F.sort_array(F.collect_list(clean)).alias("urls"))


_cleaned = "regexp_replace(url, '[#;''\"() ].*$', '')"
_add("css_links", lambda s, d: _by_host(s, d).select("host", F.explode(extract.css_links(_css())).alias("link")), f"select {_key(_host('url'))} as host, {_cleaned} as link from pages")
_add("text_links", lambda s, d: _by_host(s, d).select("host", F.explode(extract.text_links(F.concat(F.lit("see "), F.array_join("urls", ", then ("), F.lit(") ")))).alias("link")), f"select {_key(_host('url'))} as host, regexp_extract({_cleaned}, '^(http://[A-Za-z0-9%?=&/.]+)', 1) as link from pages where url like 'http://%'")
_add("entities_decoded", lambda s, d: _pages(s, d).select("page_id", F.md5(extract.decode_entities(F.col("html"))).alias("digest")), "select page_id, md5(replace(replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', chr(1)), chr(1), '&')) as digest from pages")
_add("page_charset", lambda s, d: _pages(s, d).select("page_id", extract.charset(F.lit(None).cast("string"), F.col("html")).alias("charset")), "select page_id, lower(coalesce(nullif(regexp_extract(html, '(?is)<meta[^>]*\\bcharset\\s*=\\s*[\"'']?([a-z0-9_.:-]+)', 1), ''), 'utf-8')) as charset from pages")
_add("page_title", lambda s, d: _pages(s, d).select("page_id", extract.title(F.col("html")).alias("title")), "select page_id, nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1), '') as title from pages")
_meta = "concat('<meta charset=x><META content=\"', cast(page_id as string), '\" lang=en name=''id''>', html, '<meta name=n', page_id % 3, ' content=\"a > b\" />')"
_add(
    "page_meta",
    lambda s, d: _pages(s, d).select("page_id", F.explode(extract.meta(F.expr(_meta))).alias("m")).select("page_id", "m.name", "m.content"),
    "select page_id, 'id' as name, page_id::varchar as content from pages union all select page_id, 'n' || (page_id % 3), 'a > b' from pages",
)
_add("page_source", lambda s, d: _pages(s, d).select("page_id", "html"), "select page_id, html from pages")
_add("page_xml", lambda s, d: _pages(s, d).select("page_id", xmlconv.to_xml(F.col("html"))["xml"].alias("xml")))
_add("page_xml_titles", lambda s, d: _pages(s, d).select("page_id", F.replace(F.xpath_string(xmlconv.to_xml(F.col("html"))["xml"], F.lit("//title")), F.lit("&amp;"), F.lit("&amp;")).alias("title")), "select page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1) as title from pages")
_add("page_wellformed", lambda s, d: _pages(s, d).select("page_id", xmlconv.to_xml(F.col("html")).alias("x")).select("page_id", "x.unclosed", "x.stray"))
_name = f"coalesce(nullif(regexp_extract({_bare(_path('url'))}, '([^/]*)$', 1), ''), 'index.html')"
_add(
    "download_names",
    lambda s, d: store.filenames(_pages(s, d).select("page_id", urls.download_name(_url()).alias("name")), "name", "page_id"),
    f"select page_id, name, case when n > 0 then name || '-' || n else name end as saved_as from (select page_id, name, row_number() over (partition by name order by page_id) - 1 as n from (select page_id, {_name} as name from pages))",
)
_add(
    "first_seen_dedup",
    lambda s, d: frontier.first_seen(_pages(s, d).select("page_id", urls.dedup_key(urls.normalized(_url())).alias("key")).union(_pages(s, d).select(F.col("page_id") + 1_000_000, urls.dedup_key(urls.normalized(F.upper(_url()))))), "key", "page_id"),
    f"select min(page_id) as page_id, key from (select page_id, lower(regexp_extract({_normalized('url')}, '(?s)^[^:]*://(.*)$', 1)) as key from pages union all select page_id + 1000000, lower(regexp_extract({_normalized('upper(url)')}, '(?s)^[^:]*://(.*)$', 1)) from pages) group by key",
)


def _frontier(s: SparkSession, d: str) -> DataFrame:
    n = _pages(s, d).agg(F.count("*").alias("n"))
    links = _pages(s, d).crossJoin(F.broadcast(n)).select(F.col("page_id").alias("src"), F.explode(F.array((2 * F.col("page_id") + 1) % F.col("n"), (2 * F.col("page_id") + 2) % F.col("n"))).alias("dst"))
    return frontier.expand(_pages(s, d).where("page_id = 0").select(F.col("page_id").alias("page")), links, 0)


_add(
    "frontier_depth",
    _frontier,
    "with recursive n as (select count(*) as n from pages), e as (select page_id as src, unnest([(2 * page_id + 1) % n, (2 * page_id + 2) % n]) as dst from pages, n), r(page, depth) as (select page_id, 0 from pages where page_id = 0 union select e.dst, r.depth + 1 from r join e on e.src = r.page where r.depth < 20) select page, min(depth) as depth from r group by page",
)
_add("sha1_urls", lambda s, d: _pages(s, d).select("page_id", store.url_hash(_url()).alias("hash")), "select page_id, sha1(url) as hash from pages")


def _upsert(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").select(F.sha1(F.col("user_id").cast("string")).alias("hash"), F.col("ts").alias("date"), F.col("event_id").alias("event"))
    return store.upsert(rows.where("event % 2 = 0"), rows.where("event % 2 = 1"), "hash")


_add("url_upsert", _upsert, "select sha1(user_id::varchar) as hash, max(ts) as date, arg_max(event_id, {'d': ts, 'e': event_id}) as event from events group by 1")
_C = f"with {control.SQL} "
_JOIN = "s.id, s.client_id, c.token, s.added_id, a.crawler, a.input, s.date, s.latest, s.state from {s} s left join nol_client c on c.id = s.client_id left join nol_added a on a.id = s.added_id"
_add("session_info", lambda s, d: reports.session_info(control.sessions(s, d), control.clients(s, d), control.added(s, d), 77), _C + "select " + _JOIN.format(s="nol_session") + " where s.id = 77")
_add("list_sessions", lambda s, d: reports.list_sessions(control.sessions(s, d), control.clients(s, d), control.added(s, d), 20, 50), _C + ", top as (select * from nol_session order by latest desc, id desc limit 50 offset 20) select " + _JOIN.format(s="top"))
_add("list_input", lambda s, d: reports.list_input(control.added(s, d), control.sessions(s, d), 7), _C + "select a.id, a.crawler, a.input, a.date, s.id as session_id, s.state from nol_added a left join nol_session s on s.added_id = a.id where a.user_id = 7 order by a.id desc, s.id desc nulls last limit 1000")
_add("list_users", lambda s, d: reports.list_users(control.users(s, d), 10, 100), _C + 'select id, "user", level from nol_user where not deleted order by id desc limit 100 offset 10')
_add("system_info", lambda s, d: reports.system_info(control.sessions(s, d), control.users(s, d)), _C + "select (select count(*) from nol_session) as sessions, (select count(*) from nol_user) as users")
_add("next_due_input", lambda s, d: reports.next_due(control.added(s, d), control.NOW), _C + f"select * from nol_added where date <= timestamp '{control.NOW}' order by date desc, id desc limit 1")


def _rel(s: SparkSession, d: str) -> DataFrame:
    return control.sessions(s, d).select((F.col("id") % 97).alias("session_id"), F.expr("case when id % 3 = 0 then 'html' else 'image' end").alias("filetype"), (F.col("id") % 1000).alias("target_id"))


_add("session_counts", lambda s, d: store.session_counts(_rel(s, d), ["html", "image"]), _C + ", rel as (select distinct id % 97 as session_id, case when id % 3 = 0 then 'html' else 'image' end as filetype, id % 1000 as target_id from nol_session) select session_id, count(*) filter (filetype = 'html') as count_html, count(*) filter (filetype = 'image') as count_image from rel group by session_id")
_add("least_loaded_slave", lambda s, d: reports.least_loaded(table(s, d, "supplier").select(F.col("s_nationkey").alias("slave")), "slave"), "select slave, clients from (select s_nationkey as slave, count(*) as clients from supplier group by 1) order by clients, slave limit 1")
_add("clients_per_slave", lambda s, d: table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("slave")).agg(F.count("*").alias("clients")), "select s_nationkey as slave, count(*) as clients from supplier group by 1")
_add("session_state", lambda s, d: reports.session_state(table(s, d, "events"), "user_id", ["ts", "event_id"], "event_type"), "select user_id, arg_max(event_type, {'t': ts, 'e': event_id}) as state, count(*) as events from events group by user_id")
_add("insert_ignore_rel", lambda s, d: store.insert_ignore(_rel(s, d).where("session_id < 50").distinct(), _rel(s, d), ["session_id", "filetype", "target_id"]), _C + "select distinct id % 97 as session_id, case when id % 3 = 0 then 'html' else 'image' end as filetype, id % 1000 as target_id from nol_session")
_line = "concat(if(p_partkey % 5 = 0, 'd', '-'), 'rw-r--r--   1 root  other  ', p_size * 100, ' Jan ', 1 + p_partkey % 28, ' 1994 ', p_name)"
_add(
    "ftp_entries",
    lambda s, d: table(s, d, "part").select("p_partkey", extract.list_entry(F.expr(_line)).alias("e")).select("p_partkey", "e.*"),
    "select p_partkey, p_name as name, p_partkey % 5 = 0 as is_dir, (p_size * 100)::bigint as size, make_timestamp(1994, 1, 1 + p_partkey % 28, 0, 0, 0) as mtime from part",
)


# commands
_add(
    "add_input",
    lambda s, d: commands.add(control.added(s, d), 7, store.LEVELS["write"], "images  http://x.com/a b ", control.NOW).where("user_id = 7"),
    _C + f"select * from nol_added where user_id = 7 union all select max(id) + 1, 7, 'images', 'http://x.com/a b', timestamp '{control.NOW}' from nol_added",
)
_add("user_add", lambda s, d: commands.user_add(control.users(s, d), store.LEVELS["manager"], "New User", "", 2).select("id", "user", "level", "deleted").orderBy(F.desc("id")).limit(5), _C + """select * from (select id, "user", level, deleted from nol_user union all select max(id) + 1, 'New User', 2, false from nol_user) order by id desc limit 5""")
_add("user_delete", lambda s, d: reports.list_users(commands.user_delete(control.users(s, d), store.LEVELS["manager"], 149)), _C + 'select id, "user", level from nol_user where not deleted and id <> 149 order by id desc limit 100')
_add("list_clients", lambda s, d: commands.list_clients(control.status(s, d), 3), _C + 'select token, "user", status % 2 as running, address, session_id from nol_latest where slave = 3')
_add("client_info", lambda s, d: commands.client_info(control.status(s, d), store.LEVELS["read"], "b6589fc6ab0dc82cf12099d1c2d40ab994e8410c"), _C + """select token, "user", slave, status % 2 as running, address, session_id from nol_latest where token = 'b6589fc6ab0dc82cf12099d1c2d40ab994e8410c'""")
_add("slave_info", lambda s, d: commands.slave_info(control.slaves(s, d), control.status(s, d), 4), _C + "select n_nationkey as id, n_name || '-' || n_nationkey as name, '10.1.0.4:5004' as address, (select count(*) from nol_latest where slave = 4) as clients from nation where n_nationkey = 4")
_add("session_report", lambda s, d: commands.session_report(control.sessions(s, d).withColumn("report", F.concat_ws(" ", "state", F.col("client_id"))), 77), _C + "select id, state || ' ' || client_id as report from nol_session where id = 77")
_add("system_status", lambda s, d: commands.system_info(control.sessions(s, d), control.users(s, d), control.slaves(s, d), "1996-12-31 22:00:00", control.NOW), _C + "select 7200::bigint as uptime, (select count(*) from nation) as slaves, (select count(*) from nol_session) as sessions, (select count(*) from nol_user) as users")
_add("login", lambda s, d: commands.login(control.users(s, d).withColumn("pass", F.md5("user")), "Customer#000000003", hashlib.md5(b"Customer#000000003").hexdigest()), _C + """select id, "user", level from nol_user where "user" = 'Customer#000000003' and not deleted""")
_add("requeue_due", lambda s, d: jobs.taken(control.added(s, d), control.NOW)[1].groupBy("user_id").agg(F.min("date").alias("next"), F.count("*").alias("inputs")), _C + f"select user_id, min(case when date <= timestamp '{control.NOW}' then timestamp '{control.NOW}' + interval 28 day else date end) as next, count(*) as inputs from nol_added group by user_id")
_add("users_xml", lambda s, d: commands.to_xml(reports.list_users(control.users(s, d), 0, 100), "user"), _C + """select '<user><id>' || id || '</id><user>' || "user" || '</user><level>' || level || '</level></user>' as xml from (select * from nol_user where not deleted order by id desc limit 100)""")


# streams
def _streamed(s: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of files."""
    path, stream = f"{d}/{name}.parquet", s.readStream.schema(table(s, d, name).schema)
    # only a folder can be the source of a stream, so a file is picked out of its folder
    return stream.parquet(path) if is_folder(s, path) else stream.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _folder(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/webloom/{name}-{uuid.uuid4().hex}"


_add(
    "stream_dedup",
    lambda s, d: jobs.replayed(s, jobs.new_urls(_streamed(s, d, "pages"), "url").select("dedup_key"), _folder(s, "dedup")),
    f"select distinct lower(regexp_extract({_normalized('url')}, '(?s)^[^:]*://(.*)$', 1)) as dedup_key from pages",
)
_signal = "case event_type when 'signup' then 'start' when 'click' then 'idle' when 'purchase' then 'complete' when 'error' then 'disconnect' else 'start' end"
_add(
    "stream_lives",
    lambda s, d: jobs.replayed(s, jobs.lives(_streamed(s, d, "events").selectExpr("user_id", "ts", "event_id", f"{_signal} as signal"), "user_id", ["ts", "event_id"], "signal"), _folder(s, "lives"), "update"),
    f"""
with recursive e as (select user_id, {_signal} as signal, row_number() over (partition by user_id order by ts, event_id) as k from events),
t(state, signal, after) as (values {', '.join(f"('{a}', '{b}', '{c}')" for (a, b), c in jobs.LIFE.items())}),
r(user_id, k, state, steps) as (
  select distinct user_id, 0::bigint, '', 0 from e
  union all select r.user_id, e.k, coalesce(t.after, r.state), r.steps + (t.after is not null)::integer from r join e on e.user_id = r.user_id and e.k = r.k + 1 left join t on t.state = r.state and t.signal = e.signal
)
select user_id, arg_max(state, k) as state, arg_max(steps, k)::integer as steps from r group by user_id
""",
)

# crawls over sites made of the pages' ids: page i links to 2i + 1 and 2i + 2
def _site(s: SparkSession, d: str, hosts: int) -> tuple[DataFrame, DataFrame]:
    """Seeds and pages; page i is on host i % hosts in directory i % 3 and has a picture of its own."""
    n = _pages(s, d).agg(F.count("*").alias("n"))
    at = lambda i: F.format_string("http://h%d.site/d%d/p%d.html", F.pmod(i, F.lit(hosts)), F.pmod(i, F.lit(3)), i)
    rows = _pages(s, d).select("page_id").crossJoin(F.broadcast(n))
    a, b = (2 * F.col("page_id") + 1) % F.col("n"), (2 * F.col("page_id") + 2) % F.col("n")
    html = F.concat(F.lit("<p><a href="), at(a), F.lit(">a</a> <A HREF='"), at(b), F.lit("'>b</A> <img src=\"i"), F.col("page_id").cast("string"), F.lit(".png\"> <a href='mailto:x@y'> <a href=#top>"))
    moved = F.col("page_id") % 5 == 4
    site = rows.select("page_id", at(F.col("page_id")).alias("url"), html.alias("html"), F.when(moved, F.lit(301)).otherwise(200).alias("status"), F.when(moved, at((3 * F.col("page_id") + 1) % F.col("n"))).alias("location"))
    return s.range(1).select(at(F.col("id")).alias("url")), site


def _crawl(hosts: int, redirects: bool = False, robots: str = "", **options):
    def query(s: SparkSession, d: str) -> DataFrame:
        seeds, site = _site(s, d, hosts)
        site = site if redirects else site.drop("status", "location")
        site = site.drop("page_id")
        if robots:
            site = site.unionByName(s.createDataFrame([("http://h0.site/robots.txt", robots)], "url string, html string"))
        config = filetypes.default_config()
        config.crawlers["image"] = replace(config.crawlers["image"], **options)
        found = Engine(s, config).run(seeds, site, "image")
        number = lambda p: F.regexp_extract("url", p, 1).cast("long").alias("page")
        pictures = found.targets.select(number(r"/i(\d+)\.png$"), F.lit(None).cast("int").alias("depth"), "filetype")
        return found.crawled.select(number(r"/p(\d+)\.html$"), "depth", "filetype").union(pictures)

    return query


def _crawl_sql(step: str, go: str = "true") -> str:
    """Least depths by recursion; ``step`` says which (to, more) follow a page, ``go`` which pages are entered."""
    return f"""
with recursive n as (select count(*) as n from pages),
e as (select page_id as i, unnest([(2 * page_id + 1) % n, (2 * page_id + 2) % n]) as j, (3 * page_id + 1) % n as k from pages, n),
s as ({step}),
r(page, depth) as (select 0::bigint, 0 union select s.j, r.depth + s.more from r join s on s.i = r.page where r.depth + s.more < 6 and {go}),
c as (select page, min(depth)::integer as depth from r group by page)
"""


_OUT = "select page, depth, 'html' as filetype from c {w} union all select page, null, 'image' from c {w}"
_PLAIN = "select i, j, 1 as more from e"
_add("crawl_default", _crawl(1, depth_limit=6), _crawl_sql(_PLAIN) + _OUT.format(w=""))
_add("crawl_jail", _crawl(1, depth_limit=6, jail=True), _crawl_sql(_PLAIN, "s.j % 3 = 0") + _OUT.format(w=""))
_add("crawl_robots", _crawl(1, depth_limit=6, robotstxt=True, robots="User-agent: *\nDisallow: /d1/\nDisallow: /d2/p2\nAllow: /d1/p1\n"), _crawl_sql(_PLAIN, "(('/d' || s.j % 3 || '/p' || s.j) like '/d1/p1%' or not (s.j % 3 = 1 or ('/d' || s.j % 3 || '/p' || s.j) like '/d2/p2%'))") + _OUT.format(w=""))
# a moved page is fetched, but only its new place is parsed
_add("crawl_redirect", _crawl(1, True, depth_limit=6), _crawl_sql("select distinct i, k as j, 0 as more from e where i % 5 = 4 union all select i, j, 1 from e where i % 5 <> 4") + "select page, depth, 'html' as filetype from c union all select page, null, 'image' from c where page % 5 <> 4")
_add(
    "crawl_peek",
    _crawl(2, depth_limit=6, external_peek=1),
    _crawl_sql(_PLAIN, "s.j % 2 = 0") + ", p as (select c.page, c.depth from c union all select distinct e.j, 0 from c join e on e.i = c.page where e.j % 2 = 1) select page, depth::integer as depth, 'html' as filetype from p union all select page, null, 'image' from p",
)
_add(
    "crawl_external",
    _crawl(2, depth_limit=1, external=True),
    # on another host the count of levels begins anew, so only links to the other host lead on
    "with recursive n as (select count(*) as n from pages), e as (select page_id as i, unnest([(2 * page_id + 1) % n, (2 * page_id + 2) % n]) as j from pages, n), r(page) as (select 0::bigint union select e.j from r join e on e.i = r.page where (e.i + e.j) % 2 = 1), c as (select page, 0 as depth from r) " + _OUT.format(w=""),
)
# result pages of searches
_hit = {
    "google": "concat('<p><a class=l href=\"', url, '\">x</a><a class=m href=no><a href=no class=\"l x\">')",
    "wikipedia": "concat('<ul class=other><li><a href=no title=no></ul><ul class=mw-search-results><li><a title=\"t', page_id, '\" href=\"/wiki/', page_id, '\">x</a></li><li><a href=\"/b\" title=b>y</a></ul>')",
    "youtube": "concat('<div class=video-long-title><b>new</b><a title=t', page_id, ' href=\"/watch?v=', page_id, '\">x</a><a title=no href=no>y</div><div class=video-title><a title=no href=no>')",
}


def _profile(name: str):
    def query(s: SparkSession, d: str) -> DataFrame:
        pages = _pages(s, d).select("page_id", "url", F.expr(_hit[name]).alias("html"))
        done = run_chain(pages, _CONFIG.filetypes[name].parser)
        if name == "google":
            return done.select("page_id", F.explode("links").alias("href"))
        return done.select("page_id", F.inline("results"))

    return query


_add("profile_google", _profile("google"), "select page_id, url as href from pages")
_add("profile_wikipedia", _profile("wikipedia"), "select page_id, 't' || page_id as title, '/wiki/' || page_id as href from pages union all select page_id, 'b', '/b' from pages")
_add("profile_youtube", _profile("youtube"), "select page_id, 't' || page_id as title, '/watch?v=' || page_id as href from pages")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
