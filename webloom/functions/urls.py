"""URL algebra as Column expressions: no Python at run time.

Intent where the specification is ambiguous: percent-encoding is upper-case hex of the
UTF-8 bytes, dot segments are folded by whole segments only, the scheme is compared
without case. A link that begins with ``//`` is a path of the current host, and ``?x``
is appended to the directory, unless ``rfc3986`` is set.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMES = ("http", "https", "ftp", "ftps", "file")
_ABSOLUTE = r"(?i)^(https?|ftps?|file):/*([a-z0-9.:-]+)((?s:/.*)?)$"
_HAS_SCHEME = r"^[A-Za-z0-9]*:"


def guess_scheme(text: Column) -> Column:
    """Add the scheme that a user left out."""
    return (
        F.when(text.rlike(_HAS_SCHEME), text)
        .when(text.rlike(r"^\.?/"), F.concat(F.lit("file://"), text))
        .when(F.lower(text).startswith("ftp."), F.concat(F.lit("ftp://"), text))
        .otherwise(F.concat(F.lit("http://"), text))
    )


def scheme(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, _ABSOLUTE, 1)), F.lit(""))


def host(url: Column) -> Column:
    """Host with port; null where the URL is not valid."""
    return F.nullif(F.lower(F.regexp_extract(url, _ABSOLUTE, 2)), F.lit(""))


def path(url: Column) -> Column:
    """Path, query and fragment; "/" if there is none, null where the URL is not valid."""
    found = F.regexp_extract(url, _ABSOLUTE, 3)
    return F.when(host(url).isNotNull(), F.when(found == "", F.lit("/")).otherwise(found))


def host_key(name: Column) -> Column:
    """Lower case and without ``www.``, for comparisons."""
    low = F.lower(name)
    return F.when(F.length(low) > 4, F.regexp_replace(low, r"^www\.", "")).otherwise(low)


def encoded(text: Column) -> Column:
    """Bytes up to 0x20 and from 0x80 as %XX."""
    runs = F.regexp_extract_all(text, F.lit(r"([!-\x7f]+|[^!-\x7f]+)"), 1)
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^[!-\x7f]"), x).otherwise(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")))), "")


def normal_path(raw: Column) -> Column:
    """Encoded path with dot segments folded, and the query."""
    whole = F.regexp_extract(raw, r"(?s)^([^#]*)", 1)
    before = F.regexp_extract(whole, r"(?s)^([^?]*)", 1)
    query = F.regexp_extract(whole, r"(?s)^[^?]*(\?.*)$", 1)
    parts = F.filter(F.split(encoded(before), "/"), lambda x: (x != "") & (x != "."))
    fold = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)),
    )
    tail = F.when((F.size(fold) > 0) & before.rlike(r"(^|/)\.{0,2}$"), F.lit("/")).otherwise(F.lit(""))
    clean = F.replace(F.replace(query, F.lit("&amp;"), F.lit("&")), F.lit(" "), F.lit("+"))
    return F.concat(F.lit("/"), F.array_join(fold, "/"), tail, clean)


def normalized(url: Column) -> Column:
    """The URL in normal form, of any length; null where it is not valid."""
    return F.concat(scheme(url), F.lit("://"), host(url), normal_path(path(url)))


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url))


def directory(url: Column) -> Column:
    """Path up to its last slash, without the query."""
    return F.regexp_extract(F.regexp_extract(path(url), r"^([^?#]*)", 1), r"^(.*/)", 1)


def file_part(url: Column) -> Column:
    """After the last slash of the path, with the query."""
    return F.regexp_extract(F.regexp_extract(path(url), r"^([^#]*)", 1), r"^[^?]*/([^/?]*(?:\?.*)?)$", 1)


def extension(url: Column) -> Column:
    """Lower-cased extension of the file, "" without one."""
    return F.lower(F.regexp_extract(F.regexp_extract(path(url), r"^([^?#]*)", 1), r"/[^/]*\.([^./]+)$", 1))


def is_dynamic(url: Column) -> Column:
    return F.contains(F.regexp_extract(url, r"^([^#]*)", 1), F.lit("?"))


def resolved(base: Column, link: Column, rfc3986: bool = False) -> Column:
    """The link as seen from the page ``base``, in normal form; null if it leads nowhere."""
    inside = F.concat(origin(base), normal_path(F.concat(directory(base), link)))
    rooted = F.concat(origin(base), normal_path(link))
    if rfc3986:
        inside = F.when(link.startswith("?"), F.concat(origin(base), normal_path(F.concat(F.regexp_extract(path(base), r"^([^?#]*)", 1), link)))).otherwise(inside)
        rooted = F.when(link.startswith("//"), normalized(F.concat(scheme(base), F.lit(":"), link))).otherwise(rooted)
    return F.when(link.startswith("/"), rooted).when(link.rlike(_HAS_SCHEME), normalized(link)).otherwise(inside)


def is_external(base: Column, url: Column) -> Column:
    return (scheme(base) != scheme(url)) | (host_key(host(base)) != host_key(host(url)))


def dedup_key(url: Column, folded: bool = False) -> Column:
    """Pages of the same key are one page: scheme and case are ignored.

    With ``folded``, characters that differ by one bit only from others fall together too,
    as where keys have six bits a character.
    """
    key = F.lower(F.regexp_extract(url, r"(?s)^[^:]*://(.*)$", 1))
    return F.translate(key, '_`{|}~', '"@[\\]^') if folded else key


def download_name(url: Column) -> Column:
    name = F.regexp_extract(F.regexp_extract(path(url), r"^([^?#]*)", 1), r"([^/]*)$", 1)
    return F.when(name == "", F.lit("index.html")).otherwise(name)


def search_url(template: str, words: Column) -> Column:
    """A template's ``{}`` filled with the words of a query."""
    head, _, tail = template.partition("{}")
    return F.concat(F.lit(head), F.url_encode(words), F.lit(tail))
