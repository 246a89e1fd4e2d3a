"""The URL pattern language: ``PART<pattern>`` terms, all of which must match.

Parts are PATH, HOST, FILE and FULL; the delimiter is any character, and brackets pair
up. A pattern without a part is about FILE. ``*`` stands for any text and ``[?]`` for one
character. Literal forms compile to equality, prefix, suffix or substring tests, of which
those about FULL on a bare column reach the scan as filters; others to one anchored regular
expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import urls

_PAIRS = {"(": ")", "<": ">", "{": "}", "[": "]"}


def terms(pattern: str) -> list[tuple[str, str]]:
    """(part, pattern) of each term; ValueError if the pattern is malformed."""
    out, at = [], 0
    while at < len(pattern):
        while at < len(pattern) and pattern[at] in " \t\n&":
            at += 1
        if at == len(pattern):
            break
        head = re.match(r"(PATH|HOST|FILE|FULL)", pattern[at:])
        if not head:
            if out:
                raise ValueError(f"a part is missing at {pattern[at:]!r}")
            return [("FILE", pattern.strip())]
        at += 4
        if at == len(pattern):
            raise ValueError("a delimiter is missing")
        end = pattern.find(_PAIRS.get(pattern[at], pattern[at]), at + 1)
        if pattern[at] == "[":
            end = pattern.rfind("]")
        if end < 0:
            raise ValueError(f"{pattern[at]!r} isn't closed")
        out.append((head[1], pattern[at + 1 : end]))
        at = end + 1
    if not out:
        raise ValueError("the pattern is empty")
    return out


def _regex(text: str) -> str:
    out = []
    for piece in re.split(r"(\*|\[[^\]]*\])", text):
        if piece == "*":
            out.append(r"[\x00-\x{10FFFF}]*")
        elif piece.startswith("["):
            if piece != "[?]":
                raise ValueError(f"only [?] is known, not {piece}")
            out.append(r"[\x00-\x{10FFFF}]")
        else:
            out.append(re.sub(r"([^A-Za-z0-9_/])", r"\\\1", piece))
    return "^" + "".join(out) + "$"


def test(subject: Column, text: str) -> Column:
    """Whether the subject matches one term's pattern."""
    if "[" in text:
        return subject.rlike(_regex(text))
    body = text.strip("*")
    if not body:
        return (subject == "") if text == "" else subject.isNotNull()
    if "*" in body:
        return subject.rlike(_regex(text))
    head, tail = text.startswith("*"), text.endswith("*")
    if head and tail:
        return subject.contains(body)
    return subject.endswith(body) if head else subject.startswith(body) if tail else subject == body


def matches(url: Column, pattern: str) -> Column:
    """Whether a URL matches every term of a pattern."""
    subject = {"PATH": urls.path, "HOST": urls.host, "FILE": urls.file_part, "FULL": lambda u: u}
    out = F.lit(True)
    for part, text in terms(pattern):
        out = out & test(subject[part](url), text)
    return out
