"""HTML to well-formed XML: an automaton with a stack of open elements, which no built-in has.

The result always parses: doctype, comments and instructions go, names become lower case,
values are quoted, void elements close themselves, an end tag closes back to its start tag
or goes, open elements are closed at the end, and text outside the root goes. ``&`` becomes
``&amp;`` everywhere, so entities survive as text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

VOID = frozenset("br hr img link meta base basefont area input".split())
RAW = frozenset(("textarea", "script", "style"))
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<\?.*?(?:>|\Z)|<![^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9_.-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTR = re.compile(r"([A-Za-z_][A-Za-z0-9_.-]*)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_BAD = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def _text(x: str) -> str:
    return x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def convert(html: str | None) -> tuple[str | None, int, int]:
    """The document, the elements that had to be closed and the end tags that had to go."""
    if html is None:
        return None, 0, 0
    html = _BAD.sub("", html)
    out: list[str] = []
    stack: list[str] = []
    open_count: dict[str, int] = {}
    at = unclosed = stray = 0
    root_done = False
    while at < len(html):
        m = _TOKEN.search(html, at)
        if stack:
            out.append(_text(html[at : m.start() if m else len(html)]))
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name or root_done:
            continue
        if m[1]:
            if not open_count.get(name):
                stray += 1
                continue
            while stack:
                top = stack.pop()
                open_count[top] -= 1
                out.append(f"</{top}>")
                if top == name:
                    break
                unclosed += 1
            root_done = not stack
            continue
        if not stack and name != "html":
            stack.append("html")
            open_count["html"] = 1
            out.append("<html>")
        attrs = {}
        for k, v in _ATTR.findall(m[3]):
            k = k.lower()
            if not k.startswith("xmlns"):
                attrs.setdefault(k, v[1:-1] if v[0] in "\"'" else v.rstrip("/"))
        tag = name + "".join(f' {k}="{_text(v).replace(chr(34), "&quot;")}"' for k, v in attrs.items())
        if name in VOID or m[3].rstrip().endswith("/"):
            out.append(f"<{tag}/>")
            continue
        out.append(f"<{tag}>")
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            out += [_text(html[at : end.start() if end else len(html)]), f"</{name}>"]
            unclosed += end is None
            at = end.end() if end else len(html)
            continue
        stack.append(name)
        open_count[name] = open_count.get(name, 0) + 1
    unclosed += len(stack)
    out += [f"</{x}>" for x in reversed(stack)]
    return "".join(out) or "<html/>", unclosed, stray


@F.pandas_udf(StructType([StructField("xml", StringType()), StructField("unclosed", IntegerType()), StructField("stray", IntegerType())]))
def _converted(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([convert(x) for x in html], columns=["xml", "unclosed", "stray"])


def to_xml(html: Column) -> Column:
    """struct(xml, unclosed, stray); use ``xpath`` functions on its ``xml``, never on raw HTML."""
    return _converted(html)
