"""The configuration language, read on the driver.

``class["name"] { option = value; }`` makes an object; ``extend:`` changes one,
``override:`` replaces one, ``["new" copy "old"]`` starts from another. ``include "file";``
loads a file of a name once, ``load_module "name";`` a Python module. Values are strings, numbers, true, false and lists.
"""

from __future__ import annotations

import importlib
import os
import re
from collections.abc import Callable
from dataclasses import fields, replace

from webloom.operators.filetypes import Config, Crawler, FileType

_TOKEN = re.compile(r"\s+|#[^\n]*|/\*.*?\*/|(\"[^\"]*\")|([A-Za-z_]\w*)|(\d+)|([\[\]{}=;:,])", re.S)
_KINDS = {"filetype": (FileType, "filetypes"), "crawler": (Crawler, "crawlers")}
_SCOPES = ("master", "slave", "client")


class ConfigError(ValueError):
    """A fault in a configuration, with its line."""


def _tokens(text: str) -> list[tuple[str, int]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ConfigError(f"line {text.count(chr(10), 0, at) + 1}: unexpected {text[at]!r}")
        if m.lastindex:
            out.append((m[0], text.count("\n", 0, at) + 1))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str, config: Config, include: Callable[[str], str | None]):
        self.tokens, self.at, self.config, self.include = _tokens(text), 0, config, include

    def peek(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def fail(self, what: str):
        line = self.tokens[min(self.at, len(self.tokens) - 1)][1] if self.tokens else 1
        raise ConfigError(f"line {line}: {what}")

    def take(self, want: str | None = None) -> str:
        x = self.peek()
        if not x or want is not None and x != want:
            self.fail(f"expected {want or 'more'}, found {x or 'the end'}")
        self.at += 1
        return x

    def string(self) -> str:
        x = self.take()
        if x[0] != '"':
            self.at -= 1
            self.fail(f"expected a string, found {x}")
        return x[1:-1]

    def value(self):
        x = self.peek()
        if x == "{":
            self.take()
            out = []
            while self.peek() != "}":
                out.append(self.string())
                if self.peek() == ",":
                    self.take()
            self.take("}")
            return tuple(out)
        if x[:1] == '"':
            return self.string()
        self.take()
        if x in ("true", "false"):
            return x == "true"
        if x.isdigit():
            return int(x)
        self.at -= 1
        return self.fail(f"{x} is no value")

    def body(self) -> dict:
        out = {}
        self.take("{")
        while self.peek() != "}":
            name = self.take()
            self.take("=")
            out[name] = self.value()
            self.take(";")
        self.take("}")
        return out

    def run(self) -> None:
        while self.peek():
            word = self.take()
            if word in ("include", "load_module"):
                name = self.string()
                if self.peek() == ";":
                    self.take()
                if word == "load_module":
                    self.module(name)
                    continue
                text = self.include(name)
                if text is not None:
                    _Parser(text, self.config, self.include).run()
                continue
            if word in _SCOPES:
                self.config.scopes.setdefault(word, {}).update(self.body())
                continue
            mode = ""
            if word in ("extend", "override"):
                mode = word
                self.take(":")
                word = self.take()
            if word not in _KINDS:
                self.at -= 1
                self.fail(f"{word} is no class")
            self.object(mode, word)

    def module(self, name: str) -> None:
        """Import a Python module; it registers parsers, handlers and init functions of its own."""
        try:
            importlib.import_module(name)
        except ImportError as e:
            self.at -= 1
            self.fail(f"module {name} can't be loaded: {e}")

    def object(self, mode: str, word: str) -> None:
        kind, place = _KINDS[word]
        known = getattr(self.config, place)
        self.take("[")
        name, source = self.string(), None
        if self.peek() == "copy":
            self.take()
            source = self.string()
            if source not in known:
                self.fail(f"there is no {word} {source}")
        self.take("]")
        if mode and name not in known:
            self.fail(f"there is no {word} {name} to {mode}")
        if not mode and name in known:
            self.fail(f"{word} {name} is there already")
        start = replace(known[source], name=name) if source else known[name] if mode == "extend" else kind(name)
        options = {}
        if self.peek() == ";":
            self.take()
        else:
            options = self.body()
            if self.peek() == ";":
                self.take()
        types = {f.name: f.type for f in fields(kind)}
        for option, value in options.items():
            if option not in types or option == "name":
                self.fail(f"{word} has no option {option}")
            many = types[option].startswith("tuple")
            if many and isinstance(value, str):
                options[option] = (value,)
            elif types[option] == "str" and isinstance(value, tuple):
                options[option] = ", ".join(value)
            elif not many and types[option] != type(options[option]).__name__:
                self.fail(f"{option} must be {types[option]}")
        known[name] = replace(start, **options)


def loads(text: str, config: Config | None = None, folders: tuple[str, ...] = ()) -> Config:
    """Read a configuration; ``include`` looks into the folders in order, once for each name."""
    config, seen = config if config is not None else Config(), set()

    def include(name: str) -> str | None:
        base = os.path.basename(name)
        if base in seen:
            return None
        seen.add(base)
        for folder in folders:
            at = os.path.join(folder, base)
            if os.path.exists(at):
                with open(at) as f:
                    return f.read()
        raise ConfigError(f"{name} isn't found")

    _Parser(text, config, include).run()
    return config


def load(path: str, folders: tuple[str, ...] = ()) -> Config:
    with open(path) as f:
        return loads(f.read(), folders=(os.path.dirname(path), *folders))
