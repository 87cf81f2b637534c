"""Rewrites that follow a document's nesting: field filter, pretty print, key sort, custom token transforms.

Number spellings, duplicate keys and escapes survive, which no Spark type allows, so these few walk the lexemes in
Arrow-batched functions; each row is a document, and rows are independent.  Each is one pass with a stack, so depth costs
nothing.  Invalid documents and nulls give null.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexical import is_blank
from .validity import is_valid

_LEXEME = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[{}\[\]:,]|[^ \t\n\r"{}\[\]:,]+', re.S)


def _on_valid(c: Column, rewrite: Callable[[list[str]], str]) -> Column:
    """Apply ``rewrite`` to the lexemes of valid texts; blank texts become empty."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else rewrite(_LEXEME.findall(t)))

    return F.when(is_blank(c), F.lit("")).otherwise(run(F.when(is_valid(c), c)))


def _end(lexemes: list[str], at: int) -> int:
    """The place behind the value that begins at ``at``."""
    depth = 0
    while True:
        depth += (lexemes[at] in "{[") - (lexemes[at] in "}]")
        at += 1
        if not depth:
            return at


class _Rules:
    """Which dotted paths stay: exclusion wins; an included path keeps its subtree and its ancestors; ``*`` crosses dots."""

    def __init__(self, include: list[str] | None, exclude: list[str] | None, case_sensitive: bool):
        self.flags = 0 if case_sensitive else re.I
        self.include = None if include is None else [self.pattern(p) for p in include]
        self.exclude = [self.pattern(p) for p in exclude or []]
        # An ancestor is anything that some path below it could match.
        self.stems = [re.split(r"[*?]", p)[0] for p in include or []] if case_sensitive else [re.split(r"[*?]", p)[0].lower() for p in include or []]
        self.fold = (lambda s: s) if case_sensitive else str.lower
        self.wild = [bool(re.search(r"[*?]", p)) for p in include or []]

    def pattern(self, glob: str) -> re.Pattern:
        # ``a.*.b`` also matches ``a.b``, since array places are no segments; ``a.*`` also matches ``a``.
        body = re.escape(glob).replace(r"\.\*\.", r"\.(?:.*\.)?").replace(r"\*", ".*").replace(r"\?", ".")
        body = re.sub(r"\\\.\.\*$", r"(?:\\..*)?", body)
        return re.compile(body + r"(?:\..*)?", self.flags | re.S)

    def keeps(self, path: str) -> tuple[bool, bool]:
        """(stays, whole subtree is included)."""
        if any(p.fullmatch(path) for p in self.exclude):
            return False, False
        if self.include is None or any(p.fullmatch(path) for p in self.include):
            return True, True
        own = self.fold(path) + "."
        return any(s.startswith(own) or (w and own.startswith(s)) for s, w in zip(self.stems, self.wild, strict=True)), False


def filter_fields(c: Column, include: list[str] | None = None, exclude: list[str] | None = None, case_sensitive: bool = True) -> Column:
    """The minified document with only the wanted fields; arrays add no segment to a path; scalar roots stay."""
    rules = _Rules(include, exclude, case_sensitive)

    def run(lexemes: list[str]) -> str:
        out: list[str] = []
        stack: list[list] = []  # of open containers: is object, path, whole, members written, has a match, where a member of an object began
        at, path, whole, began = 0, "", False, None
        while at < len(lexemes):
            x, top = lexemes[at], stack[-1] if stack else None
            if x == ",":
                at += 1
            elif x in "}]":
                _, _, _, _, match, start = stack.pop()
                out.append(x)
                at += 1
                if stack and start is not None and not match:  # kept for what might be inside, but nothing was
                    del out[start:]
                    stack[-1][3] -= 1
                elif stack:
                    stack[-1][4] |= match
            elif top and top[0] and began is None:
                name = f"{top[1]}.{x[1:-1]}" if top[1] else x[1:-1]
                stays, deep = rules.keeps(name)
                leaf = lexemes[at + 2] not in "{["
                if not stays or leaf and not deep:
                    at = _end(lexemes, at + 2)
                    continue
                began, path, whole = len(out), name, deep
                out += [","] * (top[3] > 0) + [x, ":"]
                at += 2
            else:
                if top and not top[0]:
                    path, whole = top[1], top[2]
                    out += [","] * (top[3] > 0)
                if top:
                    top[3] += 1
                    top[4] |= whole
                out.append(x)
                if x in "{[":
                    stack.append([x == "{", path, whole, 0, whole, began])
                began = None
                at += 1
        return "".join(out)

    return _on_valid(c, run)


def pretty(c: Column, indent: int = 2, tabs: bool = False, sort_keys: bool = False, ascii_only: bool = False, trailing_comma: bool = False) -> Column:
    """Indented layout with ``": "``; empty containers stay closed, strings stay as they are, no final newline."""
    step = "\t" if tabs else " " * indent

    def run(lexemes: list[str]) -> str:
        out, members, at = [], [], 0
        while at < len(lexemes):
            x = lexemes[at]
            pad = "\n" + step * len(members)
            if x in "{[" and lexemes[at + 1] in "}]":
                out.append(x + lexemes[at + 1])
                at += 1
            elif x in "{[":
                members.append(1)
                out.append(f"{x}{pad}{step}")
            elif x in "}]":
                comma = "," if members.pop() > 1 and trailing_comma else ""
                out.append(comma + "\n" + step * len(members) + x)
            elif x == ",":
                members[-1] += 1
                out.append("," + pad)
            else:
                out.append(": " if x == ":" else x)
            at += 1
        return escaped("".join(out))

    def escaped(text: str) -> str:
        if not ascii_only or text.isascii():
            return text
        units = text.encode("utf-16-be")
        return "".join(chr(u) if u < 128 else f"\\u{u:04x}" for u in (int.from_bytes(units[k : k + 2], "big") for k in range(0, len(units), 2)))

    return _on_valid(c, lambda x: run(_sorted(x) if sort_keys else x))


def _sorted(lexemes: list[str]) -> list[str]:
    """The lexemes with every object's members in the order of their keys."""
    done: list[list[str]] = []  # of the last container that closed
    stack: list[tuple[str, list]] = []
    key: str | None = None
    for at, x in enumerate(lexemes):
        if x in "{[":
            stack.append((x, [], key))
            key = None
            continue
        if x in "}]":
            kind, members, key = stack.pop()
            if kind == "{":
                members.sort(key=lambda m: m[0])
            value = [kind]
            for k, (name, body) in enumerate(members):
                value += [","] * (k > 0) + ([name, ":"] if kind == "{" else []) + body
            value.append(x)
        elif x in ":,":
            continue
        elif stack and stack[-1][0] == "{" and key is None and lexemes[at + 1] == ":":
            key = x
            continue
        else:
            value = [x]
        if stack:
            stack[-1][1].append((key, value))
        done, key = value, None
    return done


def sort_keys(c: Column) -> Column:
    """Minified, with the members of every object in the order of their keys' spelling; equal keys keep their order."""
    return _on_valid(c, lambda x: "".join(_sorted(x)))


def map_lexemes(c: Column, change: Callable[[str], str | None]) -> Column:
    """Custom transform: ``change`` gets each lexeme and returns what is written, or None to write no more."""

    def run(lexemes: list[str]) -> str:
        out = []
        for x in lexemes:
            y = change(x)
            if y is None:
                break
            out.append(y)
        return "".join(out)

    return _on_valid(c, run)


def split_array(c: Column, size: int = 200) -> Column:
    """array<string>: a root array in pieces of at most ``size`` elements, each an array again; others stay whole."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str] | None:
            if text is None:
                return None
            x = _LEXEME.findall(text)
            if x[0] != "[" or len(x) == 2:
                return ["".join(x)]
            items, at = [], 1
            while x[at] != "]":
                end = _end(x, at)
                items.append("".join(x[at:end]))
                at = end + (x[end] == ",")
            return ["[" + ",".join(items[k : k + size]) + "]" for k in range(0, len(items), size)]

        return texts.map(one)

    return run(F.when(is_valid(c), c))
