"""Token tables, array splitting and framing: one row per lexeme, piece or value.

Places are worked out inside each row before it is exploded, so nothing is shuffled and rows that repeat a key, or have
none, stay apart.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexical import LEXEME, kind
from ..functions.rewrite import split_array

_LEXEME = re.compile(LEXEME)
_TOKEN = "array<struct<value:string,start:int,line:int,col:int,depth:int>>"
#: Texts that are unpacked at once.
_ROWS = 512


def _per_text(make: Callable[[str], list], kind_of: str, arrow: pa.DataType) -> Callable[[Column], Column]:
    """A function of a text column: the list that ``make`` gives for each text, null for null."""

    @F.arrow_udf(kind_of)
    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, max(1, len(texts)), _ROWS):
            parts.append(pa.array([None if t is None else make(t) for t in texts.slice(at, _ROWS).to_pylist()], pa.list_(arrow)))
        return pa.concat_arrays(parts)

    return run


def _fields(**kinds: pa.DataType) -> pa.DataType:
    return pa.struct(list(kinds.items()))


def _tokens(text: str) -> list[dict]:
    out, depth, line, since, seen = [], 0, 1, 0, 0
    for m in _LEXEME.finditer(text):
        x, start = m[0], m.start()
        breaks = text.count("\n", seen, start)
        if breaks:
            line, since = line + breaks, text.rfind("\n", seen, start) + 1
        seen = start
        depth -= x in "}]"
        out.append({"value": x, "start": start, "line": line, "col": start - since + 1, "depth": depth})
        depth += x in "{["
    return out


def token_rows(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, pos, type, value, start, end, line, col, depth of every lexeme (null and blank texts have none).

    ``start`` and ``end`` count characters from 0, end exclusive; line and col, from 1, are the start's; ``depth`` is the
    number of containers around it.
    """
    int32 = pa.int32()
    tokens = _per_text(_tokens, _TOKEN, _fields(value=pa.string(), start=int32, line=int32, col=int32, depth=int32))
    out = df.select(F.col(key).alias("key"), F.posexplode(tokens(F.col(column))).alias("pos", "t"))
    return out.select(
        F.col("key").alias(key), "pos", kind(F.col("t.value")).alias("type"), "t.value", "t.start",
        (F.col("t.start") + F.length("t.value")).alias("end"), "t.line", "t.col", "t.depth",
    )


def array_chunks(df: DataFrame, key: str, column: str, size: int = 200) -> DataFrame:
    """key, chunk, json: root arrays in pieces of at most ``size`` elements."""
    return df.select(key, F.posexplode(split_array(F.col(column), size)).alias("chunk", "json"))


def array_rows(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """key, pos, json: the elements of the array that the root object has under ``name``; others give no row."""
    path = "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"
    items = F.try_variant_get(F.try_parse_json(F.col(column)), path, "array<variant>")
    return df.select(key, F.posexplode(items).alias("pos", "v")).select(key, "pos", F.to_json("v").alias("json"))


def _values(text: str) -> list[str]:
    out, held, depth = [], [], 0
    for m in _LEXEME.finditer(text):
        x = m[0]
        held.append(x)
        depth += (x in "{[") - (x in "}]")
        # A value ends where a closing bracket returns to depth 0, or at a scalar at depth 0.
        if depth == 0 and x not in ":,":
            out.append("".join(held))
            held = []
    return out


def framed(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, part, json: the complete top-level values of concatenated JSON (any white space between), in order."""
    return df.select(key, F.posexplode(_per_text(_values, "array<string>", pa.string())(F.col(column))).alias("part", "json"))


def _repeated(text: str) -> list[dict]:
    out, stack, held, line, seen = [], [], None, 1, 0
    for pos, m in enumerate(_LEXEME.finditer(text)):
        x = m[0]
        line, seen = line + text.count("\n", seen, m.start()), m.start()
        if x in "{[":
            stack.append((pos, Counter(), {}))
        elif x in "}]" and stack:
            at, names, lines = stack.pop()
            out += [{"object": at, "name": k, "n": n, "line": lines[k]} for k, n in names.items() if n > 1]
        elif x == ":" and stack and held:
            stack[-1][1][held[0]] += 1
            stack[-1][2][held[0]] = held[1]
        held = (x, line) if x[0] == '"' else None
    for at, names, lines in stack:
        out += [{"object": at, "name": k, "n": n, "line": lines[k]} for k, n in names.items() if n > 1]
    return out


def duplicate_keys(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, object (position of its opening lexeme), name, n, line (of the last): keys that one object spells more than once, at any depth."""
    fields = _fields(object=pa.int32(), name=pa.string(), n=pa.int64(), line=pa.int32())
    found = _per_text(_repeated, "array<struct<object:int,name:string,n:bigint,line:int>>", fields)
    return df.select(key, F.explode(found(F.col(column))).alias("d")).select(key, "d.*")
