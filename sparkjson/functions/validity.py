"""Strict validity (RFC 8259) as a fold over lexemes, with the first error's name, offset, line and column.

The fold carries the open containers as a string and one letter for what may come next: v value, V value or ``]``,
k key or ``}``, K key, c colon, n comma or close, d end.  Null in, null out.  Empty and blank texts are invalid.

``is_valid`` needs no error, so it replaces the innermost containers by a number until the text is one scalar: a few
regular expressions for each level of nesting, and the fold only for texts of more than ``PASSES`` levels.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexical import BLANK, GOOD_SCALAR, STRING, kinds, let, lexemes

_GOOD = ("string", "number", "boolean", "null")
_STRUCTURE = ("{", "}", "[", "]", ":", ",")
#: Levels of nesting that ``is_valid`` takes away one by one.
PASSES = 32
#: A well-formed string, or the quote of any other.
_QUOTED = r'(")[^"\\\x00-\x1F]*+(?:\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4})[^"\\\x00-\x1F]*+)*+"|(")'
#: A scalar of a text whose strings are single quotes, with the blanks around it, and containers of such scalars.
_VALUE = rf'{BLANK}*+(?:"|-?+(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+|true|false|null){BLANK}*+'
_MEMBER = rf'{BLANK}*+"{BLANK}*+:{_VALUE}'
_INNERMOST = rf"\[(?:{_VALUE}(?:,{_VALUE})*+|{BLANK}*+)\]|\{{(?:{_MEMBER}(?:,{_MEMBER})*+|{BLANK}*+)\}}"


def _fold(ks: Column, max_depth: int) -> Column:
    """struct(stack, next, error, at): ``at`` counts lexemes up to the one in error."""
    text = lambda x: F.lit(x).cast("string")

    def step(s: Column, k: Column) -> Column:
        stack, nx = s["stack"], s["next"]
        top = F.right(stack, F.lit(1))
        popped = F.left(stack, F.length(stack) - 1)
        to = lambda st, n: F.struct(st.alias("stack"), n.alias("next"), text(None).alias("error"), (s["at"] + 1).alias("at"))
        bad = lambda e: F.struct(stack.alias("stack"), nx.alias("next"), e.alias("error"), (s["at"] + 1).alias("at"))
        ended = lambda st: F.when(F.length(st) == 0, "d").otherwise("n")
        deep = F.length(stack) >= max_depth
        closing = F.when(F.length(stack) == 0, "UnexpectedClosing").otherwise("MismatchedBrackets")
        value = (
            F.when(k.isin("{", "["), F.when(deep, bad(F.lit("DepthLimitExceeded"))).otherwise(to(F.concat(stack, k), F.when(k == "{", "k").otherwise("V"))))
            .when(k.isin(*_GOOD), to(stack, ended(stack)))
            .when((k == "]") & (nx == "V"), to(popped, ended(popped)))
            .when((k == "]") & (top == "["), bad(F.lit("TrailingComma")))
            .when(k.isin("}", "]"), bad(closing))
            .otherwise(bad(F.lit("InvalidCharacter")))
        )
        key = F.when(k == "string", to(stack, F.lit("c"))).when(k == "}", F.when(nx == "k", to(popped, ended(popped))).otherwise(bad(F.lit("TrailingComma")))).otherwise(bad(F.lit("ExpectedString")))
        more = (
            F.when(k == ",", to(stack, F.when(top == "{", "K").otherwise("v")))
            .when((k == "}") & (top == "{") | (k == "]") & (top == "["), to(popped, ended(popped)))
            .when(k.isin("}", "]"), bad(F.lit("MismatchedBrackets")))
            .otherwise(bad(F.when(top == "{", "ExpectedCommaOrCloseBrace").otherwise("ExpectedCommaOrCloseBracket")))
        )
        return (
            F.when(s["error"].isNotNull(), s)
            .when(~k.isin(*_GOOD, *_STRUCTURE), bad(k))
            .when(nx.isin("v", "V"), value)
            .when(nx.isin("k", "K"), key)
            .when(nx == "c", F.when(k == ":", to(stack, F.lit("v"))).otherwise(bad(F.lit("ExpectedColon"))))
            .when(nx == "n", more)
            .otherwise(bad(F.lit("TrailingData")))
        )

    start = F.struct(F.lit("").alias("stack"), F.lit("v").alias("next"), text(None).alias("error"), F.lit(0).alias("at"))
    return F.aggregate(ks, start, step)


def _end_error(s: Column) -> Column:
    return (
        F.when(s["error"].isNotNull(), s["error"])
        .when(s["next"] == "d", F.lit(None))
        .when(F.endswith(s["stack"], F.lit("{")), "UnterminatedObject")
        .when(F.endswith(s["stack"], F.lit("[")), "UnterminatedArray")
        .otherwise("UnexpectedEndOfInput")
    )


def is_valid(c: Column, max_depth: int = 1000) -> Column:
    # A well-formed string becomes one quote and a broken one begins with two, which no container of ``_INNERMOST`` can hold.
    bare = F.regexp_replace(c, _QUOTED, "$1$2$2")
    levels = F.least(F.lit(min(max_depth, PASSES)), F.length(c) - F.length(F.translate(c, "{[", "")))
    opened = lambda s: s.rlike(r"[{\[]")

    def without_innermost(s: Column, _: Column) -> Column:
        """Null where something is open and nothing can be taken away any more."""
        return F.when(~opened(s), s).when(s.rlike(_INNERMOST), F.regexp_replace(s, _INNERMOST, " 0 "))

    def ended(s: Column) -> Column:
        deeper = F.lit(False) if max_depth <= PASSES else let(_fold(kinds(c), max_depth), _end_error).isNull()
        return F.when(s.isNull(), False).when(opened(s), deeper).otherwise(s.rlike(rf"^{_VALUE}\z"))

    # Places from the second on: no step for a text without containers.
    steps = F.slice(F.sequence(F.lit(0), levels), F.lit(2), F.lit(PASSES))
    return F.when(c.isNotNull(), F.aggregate(steps, bare, without_innermost, ended))


def validate(c: Column, max_depth: int = 1000) -> Column:
    """struct(valid, error, offset, line, column): offset from 0, line and column from 1, in characters."""

    def of(s: Column) -> Column:
        error = _end_error(s)
        before = F.array_join(F.slice(lexemes(c, spaced=True), F.lit(1), F.greatest(s["at"] - 1, F.lit(0))), "")
        here = F.get(lexemes(c, spaced=True), s["at"] - 1)
        lead = F.length(here) - F.length(F.regexp_replace(here, rf"^{BLANK}+", ""))
        offset = F.when(s["error"].isNull(), F.length(c)).otherwise(F.length(before) + lead)
        offset = F.when(error.isNotNull(), offset)

        def placed(o: Column) -> Column:
            head = F.left(c, o)
            return F.struct(
                error.isNull().alias("valid"), error.alias("error"), o.alias("offset"),
                F.when(o.isNotNull(), F.regexp_count(head, F.lit("\n")) + 1).alias("line"),
                (F.length(F.regexp_replace(head, r"(?s)^.*\n", "")) + 1).alias("column"),
            )

        return let(offset, placed)

    return F.when(c.isNotNull(), let(_fold(kinds(c), max_depth), of))


def balanced(c: Column) -> Column:
    """Whether brackets outside strings are as many open as closed, of either kind, and no string lacks its end."""
    bare = F.regexp_replace(c, rf"(?s){STRING}", "")
    count = lambda x: F.regexp_count(bare, F.lit(x))
    return (count(r"\{") == count(r"\}")) & (count(r"\[") == count(r"\]")) & ~F.contains(bare, F.lit('"')) & ~bare.rlike(rf"^{BLANK}*$")


def has_duplicate_keys(c: Column) -> Column:
    """Whether the root object names a key twice."""
    keys = F.json_object_keys(c)
    return F.coalesce(F.size(keys) != F.size(F.array_distinct(keys)), F.lit(False))


def repair_escapes(c: Column) -> Column:
    """Inside strings: a broken ``\\u`` escape becomes ``\\uFFFD``, any other unknown escape ``?``.  All else stays."""

    def mended(x: Column) -> Column:
        unicode = F.regexp_replace(x, r"(?s)\G((?:[^\\]|\\[^u]|\\u[0-9A-Fa-f]{4})*+)\\u[0-9A-Fa-f]{0,3}", r"$1\\uFFFD")
        return F.regexp_replace(unicode, r'(?s)\G((?:[^\\]|\\["\\/bfnrtu])*+)\\[^"\\/bfnrtu]', "$1?")

    pieces = F.regexp_extract_all(c, F.lit(rf'(?s){STRING}|[^"]++|"'), F.lit(0))
    whole = F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(r'^(?s)".*\\'), mended(x)).otherwise(x)), "")
    return F.when(F.contains(c, F.lit("\\")), whole).otherwise(c)


def is_utf8(binary: Column) -> Column:
    """Whether bytes are well-formed UTF-8."""
    return F.is_valid_utf8(binary.cast("string"))


def complete_prefix(c: Column) -> Column:
    """The longest beginning of a text that ends outside strings with all containers closed; empty if there is none.

    Nothing counts from a string without an end or a bracket that closes nothing on.
    """
    pieces = F.regexp_extract_all(c, F.lit(rf'(?s){STRING}|[{{}}\[\]]|{BLANK}++|[^"{{}}\[\] \t\n\r]++|".*'), F.lit(0))

    def step(s: Column, x: Column) -> Column:
        depth = F.when((s["depth"] < 0) | x.rlike(rf'(?s)^(?!{STRING}\z)"'), -1).otherwise(s["depth"] + F.when(x.isin("{", "["), 1).when(x.isin("}", "]"), -1).otherwise(0))
        at = s["at"] + F.length(x)
        return F.struct(depth.alias("depth"), at.alias("at"), F.when((depth == 0) & ~x.rlike(rf"^{BLANK}"), at).otherwise(s["best"]).alias("best"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("best"))
    return F.when(c.isNotNull(), F.left(c, F.aggregate(pieces, start, step, lambda s: s["best"])))


def skip_invalid(c: Column) -> Column:
    """Without the lexemes that no document may hold, and without unknown escapes (two characters each) inside strings.

    Broken ``\\u`` escapes lose their first two characters and keep the rest; control characters in strings go.  Structure
    is not mended, so the outcome may still be invalid.
    """

    def mended(x: Column) -> Column:
        known = F.regexp_replace(x, r'(?s)\G((?:[^\\]|\\["\\/bfnrt]|\\u[0-9A-Fa-f]{4})*+)\\(?:[^"\\/bfnrt])', "$1")
        return F.regexp_replace(known, r"[\x00-\x1F]", "")

    def kept(x: Column) -> Column:
        bare = F.regexp_replace(x, rf"^{BLANK}+", "")
        lead = F.left(x, F.length(x) - F.length(bare))
        quoted = F.startswith(bare, F.lit('"')) & (F.length(bare) > 1)
        good = bare.rlike(r"^[{}\[\]:,]$") | bare.rlike(GOOD_SCALAR)
        return F.concat(lead, F.when(quoted, mended(bare)).when(good, bare).otherwise(""))

    return F.array_join(F.transform(lexemes(c, spaced=True), kept), "")
