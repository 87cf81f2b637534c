"""Lexical work on JSON texts with Spark's regular expressions: nothing is parsed, so every spelling survives.

Null in, null out, unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A string literal, possessive so that long strings need no stack.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
BLANK = r"[ \t\n\r]"
#: String (any content), structural character, run of anything else, or the quote of a string without an end.
LEXEME = rf'(?s){STRING}|[{{}}\[\]:,]|[^ \t\n\r"{{}}\[\]:,]++|"'
GOOD_STRING = r'^"(?:[^"\\\x00-\x1F]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*+"\z'
GOOD_SCALAR = r"^(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)\z"
MODES = ("eco", "sport", "turbo")


def let(value: Column, body) -> Column:
    """Bind ``value`` once, so that a lambda may use it many times without evaluating it again.

    As the end of a fold over nothing: an element of an array would have its type worked out anew, through all of
    ``body``, each time it is taken.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, body)


def minify(c: Column, mode: str = "sport", strict: bool | None = None, max_depth: int | None = None, max_bytes: int | None = None) -> Column:
    """Remove white space outside strings, byte for byte.

    ``eco`` is strict by default (invalid text: null; 31 containers deep at most); ``sport`` and ``turbo`` never validate
    unless ``strict``.  Empty and blank texts give the empty text in every mode.  Texts of more than ``max_bytes`` give null.
    """
    from .validity import is_valid

    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    strict = mode == "eco" if strict is None else strict
    c = c if max_bytes is None else F.when(F.octet_length(c) <= max_bytes, c)
    out = F.regexp_replace(c, rf"(?s)({STRING})|{BLANK}+", "$1")
    if not strict:
        return out
    depth = max_depth or (31 if mode == "eco" else 1000)
    return F.when(is_blank(c) | is_valid(c, depth), out)


def comment_free(c: Column) -> Column:
    """Without ``//`` and ``/* */`` comments that stand outside strings."""
    return F.regexp_replace(c, rf"(?s)({STRING})|//[^\n]*|/\*.*?\*/", "$1")


def skip_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANK}+", "")


def is_blank(c: Column) -> Column:
    return c.rlike(rf"^{BLANK}*+\z")


def is_minified(c: Column) -> Column:
    return c == minify(c)


def lexemes(c: Column, spaced: bool = False) -> Column:
    """array<string>: the lexemes in order; ``spaced`` keeps the white space before each."""
    return F.regexp_extract_all(c, F.lit(rf"(?s){BLANK}*+(?:{LEXEME[4:]})" if spaced else LEXEME), F.lit(0))


def kind(x: Column) -> Column:
    """One lexeme's kind: the structural character itself, ``string``, ``number``, ``boolean``, ``null`` or an error's name."""
    first = F.substring(x, 1, 1)
    return (
        F.when(first.isin("{", "}", "[", "]", ":", ","), first)
        .when(
            first == '"',
            F.when(x.rlike(GOOD_STRING), "string")
            .when(x == '"', "UnterminatedString")
            .when(x.rlike(r"[\x00-\x1F]"), "UnescapedControlCharacter")
            .when(x.rlike(r'(?s)(?<!\\)(?:\\\\)*\\u(?![0-9A-Fa-f]{4})'), "InvalidUnicodeEscape")
            .otherwise("InvalidEscapeSequence"),
        )
        .when(x.rlike(GOOD_SCALAR), F.when(first.isin("t", "f"), "boolean").when(first == "n", "null").otherwise("number"))
        .when(first.rlike("[-0-9+.]"), "InvalidNumber")
        .when(first.rlike("[a-zA-Z]"), "InvalidLiteral")
        .otherwise("InvalidCharacter")
    )


def kinds(c: Column) -> Column:
    return F.transform(lexemes(c), kind)


def structure_counts(c: Column) -> Column:
    """struct of objects, arrays, strings, numbers, booleans, nulls (tokens, keys included) and bytes."""
    all_kinds = kinds(c)

    def of(ks: Column) -> Column:
        count = lambda k: F.size(F.filter(ks, lambda x: x == k)).cast("long")
        names = (("objects", "{"), ("arrays", "["), ("strings", "string"), ("numbers", "number"), ("booleans", "boolean"), ("nulls", "null"))
        return F.struct(*(count(k).alias(n) for n, k in names), F.octet_length(c).cast("long").alias("bytes"))

    return F.when(c.isNotNull(), F.transform(F.array(all_kinds), of)[0])


def length_profile(c: Column) -> Column:
    """struct(keys, avg_key_length, strings, avg_string_length): characters between the quotes, as spelled; averages of none are null."""
    spelled = F.regexp_extract_all(c, F.lit(rf"(?s){STRING}(?:{BLANK}*+:)?+"), F.lit(0))

    def of(xs: Column) -> Column:
        keys = F.filter(xs, lambda x: F.endswith(x, F.lit(":")))
        strings = F.filter(xs, lambda x: F.endswith(x, F.lit('"')))
        # A key's lexeme goes to its colon: the quote, blanks and the colon are left off.
        length = lambda x: F.length(F.regexp_replace(x, rf'"{BLANK}*:?\z', "")) - 1
        mean = lambda ys: F.when(F.size(ys) > 0, F.aggregate(ys, F.lit(0).cast("long"), lambda s, y: s + length(y)) / F.size(ys))
        return F.struct(
            F.size(keys).cast("long").alias("keys"), mean(keys).alias("avg_key_length"),
            F.size(strings).cast("long").alias("strings"), mean(strings).alias("avg_string_length"),
        )

    return F.when(c.isNotNull(), F.transform(F.array(spelled), of)[0])
