"""Small scalar functions: sizes, ratios, labels, positions.  Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexical import STRING

#: Result codes and their messages.
ERROR_MESSAGES = {0: "Success", -1: "Invalid JSON", -2: "Out of memory", -3: "Invalid mode", -99: "Unknown error"}
#: The two-character escapes of JSON.
ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
SEVERITIES = {0: "info", 1: "warning", 2: "error", 3: "fatal"}


def estimate_size(c: Column, method: str = "minified") -> Column:
    """Bytes to reserve: 70 % of the input, at least 1 (``minified``), or the input and 1,024 (``buffer``)."""
    n = F.octet_length(c)
    return F.greatest(F.floor(n * 0.7), F.lit(1)).cast("long") if method == "minified" else (n + 1024).cast("long")


def memory_estimate(size: Column, mode: str) -> Column:
    """Bytes that a mode keeps for ``size`` bytes of input."""
    kept = {"eco": F.lit(64 * 1024), "sport": F.least(F.floor(F.sqrt(size)), F.lit(16 * 1024 * 1024)), "turbo": size}
    return F.when(size.isNotNull(), kept[mode].cast("long"))


def compression_ratio(before: Column, after: Column) -> Column:
    return F.when(before > 0, after / before)


def reduction_percent(before: Column, after: Column) -> Column:
    return F.when(before > 0, (before - after) / before * 100)


def json_depth(c: Column) -> Column:
    """Deepest nesting of brackets outside strings."""
    brackets = F.regexp_replace(c, rf"(?s){STRING}|[^\[\]{{}}\"]", "")
    deeper = lambda s, x: F.when(
        x.isin("{", "["), F.struct((s["d"] + 1).alias("d"), F.greatest(s["most"], s["d"] + 1).alias("most"))
    ).otherwise(F.struct((s["d"] - F.when(x.isin("}", "]"), 1).otherwise(0)).alias("d"), s["most"].alias("most")))
    return F.when(c.isNotNull(), F.aggregate(F.split(brackets, ""), F.struct(F.lit(0).alias("d"), F.lit(0).alias("most")), deeper, lambda s: s["most"]))


def characteristics(c: Column) -> Column:
    """struct(size, whitespace_ratio, structural_density, max_nesting, complexity); strings' contents count."""
    n = F.octet_length(c)
    share = lambda k: F.when(n > 0, k / n).otherwise(0.0)
    ws = share(F.regexp_count(c, F.lit(r"[ \t\n\r]")))
    depth = json_depth(c)
    return F.when(
        c.isNotNull(),
        F.struct(
            n.alias("size"), ws.alias("whitespace_ratio"), share(F.regexp_count(c, F.lit(r"[{}\[\]:,]"))).alias("structural_density"),
            depth.alias("max_nesting"), (F.ln(F.greatest(n, F.lit(1))) + depth * 0.1 + ws * 5).alias("complexity"),
        ),
    )


def classify_char(ch: Column) -> Column:
    """whitespace, quote, escape or regular."""
    return F.when(ch.isin(" ", "\t", "\n", "\r"), "whitespace").when(ch == '"', "quote").when(ch == "\\", "escape").otherwise(F.when(ch.isNotNull(), "regular"))


def escape_value(ch: Column) -> Column:
    """What the letter of a two-character escape stands for; null for any other."""
    out = None
    for letter, value in ESCAPES.items():
        out = (F if out is None else out).when(ch == letter, F.lit(value))
    return out


def json_string_value(lexeme: Column) -> Column:
    """The text of a JSON string literal."""
    return F.try_variant_get(F.try_parse_json(lexeme), "$", "string")


def quote_json(c: Column) -> Column:
    """A JSON string literal for a text."""
    packed = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNotNull(), F.substr(packed, F.lit(6), F.length(packed) - 6))


def type_name(v: Column) -> Column:
    """null, boolean, number, string, array or object of a VARIANT."""
    s = F.schema_of_variant(v)
    return (
        F.when(s == "VOID", "null").when(s == "BOOLEAN", "boolean").when(s == "STRING", "string")
        .when(F.startswith(s, F.lit("ARRAY")), "array").when(F.startswith(s, F.lit("OBJECT")), "object")
        .otherwise(F.when(s.isNotNull(), "number"))
    )


def line_column(c: Column, offset: Column) -> Column:
    """struct(line, column), from 1, of a 0-based character offset."""
    head = F.left(c, offset)
    return F.struct((F.regexp_count(head, F.lit("\n")) + 1).alias("line"), (F.length(F.regexp_replace(head, r"(?s)^.*\n", "")) + 1).alias("column"))


def context_snippet(c: Column, offset: Column, around: int = 20) -> Column:
    start = F.greatest(offset - around, F.lit(0))
    return F.substr(c, start + 1, offset - start + around)


def semantic_equals(a: Column, b: Column) -> Column:
    """Equal up to white space, key order and spelling of numbers and escapes; invalid texts equal nothing."""
    canonical = lambda x: F.to_json(F.try_parse_json(x))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(canonical(a) == canonical(b), F.lit(False)))


def glob_to_regex(glob: str) -> str:
    """An anchored Java regular expression for ``*`` and ``?``."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, rf"\Q{c}\E") for c in glob) + "$"


def error_message(code: Column) -> Column:
    out = None
    for value, text in ERROR_MESSAGES.items():
        out = (F if out is None else out).when(code == value, text)
    return out.otherwise(F.when(code.isNotNull(), ERROR_MESSAGES[-99]))


def severity_label(level: Column) -> Column:
    out = None
    for value, text in SEVERITIES.items():
        out = (F if out is None else out).when(level == value, text)
    return out


def format_bytes(n: Column) -> Column:
    """1536 -> ``1.5 KB``."""
    out = F.format_string("%d B", n.cast("long"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", n / float(1024**power))).otherwise(out)
    return out


def format_duration(ms: Column) -> Column:
    return F.when(ms < 1, F.format_string("%.0f us", ms * 1000.0)).when(ms < 1000, F.format_string("%.1f ms", ms * 1.0)).otherwise(F.format_string("%.2f s", ms / 1000.0))


