"""Findings beyond validity: duplicate keys at any depth, large parts, lenient profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.lexical import STRING, comment_free, is_blank, lexemes, structure_counts
from ..functions.scalars import context_snippet
from ..functions.validity import has_duplicate_keys, is_valid, validate
from .tokens import duplicate_keys

__all__ = ["container_root", "duplicate_keys", "findings", "lenient_valid"]

#: From how many parts on a document is called large.
LARGE = {"strings": 10_000, "objects": 1_000, "arrays": 1_000}


def findings(c: Column, max_depth: int = 1000, long_number: int = 100) -> Column:
    """array<struct(severity, code, detail, context)>: 2 the first error, 1 warnings; empty if there is nothing to say.

    ``context``: what stands around the error.  A key that the root object repeats is a warning; ``duplicate_keys`` finds all.
    """
    v, s = validate(c, max_depth), structure_counts(c)
    finding = lambda when, severity, code, detail, context=None: F.when(
        when, F.struct(F.lit(severity).alias("severity"), code.alias("code"), detail.cast("string").alias("detail"), (F.lit(None).cast("string") if context is None else context).alias("context"))
    )
    numbers = F.filter(lexemes(c), lambda x: ~F.startswith(x, F.lit('"')) & (F.length(x) > long_number))

    def of(x: Column) -> Column:
        rows = [finding(~x["v"]["valid"], 2, x["v"]["error"], x["v"]["offset"], context_snippet(c, x["v"]["offset"]))]
        rows += [finding(x["s"][name] > most, 1, F.lit(f"Many {name}"), x["s"][name]) for name, most in LARGE.items()]
        rows.append(finding(F.size(numbers) > 0, 1, F.lit("Long number"), F.size(numbers)))
        rows.append(finding(is_blank(c), 1, F.lit("Empty document"), F.octet_length(c)))
        rows.append(finding(has_duplicate_keys(c), 1, F.lit("Duplicate key"), F.lit("/")))
        return F.filter(F.array(*rows), lambda r: r.isNotNull())

    return F.when(c.isNotNull(), F.transform(F.array(F.struct(v.alias("v"), s.alias("s"))), of)[0])


def lenient_valid(c: Column, allow_comments: bool = False, allow_trailing_commas: bool = False, max_depth: int = 100, max_string_length: int = 10_000) -> Column:
    """Validity with comments or trailing commas allowed, and strings of at most ``max_string_length`` characters."""
    text = comment_free(c) if allow_comments else c
    if allow_trailing_commas:
        text = F.regexp_replace(text, rf"(?s)({STRING})|(?<![\[{{,:])([ \t\n\r]*),(?=[ \t\n\r]*[\]}}])", "$1$2")
    short = F.forall(lexemes(text), lambda x: ~F.startswith(x, F.lit('"')) | (F.length(x) - 2 <= max_string_length))
    return is_valid(text, max_depth) & short


def container_root(c: Column) -> Column:
    """Whether the document's root is an object or an array."""
    return F.coalesce(F.substring(F.get(lexemes(c), F.lit(0)), 1, 1).isin("{", "["), F.lit(False))
