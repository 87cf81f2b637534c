"""An ordered list of transforms that becomes one projection.

Transforms run by ascending priority, equal priorities in the order they were added; disabled ones are skipped.  With none
enabled the document is minified.  Catalyst fuses neighbouring projections.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexical import comment_free, minify
from ..functions.rewrite import filter_fields, map_lexemes, pretty
from ..functions.schema import schema_errors


@dataclass(frozen=True)
class Transform:
    name: str
    apply: Callable[[DataFrame, str], DataFrame]
    enabled: bool = True
    priority: int = 0


def _column(name: str, make: Callable[[Column], Column], **options) -> Transform:
    return Transform(name, lambda df, c: df.withColumn(c, make(F.col(c))), **options)


def minified(mode: str = "sport", remove_comments: bool = False, **options) -> Transform:
    return _column("minify", lambda c: minify(comment_free(c) if remove_comments else c, mode), **options)


def filtered(include: list[str] | None = None, exclude: list[str] | None = None, case_sensitive: bool = True, **options) -> Transform:
    return _column("filter", lambda c: filter_fields(c, include, exclude, case_sensitive), **options)


def formatted(**options) -> Transform:
    own = {k: options.pop(k) for k in ("enabled", "priority") if k in options}
    return _column("format", lambda c: pretty(c, **options), **own)


def custom(change: Callable[[str], str | None], name: str = "custom", **options) -> Transform:
    """``change`` maps each lexeme; returning None ends the document there."""
    return _column(name, lambda c: map_lexemes(c, change), **options)


def validated(schema: dict, mode: str = "strict", max_errors: int = 100, **options) -> Transform:
    """strict: documents with errors become null; lenient and warning_only: they stay.  All get ``schema_errors``."""
    if mode not in ("strict", "lenient", "warning_only"):
        raise ValueError("mode must be strict, lenient or warning_only")

    def apply(df: DataFrame, c: str) -> DataFrame:
        out = df.withColumn("schema_errors", schema_errors(F.col(c), schema, max_errors=max_errors))
        return out.withColumn(c, F.when(F.size("schema_errors") == 0, F.col(c))) if mode == "strict" else out

    return Transform("validate_schema", apply, **options)


def convert(target: str = "json", **options) -> Transform:
    if target != "json":
        raise NotImplementedError(f"{target} is not supported")
    return _column("convert", minify, **options)


#: Registered transforms by name.
plugins: dict[str, Callable[..., Transform]] = {"minify": minified, "filter": filtered, "format": formatted, "custom": custom, "validate_schema": validated, "convert": convert}


def plugin(name: str) -> Callable:
    """Register a factory of transforms under ``name``."""

    def add(factory: Callable[..., Transform]) -> Callable[..., Transform]:
        if name in plugins:
            raise ValueError(f"{name} is registered already")
        plugins[name] = factory
        return factory

    return add


@dataclass
class Engine:
    transforms: list[Transform] = field(default_factory=list)

    def add(self, transform: Transform) -> Engine:
        self.transforms.append(transform)
        return self

    def remove(self, index: int) -> Engine:
        del self.transforms[index]
        return self

    def clear(self) -> Engine:
        self.transforms.clear()
        return self

    def run(self, df: DataFrame, column: str) -> DataFrame:
        active = sorted((t for t in self.transforms if t.enabled), key=lambda t: t.priority) or [minified()]
        return reduce(lambda frame, t: t.apply(frame, column), active, df)
