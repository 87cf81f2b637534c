"""Column functions over one JSON text per row."""

from .lexical import (
    comment_free,
    is_blank,
    is_minified,
    kinds,
    length_profile,
    lexemes,
    minify,
    skip_whitespace,
    structure_counts,
)
from .scalars import (
    characteristics,
    classify_char,
    compression_ratio,
    context_snippet,
    error_message,
    escape_value,
    estimate_size,
    format_bytes,
    format_duration,
    glob_to_regex,
    json_depth,
    json_string_value,
    line_column,
    memory_estimate,
    quote_json,
    reduction_percent,
    semantic_equals,
    severity_label,
    type_name,
)
from .validity import balanced, complete_prefix, has_duplicate_keys, is_utf8, is_valid, repair_escapes, skip_invalid, validate

__all__ = [
    "balanced", "characteristics", "classify_char", "comment_free", "complete_prefix", "compression_ratio", "context_snippet", "error_message",
    "escape_value", "estimate_size", "format_bytes", "format_duration", "glob_to_regex", "has_duplicate_keys", "is_blank", "is_minified", "is_utf8",
    "is_valid", "json_depth", "json_string_value", "kinds", "length_profile", "lexemes", "line_column", "memory_estimate", "minify", "quote_json",
    "reduction_percent", "repair_escapes", "semantic_equals", "severity_label", "skip_invalid", "skip_whitespace", "structure_counts",
    "type_name", "validate",
]
