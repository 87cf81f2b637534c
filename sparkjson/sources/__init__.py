"""Reading and writing JSON texts: one file or one line is one document."""

from .files import minified_files, minify_files, read_documents, read_lines, validated_files, write_documents, write_metrics

__all__ = ["minified_files", "minify_files", "read_documents", "read_lines", "validated_files", "write_documents", "write_metrics"]
