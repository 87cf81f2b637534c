"""The same operations on file streams."""

from .files import document_stream, progress_rates, run_available

__all__ = ["document_stream", "progress_rates", "run_available"]
