"""JSON document processing and relational helpers expressed as Spark plans."""

__version__ = "0.1.0"
