"""Readers of the project's tables and files."""

from quillspark.sources.tables import table

__all__ = ["table"]
