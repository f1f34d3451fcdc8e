"""Incremental analytics on PySpark: signed-multiplicity tables, views, search and series operators."""

__version__ = "0.1.0"
