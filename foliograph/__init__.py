"""A search, extraction and ingestion engine for gazette-like document collections, on PySpark."""

__version__ = "0.2.0"
