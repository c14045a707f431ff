"""Operators for large-scale training-data pipelines.

Thirteen operators over the tables ``documents``, ``labels``, ``pages``,
``benchmark``, ``conversations`` and ``embeddings``.  Every module holds one operator with its
general interface, and a thin ``query(spark, sf_dir)`` that applies it to its
whole table.  Nothing outside this subpackage imports it.
"""
