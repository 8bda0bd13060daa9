"""Operators of a training-data pipeline, their registered queries and SQL.

Nothing outside this subpackage imports it, but for the guarded lookup in ``__spark_entry__.py``
and ``corpus_pipeline.py``, which belongs to it.
"""
